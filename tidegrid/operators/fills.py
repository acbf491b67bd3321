"""Signals, sizes, event-timed fills and the choice of non-overlapping trades."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.guards import clip, ratio_or_null
from tidegrid.operators.asof import EventIndex, first_at_or_after, index_events
from tidegrid.params import NS_PER_MS, NS_PER_SECOND, ExecutionParams
from tidegrid.session import stored

DAY_KEYS = ("symbol", "date")
SMALLEST_VOLATILITY = 1e-12


def signals(scored: DataFrame) -> DataFrame:
    """Rows whose prediction reaches ``signal_threshold``, with their direction."""
    return scored.where(F.abs("prediction") >= F.col("signal_threshold")).withColumn(
        "direction", F.when(F.col("prediction") > 0, 1).otherwise(-1).cast("byte")
    )


def signal_sizes(params: ExecutionParams) -> dict:
    """Both sizing rules as columns; needs ``volatility`` and ``median_volatility``."""
    known = F.when(F.col("volatility").isNotNull(), F.greatest("volatility", F.lit(SMALLEST_VOLATILITY)))
    scaled = clip(F.col("median_volatility") / known, params.minimum_multiplier, params.maximum_multiplier)
    return {
        "fixed": F.lit(float(params.maximum_size)),
        "inverse_volatility": clip(scaled, upper=params.maximum_size),
    }


def sized_signals(frame: DataFrame, params: ExecutionParams) -> DataFrame:
    """One row per signal and sizing rule."""
    sizes = signal_sizes(params)
    pairs = F.array(
        *(F.struct(F.lit(name).alias("sizing"), size.alias("size")) for name, size in sizes.items())
    )
    return frame.select("*", F.inline(pairs))


def spot_index(trades: DataFrame) -> EventIndex:
    return index_events(trades.where("market_type = 'spot'"), DAY_KEYS)


def candidate_fills(
    chosen: DataFrame, index: EventIndex, latencies_ms: Sequence[int], holding_seconds: int
) -> DataFrame:
    """Entry and exit of every signal at every latency, whether or not it will be taken.

    Entry is the first spot event at or after decision + latency, exit the first at or after
    entry + holding time, both on the signal's day. All latencies share one pass. The entries
    are stored before the exits are looked up: they are as few as the signals, and the lookup
    reads them several times.
    """
    latency = F.explode(F.array(*(F.lit(v) for v in latencies_ms)))
    asked = chosen.withColumn("latency_ms", latency).withColumn(
        "_entry_target", F.col("decision_time_ns") + F.col("latency_ms").cast("long") * NS_PER_MS
    )
    entered = first_at_or_after(asked, index, "_entry_target", "entry").withColumn(
        "_exit_target", F.col("entry_time_ns") + holding_seconds * NS_PER_SECOND
    )
    entered = stored(entered, "entries")
    left = first_at_or_after(entered, index, "_exit_target", "exit")
    move = ratio_or_null(F.col("exit_price"), F.col("entry_price")) - 1.0
    held = (F.col("exit_time_ns") - F.col("entry_time_ns")) / F.lit(float(NS_PER_SECOND))
    return left.drop("_entry_target", "_exit_target").withColumns(
        {"gross_return": F.col("direction") * move, "holding_seconds": held}
    )


def fill_status(candidates: DataFrame) -> DataFrame:
    """Add ``status``: taken, overlapping, skipped_entry or skipped_exit.

    A signal is reached only after the last taken trade has closed; a missing fill counts as
    skipped only when it is reached. The choice is sequential within (symbol, date, latency):
    a group is one day's signals of one symbol, bounded by the decision grid, and arrives in
    time order as a stream of Arrow batches; the state is one number. Columns pass through as
    Arrow, so nanosecond integers with NULLs keep every digit.
    """
    keys = [*DAY_KEYS, "latency_ms"]
    ordered = candidates.repartition(*keys).sortWithinPartitions(*keys, "decision_time_ns")
    schema = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + ", status string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, before = -1, -1
        for batch in batches:
            status = []
            columns = ("decision_time_ns", "entry_time_ns", "exit_time_ns")
            for time, entry, leave in zip(*(batch.column(c).to_pylist() for c in columns)):
                if time < before:
                    raise ValueError("signals arrived out of order")
                before = time
                if time <= closed:
                    status.append("overlapping")
                elif entry is None:
                    status.append("skipped_entry")
                elif leave is None:
                    status.append("skipped_exit")
                else:
                    status.append("taken")
                    closed = leave
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(status, pa.string())], [*batch.schema.names, "status"]
            )

    return ordered.groupBy(*keys).applyInArrow(walk, schema)


def non_overlapping(candidates: DataFrame) -> DataFrame:
    """The taken trades."""
    return fill_status(candidates).where("status = 'taken'").drop("status")


def execution_diagnostics(statuses: DataFrame, primary_latency_ms: int) -> DataFrame:
    """Taken trades and reached skips per (symbol, latency, sizing).

    Sizing does not change which trades are taken; it is reported for the scenarios that exist.
    """
    counts = statuses.groupBy("symbol", "latency_ms").agg(
        F.count_if(F.col("status") == "taken").alias("trades"),
        F.count_if(F.col("status") == "skipped_entry").alias("skipped_entries"),
        F.count_if(F.col("status") == "skipped_exit").alias("skipped_exits"),
    )
    sizing = F.explode(F.array(F.lit("fixed"), F.lit("inverse_volatility"))).alias("sizing")
    return counts.select("*", sizing).where(
        (F.col("sizing") == "fixed") | (F.col("latency_ms") == primary_latency_ms)
    )


def apply_cost(trades: DataFrame, costs_bps: Sequence[float]) -> DataFrame:
    """One copy of each trade per round-trip cost, with cost and net P&L."""
    if min(costs_bps) < 0:
        raise ValueError("costs cannot be negative")
    cost = F.explode(F.array(*(F.lit(float(c)) for c in costs_bps)))
    return trades.withColumn("cost_bps", cost).withColumn(
        "cost_pnl", F.col("size") * F.col("cost_bps") / 10_000
    ).withColumn("net_pnl", F.col("gross_pnl") - F.col("cost_pnl"))
