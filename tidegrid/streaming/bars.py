"""Bars from a stream of trades.

A row without a symbol is a tick: it has a time and moves the watermark, nothing else. Ticks end a session that no later
trade would end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.bars import ACTIVITY_COLUMNS, BAR_KEYS, COUNT_COLUMNS, SUM_COLUMNS, event_order
from tidegrid.params import DAY_NS, NS_PER_MS
from tidegrid.session import scratch_path
from tidegrid.sources.trades import trades_from_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events*.parquet") -> DataFrame:
    """Canonical trades from a growing folder of event files."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
    return trades_from_events(reader.parquet(folder))


def write_clock(spark: SparkSession, time_ns: int) -> str:
    """A new folder of ticks with one at ``time_ns``."""
    path = scratch_path(spark, "clock")
    spark.createDataFrame([(time_ns,)], "time_ns bigint").coalesce(1).write.parquet(path)
    return path


def with_clock(stream: DataFrame, folder: str, column: str) -> DataFrame:
    """The stream and the ticks of a growing folder, their time in ``column``."""
    ticks = stream.sparkSession.readStream.schema("time_ns bigint").parquet(folder)
    return stream.unionByName(ticks.select(F.col("time_ns").alias(column)), allowMissingColumns=True)


def stream_bars(trades: DataFrame, interval_ms: int, delay: str) -> DataFrame:
    """Tumbling bars per (symbol, market, date), emitted once the watermark passes their end.

    The label is the end of the window and an event on a boundary falls into the next one, as
    for batch bars. Later rows are dropped by the watermark.
    """
    instant = F.timestamp_micros(F.floor(F.col("event_time_ns") / 1000).cast("long"))
    maker = F.col("is_buyer_maker")
    timed = trades.withColumn("_at", instant).withWatermark("_at", delay).withColumn(
        "_order", event_order(F.col("event_time_ns"), F.col("aggregate_trade_id"))
    )
    return (
        timed.groupBy(F.window("_at", f"{interval_ms} milliseconds"), *BAR_KEYS)
        .agg(
            F.max_by("price", "_order").alias("last_price"),
            *(F.sum(name).alias(name) for name in SUM_COLUMNS),
            F.count("*").alias("trade_count"),
            F.count_if(~maker).alias("buyer_trade_count"),
            F.count_if(maker).alias("seller_trade_count"),
        )
        .select(
            *BAR_KEYS,
            (F.unix_micros("window.end") * 1000).alias("decision_time_ns"),
            "last_price",
            *ACTIVITY_COLUMNS,
        )
        # bars of ticks; a filter on their keys would remove the ticks before the watermark sees them
        .where(F.col("last_price").isNotNull())
    )


def run_to_table(
    stream: DataFrame, name: str, output_mode: str = "append", progress: list[dict] | None = None
) -> DataFrame:
    """Drain the available input into a Parquet table in the shared folder and read it back.

    ``progress`` receives the reports of the batches, with their state rows and the rows dropped behind the watermark.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    # State larger than the heap, and states of several variables, need the RocksDB store.
    spark.conf.set(provider, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(output_mode)
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if progress is not None:
            progress.extend(json.loads(p.json) if hasattr(p, "json") else dict(p) for p in query.recentProgress)
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(path)


def bar_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stored bar table as a stream."""
    counts = ", ".join(f"{n} bigint" for n in COUNT_COLUMNS)
    sums = ", ".join(f"{n} double" for n in ("last_price", *SUM_COLUMNS))
    keys = ", ".join(f"{n} string" for n in BAR_KEYS)
    schema = f"{keys}, decision_time_ns bigint, {sums}, {counts}"
    return spark.readStream.schema(schema).parquet(folder)


def fill_gaps(bars: pd.DataFrame, time: int, price: float | None, step: int) -> pd.DataFrame:
    """Bars in order, each preceded by the empty bars after the one before it; the first follows ``time``.

    A bar not later than the one before it comes back as it is, marked ``late``: its place is already written.
    A bar off the grid raises.
    """
    times = bars["decision_time_ns"].to_numpy("int64")
    if ((times - time) % step).any():
        raise ValueError(f"bar at {times[np.flatnonzero((times - time) % step)[0]]} is off the grid")
    reached = np.maximum.accumulate(np.concatenate([[time], times[:-1]]))
    late = bars[times <= reached].assign(late=True)
    bars, times = bars[times > reached], times[times > reached]
    if not len(bars):
        return late
    previous = np.concatenate([[time], times[:-1]]).astype("int64")
    length = (times - previous) // step
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    traded = place == np.repeat(length - 1, length)
    out = bars.iloc[np.repeat(np.arange(len(bars)), length)].reset_index(drop=True)
    out["decision_time_ns"] = np.repeat(previous, length) + step * (place + 1)
    before = np.concatenate([[np.nan if price is None else price], bars["last_price"].to_numpy(float)[:-1]])
    out["last_price"] = np.where(traded, out["last_price"], np.repeat(before, length))
    for name in ACTIVITY_COLUMNS:
        out[name] = np.where(traded, out[name], 0).astype(out[name].dtype)
    return pd.concat([out.assign(late=False), late]) if len(late) else out.assign(late=False)


def quiet_bars(key: tuple, time: int, price: float, end: int, step: int) -> pd.DataFrame:
    """The empty bars of a key after ``time`` up to and with ``end``."""
    times = np.arange(time + step, end + 1, step, dtype="int64")
    out = pd.DataFrame({**dict(zip(BAR_KEYS, key)), "decision_time_ns": times, "last_price": price})
    for name in ACTIVITY_COLUMNS:
        out[name] = 0 if name in COUNT_COLUMNS else 0.0
    return out.assign(late=False)


def make_filler(interval_ms: int):
    """A stateful processor that emits the empty bars between the bars of a day, and those after its last bar.

    State per (symbol, market, date): time and price of the last bar seen. Bars of one key
    arrive in order from an append-mode bar stream; within a batch they are sorted here. When the watermark
    passes the end of the day a timer emits the rest of it and the state goes.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    step = interval_ms * NS_PER_MS

    class FillBars(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "time bigint, price double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("decision_time_ns", kind="stable").drop(columns="_at", errors="ignore")
            if key[0] is None:
                return
            opening = int(batch["decision_time_ns"].iloc[0] - 1) // DAY_NS * DAY_NS
            if self.last.exists():
                time, price = self.last.get()
            else:
                time, price = opening, None
                self.handle.registerTimer((opening + DAY_NS) // NS_PER_MS)
            filled = fill_gaps(batch, int(time), price, step)
            taken = filled[~filled["late"]]
            if len(taken):
                end = taken.iloc[-1]
                self.last.update((int(end["decision_time_ns"]), float(end["last_price"])))
            yield filled

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.last.exists():
                time, price = self.last.get()
                end = ((int(time) - 1) // DAY_NS + 1) * DAY_NS
                self.last.clear()
                if end > time:
                    yield quiet_bars(key, int(time), float(price), end, step)

        def close(self) -> None:
            pass

    return FillBars()


def fill_stream(bars: DataFrame, interval_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Gap-free bars of each key, prices carried forward, to the end of each day that the watermark has passed.

    ``late`` marks bars whose place was already written; ``late_counts`` counts them. Bars of a closed day are dropped
    behind the watermark and counted in the reports of ``run_to_table``.
    """
    instant = F.timestamp_micros(F.floor(F.col("decision_time_ns") / 1000).cast("long"))
    columns = bars.schema.add("late", "boolean")
    return bars.withColumn("_at", instant).withWatermark("_at", delay).groupBy(*BAR_KEYS).transformWithStateInPandas(
        statefulProcessor=make_filler(interval_ms),
        outputStructType=columns,
        outputMode="Append",
        timeMode="EventTime",
    )


def on_time(filled: DataFrame) -> DataFrame:
    """The bars of a filled table."""
    return filled.where(~F.col("late")).drop("late")


def late_counts(filled: DataFrame) -> DataFrame:
    """(symbol, market, date, late_bars): the side table of bars that came too late for their place."""
    return filled.where("late").groupBy(*BAR_KEYS).agg(F.count("*").alias("late_bars"))


def dropped_behind_watermark(progress: list[dict]) -> int:
    """Rows that the watermark kept from the stateful operators of a run."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])
