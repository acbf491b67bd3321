"""Violations as tables; ``require_clean`` turns a table into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.guards import not_finite
from tidegrid.params import MARKETS
from tidegrid.sources.trades import VENUE

SIGN_TOLERANCE = 1e-12


class DataQualityError(ValueError):
    """A validated table has violations."""


def _violations(symbols: Sequence[str]) -> dict[str, object]:
    price, quantity, notional = F.col("price"), F.col("quantity"), F.col("notional")
    sign = F.col("aggressor_sign")
    expected_sign = F.when(F.col("is_buyer_maker"), -1).otherwise(1)
    not_positive = (price <= 0) | (quantity <= 0) | (notional <= 0)
    infinite = not_finite(price) | not_finite(quantity) | not_finite(notional)
    money_scale = F.greatest(F.lit(1.0), F.abs(notional))
    required = ("event_time_ns", "aggregate_trade_id", "price", "quantity", "is_buyer_maker")
    nulls = F.lit(False)
    for name in required:
        nulls = nulls | F.col(name).isNull()
    return {
        "invalid_numeric": not_positive | infinite,
        "invalid_sign": ~sign.isin(-1, 1),
        "invalid_signed_flow": (sign != expected_sign)
        | (F.abs(F.col("signed_quantity") - sign * quantity) > SIGN_TOLERANCE)
        | (F.abs(F.col("signed_notional") - sign * notional) > SIGN_TOLERANCE * money_scale),
        "invalid_identity": (F.col("exchange") != VENUE)
        | ~F.col("market_type").isin(*MARKETS)
        | ~F.col("symbol").isin(*symbols),
        "required_nulls": nulls,
    }


def validate_trades(
    trades: DataFrame,
    keys: Sequence[str],
    order: str,
    symbols: Sequence[str],
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Per key: rows, time range, time reversals along ``order`` and violation counts.

    Looking one row back over a whole file would put the file into one task. Rows are cut into
    blocks of ``block_rows`` consecutive order values; each block is checked alone, and a
    second, small step compares the last time of a block with the first of the next one.
    """
    block = F.floor(F.col(order) / block_rows).alias("_block")
    checks = _violations(symbols)
    marked = trades.select(
        *keys, "event_time_ns", order, block, *(c.alias(f"_{n}") for n, c in checks.items())
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    marked = marked.withColumn(
        "_reversal", F.col("event_time_ns") < F.lag("event_time_ns").over(inside)
    )
    per_block = marked.groupBy(*keys, "_block").agg(
        F.count("*").alias("_rows"),
        F.min("event_time_ns").alias("_low"),
        F.max("event_time_ns").alias("_high"),
        F.min_by("event_time_ns", order).alias("_first"),
        F.max_by("event_time_ns", order).alias("_last"),
        F.count_if("_reversal").alias("_reversals"),
        *(F.count_if(f"_{name}").alias(name) for name in checks),
    )
    between = W.partitionBy(*keys).orderBy("_block")
    crossing = F.coalesce(F.col("_first") < F.lag("_last").over(between), F.lit(False))
    return (
        per_block.withColumn("_crossing", crossing.cast("long"))
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("rows"),
            F.min("_low").alias("first_event_time_ns"),
            F.max("_high").alias("last_event_time_ns"),
            F.sum(F.col("_reversals") + F.col("_crossing")).alias("time_reversals"),
            *(F.sum(name).alias(name) for name in checks),
        )
    )


def validate_files(trades: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """The same checks per stored Parquet file, along its physical row order."""
    physical = trades.withColumns(
        {"file": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")}
    )
    return validate_trades(physical, ["file"], "row_index", symbols)


def physical_order(trades: DataFrame, keys: Sequence[str], block_rows: int = 1_000_000) -> DataFrame:
    """(keys, files, rows, time_reversals, id_disorders, in_order) of stored files along their physical rows.

    A row is out of order when its (time, id) does not exceed that of the row before it in its file: a
    reversal when the time falls, a disorder when times are equal and the id does not rise. Blocks of
    consecutive rows are checked alone, then the edges between them, so a large file is not one task.
    """
    index = F.col("_metadata.row_index")
    placed = trades.select(
        *keys, "event_time_ns", "aggregate_trade_id", F.col("_metadata.file_path").alias("_file"),
        index.alias("_row"), F.floor(index / block_rows).alias("_block"),
    )
    names = ("event_time_ns", "aggregate_trade_id")

    def breaks(time, number, earlier_time, earlier_number):
        reversal = F.coalesce(time < earlier_time, F.lit(False)).cast("long")
        disorder = F.coalesce((time == earlier_time) & (number <= earlier_number), F.lit(False)).cast("long")
        return reversal, disorder

    inside = W.partitionBy(*keys, "_file", "_block").orderBy("_row")
    reversal, disorder = breaks(*(F.col(n) for n in names), *(F.lag(n).over(inside) for n in names))
    blocks = placed.withColumns({"_reversal": reversal, "_disorder": disorder}).groupBy(*keys, "_file", "_block").agg(
        F.count("*").alias("rows"),
        F.sum("_reversal").alias("_reversals"),
        F.sum("_disorder").alias("_disorders"),
        *(F.min_by(n, "_row").alias(f"_first_{n}") for n in names),
        *(F.max_by(n, "_row").alias(f"_last_{n}") for n in names),
    )
    between = W.partitionBy(*keys, "_file").orderBy("_block")
    reversal, disorder = breaks(
        *(F.col(f"_first_{n}") for n in names), *(F.lag(f"_last_{n}").over(between) for n in names)
    )
    crossed = blocks.withColumns({"_crossing": reversal, "_touching": disorder})
    return crossed.groupBy(*keys).agg(
        F.count_distinct("_file").alias("files"),
        F.sum("rows").alias("rows"),
        F.sum(F.col("_reversals") + F.col("_crossing")).alias("time_reversals"),
        F.sum(F.col("_disorders") + F.col("_touching")).alias("id_disorders"),
    ).withColumn("in_order", (F.col("time_reversals") == 0) & (F.col("id_disorders") == 0))


def duplicate_ids(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return frame.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def validate_features(
    features: DataFrame, predictors: Sequence[str], labels: Sequence[str]
) -> DataFrame:
    """Per (symbol, date): rows, unique times, leakage, non-finite and out-of-range values."""
    finite = "+".join(
        f"CAST(coalesce(isnan({c}) OR abs({c}) = double('Infinity'), false) AS INT)"
        for c in (*predictors, *labels)
    )
    bounded = "+".join(
        f"CAST(coalesce({c} < -1 OR {c} > 1, false) AS INT)"
        for c in predictors
        if "_imbalance_" in c
    )
    return (
        features.selectExpr(
            "symbol",
            "date",
            "decision_time_ns",
            "feature_cutoff_ns >= decision_time_ns AS late",
            f"{finite} AS bad",
            f"{bounded} AS unbounded",
        )
        .groupBy("symbol", "date")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("decision_time_ns").alias("unique_times"),
            F.count_if("late").alias("late_cutoffs"),
            F.sum("bad").alias("non_finite_values"),
            F.sum("unbounded").alias("imbalances_out_of_range"),
        )
    )


def feature_summary(features: DataFrame, label: str, window_ms: int) -> DataFrame:
    """Descriptive statistics of each (symbol, date) partition."""

    def or_zero(column):
        return F.coalesce(column, F.lit(0.0))

    return features.groupBy("symbol", "date").agg(
        F.count("*").alias("rows"),
        F.min("decision_time_ns").alias("first_decision_time_ns"),
        F.max("decision_time_ns").alias("last_decision_time_ns"),
        F.count_if(F.col(label).isNull()).alias("primary_label_nulls"),
        *(
            or_zero(F.avg(f"{m}_trade_count_{window_ms}ms")).alias(f"mean_{m}_trades")
            for m in MARKETS
        ),
        or_zero(F.avg("spot_perp_log_basis")).alias("mean_log_basis"),
        or_zero(F.stddev_samp("spot_perp_log_basis")).alias("std_log_basis"),
        or_zero(F.stddev_samp(label)).alias("std_target_return"),
    )


def thinned_series(features: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """Trailing mean over ``rows`` decisions and every ``rows``-th decision of a day."""
    order = W.partitionBy("symbol", "date").orderBy("decision_time_ns")
    trailing = order.rowsBetween(-(rows - 1), 0)
    return (
        features.select(
            "symbol",
            "date",
            "decision_time_ns",
            "spot_perp_log_basis",
            *(F.avg(c).over(trailing).alias(f"smoothed_{c}") for c in columns),
            F.row_number().over(order).alias("_row"),
        )
        .where((F.col("_row") - 1) % rows == 0)
        .drop("_row")
    )


def require_clean(report: DataFrame, counters: Sequence[str]) -> None:
    """Raise when any counter of a report is positive; reads one row at most."""
    dirty = report.where(" OR ".join(f"{name} > 0" for name in counters)).limit(1).collect()
    if dirty:
        raise DataQualityError(str(dirty[0].asDict()))
