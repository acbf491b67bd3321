"""Whole-day folds, purged splits, sample periods and partition coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.guards import date_to_ns
from tidegrid.params import NS_PER_SECOND


def selection_grid(
    spark: SparkSession, start: str, end: str, symbols: Sequence[str], markets: Sequence[str]
) -> DataFrame:
    """Every (date, symbol, market) of an inclusive date range."""
    if end < start:
        raise ValueError("the range ends before it starts")
    return _grid(spark.range(1), F.lit(start), F.lit(end), symbols, markets)


def _grid(one: DataFrame, start, end, symbols, markets) -> DataFrame:
    days = F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 day"))
    return (
        one.select(F.explode(days).alias("day"))
        .select("day", F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
        .select(
            F.date_format("day", "yyyy-MM-dd").alias("date"),
            "symbol",
            F.explode(F.array(*map(F.lit, markets))).alias("market_type"),
        )
    )


def observed_grid(trades: DataFrame, symbols: Sequence[str], markets: Sequence[str]) -> DataFrame:
    """The selection grid over the date range a table covers."""
    span = trades.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return _grid(span, F.col("a"), F.col("b"), symbols, markets)


def missing_partitions(expected: DataFrame, trades: DataFrame) -> DataFrame:
    """Expected (date, symbol, market) combinations without any row."""
    keys = ["date", "symbol", "market_type"]
    return expected.join(trades.select(*keys).distinct(), keys, "left_anti")


def expanding_folds(dates: DataFrame, initial_days: int, evaluation_days: int) -> DataFrame:
    """(fold, date, role, boundary_ns) from a frame with a ``date`` column.

    Fold f trains on the first initial + (f-1)*evaluation days and evaluates the next
    ``evaluation_days``; only whole folds exist. One row per day enters the windows.
    """
    if initial_days <= 0 or evaluation_days <= 0:
        raise ValueError("fold lengths must be positive")
    every = W.partitionBy()
    day = F.col("day_number")
    folds = F.floor((F.col("days") - initial_days) / evaluation_days)
    first = initial_days + (F.col("fold") - 1) * evaluation_days
    numbered = dates.select("date").distinct().select(
        "date",
        F.row_number().over(W.orderBy("date")).alias("day_number"),
        F.count("*").over(every).alias("days"),
    )
    member = numbered.where(folds >= 1).withColumn("fold", F.explode(F.sequence(F.lit(1), folds)))
    by_fold = W.partitionBy("fold")
    return (
        member.where(day <= first + evaluation_days)
        .withColumn("role", F.when(day <= first, "train").otherwise("evaluate"))
        .select(
            F.col("fold").cast("int").alias("fold"),
            "date",
            "role",
            date_to_ns(F.min(F.when(F.col("role") == "evaluate", F.col("date"))).over(by_fold))
            .alias("boundary_ns"),
        )
    )


def walk_forward_split(frame: DataFrame, folds: DataFrame, purge_seconds: int) -> DataFrame:
    """Rows with (fold, role), without those within the purge around the boundary.

    A training row appears once per fold that trains on it. The fold table has one row per
    fold and day; Spark decides by its measured size whether to broadcast it.
    """
    purge = F.lit(purge_seconds * NS_PER_SECOND)
    time, boundary = F.col("decision_time_ns"), F.col("boundary_ns")
    outside = F.when(F.col("role") == "train", time < boundary - purge).otherwise(
        time >= boundary + purge
    )
    return frame.join(folds, "date").where(outside).drop("boundary_ns")


def training_folds(frame: DataFrame, folds: DataFrame, purge_seconds: int) -> DataFrame:
    """Each row that any fold trains on, once, with the array ``folds`` of those that do."""
    days = folds.where("role = 'train'").groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct("fold", "boundary_ns"))).alias("folds")
    )
    purge, time = F.lit(purge_seconds * NS_PER_SECOND), F.col("decision_time_ns")
    own = F.transform(F.filter("folds", lambda f: time < f["boundary_ns"] - purge), lambda f: f["fold"])
    return frame.join(days, "date").withColumn("folds", own).where(F.size("folds") > 0)


def require_folds(folds: DataFrame) -> None:
    """Raise when a date range is too short for one fold."""
    if not folds.limit(1).collect():
        raise ValueError("the dates do not fill one fold")


def require_split(frame: DataFrame, folds: DataFrame, purge_seconds: int) -> None:
    """Raise unless there are folds and each has training rows, evaluation rows, and the former all before the latter.

    Looks at distinct decision times alone, which the grid bounds; one row at most reaches the driver.
    """
    require_folds(folds)
    times = frame.select("date", "decision_time_ns").distinct()
    trains, evaluates = F.col("role") == "train", F.col("role") == "evaluate"
    sides = walk_forward_split(times, folds, purge_seconds).groupBy("fold").agg(
        F.max(F.when(trains, F.col("decision_time_ns"))).alias("last_train"),
        F.min(F.when(evaluates, F.col("decision_time_ns"))).alias("first_evaluation"),
    )
    problem = (
        F.when(F.col("last_train").isNull(), "has no training rows")
        .when(F.col("first_evaluation").isNull(), "has no evaluation rows")
        .when(F.col("last_train") >= F.col("first_evaluation"), "trains on rows after its evaluation begins")
    )
    found = folds.select("fold").distinct().join(sides, "fold", "left").select("fold", problem.alias("problem"))
    bad = found.where("problem IS NOT NULL").orderBy("fold").limit(1).collect()
    if bad:
        raise ValueError(f"fold {bad[0]['fold']} {bad[0]['problem']}")


def boundary_split(
    frame: DataFrame, boundary_date: str, purge_seconds: int, embargo_seconds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows on either side of a fixed UTC midnight."""
    purge = purge_seconds * NS_PER_SECOND
    embargo = purge if embargo_seconds is None else embargo_seconds * NS_PER_SECOND
    boundary = date_to_ns(F.lit(boundary_date))
    time = F.col("decision_time_ns")
    return frame.where(time < boundary - purge), frame.where(time >= boundary + embargo)


def sample_periods(frame: DataFrame, periods: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Label rows by period (name, first date, last date, status); sealed rows are unreadable.

    Periods are parameters, so the range lookup is a CASE over the date column: it needs no
    join and prunes date partitions.
    """
    day = F.col("date")
    period, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, end, state in periods:
        period = F.when(day.between(start, end), F.lit(name)).otherwise(period)
        status = F.when(day.between(start, end), F.lit(state)).otherwise(status)
    readable = F.lit(False)
    for _, start, end, state in periods:
        if state != "sealed":
            readable = readable | day.between(start, end)
    return frame.where(readable).withColumns({"period": period, "period_status": status})

