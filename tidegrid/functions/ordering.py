"""Orderings over whole tables without a single-task window.

A global rank, position or cumulative sum written as an unpartitioned window runs in one
task. Here rows are range-partitioned, each range is accumulated on its own and shifted by
the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.session import checkpointed, stored


def running_totals(
    frame: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
) -> DataFrame:
    """Add, per group, the sum of each value over all rows ordered before the row.

    ``values`` maps an output name to a summed column; ``{name}_total`` is the group's total.
    The order must be unique within a group. The range number is written out (a checkpoint),
    because a recomputed range shuffle may cut elsewhere than the offsets assume. Ranges hold
    about equally many rows whatever the groups, and a group has one offset per range.
    """
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        frame.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    keys = [*groups, "_range"]
    per_range = placed.groupBy(*keys).agg(
        *(F.sum(column).alias(f"_sum_{name}") for name, column in values.items())
    )
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = per_range.select(
        *keys,
        *(
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_offset_{name}")
            for name in values
        ),
        *(F.sum(f"_sum_{name}").over(whole).alias(f"{name}_total") for name in values),
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns(
        {
            f"_local_{name}": F.coalesce(F.sum(column).over(inside), F.lit(0))
            for name, column in values.items()
        }
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *frame.columns,
        *((F.col(f"_local_{name}") + F.col(f"_offset_{name}")).alias(name) for name in values),
        *(F.col(f"{name}_total") for name in values),
    )


def average_ranks(frame: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """(groups, value, name): the average rank of each distinct value, ties sharing it.

    Equal values are counted before anything is ordered, so a value that fills a third of
    the table is a single row here.
    """
    counts = frame.groupBy(*groups, value).agg(F.count("*").alias("_ties"))
    ranked = running_totals(counts, groups, [value, *groups], {"_below": "_ties"})
    return ranked.select(*groups, value, (F.col("_below") + (F.col("_ties") + 1) / 2).alias(name))


def unpivot(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (keys, name, value) without NULL values."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    return frame.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())


def _narrowed(long: DataFrame, brackets: DataFrame, keys: Sequence[str], inside: int, bins: int = 1024) -> DataFrame:
    """Brackets cut down until each holds at most ``inside`` rows, or one value.

    Every pass counts rows in equal bins of the bracket, combined before the shuffle, and keeps the bins
    that hold the middle rows, from their least to their largest value. A pass shrinks the range at least
    by the number of bins; a spread that resists 32 passes goes on with a wide bracket, not a wrong one.
    """
    value, low, high, rows = F.col("value"), F.col("_low"), F.col("_high"), F.col("rows")
    share = F.least((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    cut = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
    number = F.when(value < low, -1).when(low == high, 0).otherwise(cut)
    upward = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("_reached") - F.col("_count")

    def of(position: Column, wanted: Column) -> Column:
        return F.max(F.when((before <= position) & (position < F.col("_reached")), wanted))

    left, right = F.floor((rows - 1) / 2), F.floor(rows / 2)
    for _ in range(32):
        if (brackets.agg(F.max("_inside")).first()[0] or 0) <= inside:
            break
        binned = (
            long.join(brackets, list(keys)).where(value <= high)
            .groupBy(*keys, "rows", "_low", "_high", number.alias("_bin"))
            .agg(F.count("*").alias("_count"), F.min("value").alias("_least"), F.max("value").alias("_largest"))
        )
        found = binned.withColumn("_reached", F.sum("_count").over(upward)).groupBy(*keys, "rows").agg(
            F.coalesce(of(left, F.col("_least")), F.max("_low")).alias("_low"),
            F.coalesce(of(right, F.col("_largest")), F.max("_high")).alias("_high"),
            (of(right, F.col("_reached")) - of(left, before)).alias("_inside"),
        )
        many = F.when(low == high, 1).otherwise(F.coalesce("_inside", F.lit(0))).cast("long")
        brackets = stored(found.withColumn("_inside", many), "brackets")
    return brackets


def exact_medians(
    frame: DataFrame, groups: Sequence[str], columns: Sequence[str], accuracy: int = 10_000,
    inside: int = 1_000_000,
) -> DataFrame:
    """(groups, name, median, rows): exact medians of many columns in two or more passes.

    The built-in median keeps every distinct value of a group in one buffer. The first pass
    brackets each median with a quantile sketch of bounded size. Where a bracket may still hold more than
    ``inside`` rows, passes of bin counts narrow it. The last pass counts the values below the bracket and
    orders the distinct values inside it, so no task orders more than ``inside`` of a group, whatever its
    size. A bracket that misses its median raises instead of giving a wrong answer.
    """
    keys = [*groups, "name"]
    margin = 5.0 / accuracy
    points = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    # One row per group with all sketches side by side: few groups keep the aggregation hashed.
    sketches = frame.groupBy(*groups).agg(
        *(
            F.struct(
                F.lit(c).alias("name"),
                F.count(c).alias("rows"),
                F.percentile_approx(F.col(c).cast("double"), points, F.lit(accuracy)).alias("_bracket"),
            ).alias(c)
            for c in columns
        )
    )
    wide = sketches.select(*groups, F.inline(F.array(*columns))).select(
        *keys,
        "rows",
        F.col("_bracket")[0].alias("_low"),
        F.col("_bracket")[1].alias("_high"),
        F.ceil(F.col("rows") * (2 * margin + 2.0 / accuracy)).alias("_inside"),
    )
    long = unpivot(frame, groups, columns)
    brackets = _narrowed(long, stored(wide, "brackets"), keys, inside).drop("_inside")
    value, low, high = F.col("value"), F.col("_low"), F.col("_high")
    counted = (
        long.join(brackets, keys)
        .where(value <= high)
        .groupBy(*keys, "rows", F.when(value >= low, value).alias("value"))
        .agg(F.count("*").alias("_count"))
    )
    upward = W.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first())
    reached = F.sum("_count").over(upward.rowsBetween(W.unboundedPreceding, W.currentRow))

    def at(position: Column) -> Column:
        holds = (F.col("_reached") - F.col("_count") <= position) & (position < F.col("_reached"))
        return F.max(F.when(holds, value))

    rows = F.col("rows")
    middle = counted.withColumn("_reached", reached).groupBy(*keys, "rows").agg(
        at(F.floor((rows - 1) / 2)).alias("_left"), at(F.floor(rows / 2)).alias("_right")
    )
    median = (F.col("_left") + F.col("_right")) / 2
    return middle.select(
        *keys,
        F.when(median.isNotNull(), median)
        .otherwise(F.raise_error(F.lit("median outside its bracket")).cast("double"))
        .alias("median"),
        "rows",
    )


def exact_median(frame: DataFrame, groups: Sequence[str], column: str, name: str) -> DataFrame:
    """(groups, name) with the exact median of one column."""
    medians = exact_medians(frame, groups, [column])
    return medians.select(*groups, F.col("median").alias(name))
