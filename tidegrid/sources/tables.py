"""Partitioned Parquet tables of trades and features, CSV reports and inventories."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.archives import read_binary
from tidegrid.sources.schema import CANONICAL_TRADES

TRADE_PARTITIONS = ("symbol", "market_type", "date")
FEATURE_PARTITIONS = ("symbol", "date")


def _write(frame: DataFrame, path: str, parts: Sequence[str], order: Sequence[str], slice_by: str, rows: int):
    """Each partition value is written in slices of consecutive rows, sorted within files.

    A rerun replaces exactly the partitions it contains. The slice keeps a crowded partition
    from being one task; the file count of a normal one stays at one or two.
    """
    slice_number = F.floor(F.col(slice_by) / rows)
    placed = frame.withColumn("_slice", slice_number).repartition(*parts, "_slice")
    (
        placed.sortWithinPartitions(*parts, *order)
        .drop("_slice")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*parts)
        .parquet(path)
    )


def write_trades(
    trades: DataFrame, path: str, slice_ids: int = 10_000_000, order: Sequence = ("event_time_ns", "aggregate_trade_id")
) -> None:
    """Canonical trades, one directory per (symbol, market, date), sorted by (time, id) within each."""
    columns = [*CANONICAL_TRADES.fieldNames(), "date"]
    _write(trades.select(*columns), path, TRADE_PARTITIONS, order, "aggregate_trade_id", slice_ids)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Stored trades under their declared schema; partition values stay strings."""
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in CANONICAL_TRADES.fields] + ["date string"]
    )
    return spark.read.schema(schema).parquet(path)


def _last_commit(spark: SparkSession, path: str) -> int:
    """The number of the newest commit of a table, 0 without any."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(name) for name in names if name.isdigit()), default=0)


def _publish(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a name that must be free, in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    place = hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
        spark.sparkContext._jsc.hadoopConfiguration(),
    )
    files.rename(hadoop.Path(source), place, none)


def _commits_schema(parts: Sequence[str]) -> str:
    return ", ".join(f"{name} string" for name in (*parts, "version"))


def commit_trades(trades: DataFrame, path: str, slice_ids: int = 10_000_000) -> int:
    """Replace the partitions that ``trades`` contains, all at once; returns the number of the commit.

    The files go to a version folder that nobody reads yet. A commit is a small table with the version of
    each partition, made from the commit before, and counts from the moment when its folder is moved
    to its number. A run that dies before leaves the old table; a lost executor repeats its tasks before
    anything counts. Two writers that start from the same commit move to the same number: the second raises.
    """
    spark, version = trades.sparkSession, uuid.uuid4().hex
    number = _last_commit(spark, path)
    write_trades(trades, f"{path}/files/version={version}", slice_ids)
    parts, schema = list(TRADE_PARTITIONS), _commits_schema(TRADE_PARTITIONS)
    written = read_trades(spark, f"{path}/files/version={version}").select(*parts).distinct()
    commit = written.withColumn("version", F.lit(version))
    if number:
        before = spark.read.schema(schema).parquet(f"{path}/commits/{number}")
        commit = commit.unionByName(before.join(commit.select(*parts), parts, "left_anti"))
    waiting = f"{path}/commits/_waiting-{version}"
    commit.coalesce(1).write.parquet(waiting)
    _publish(spark, waiting, f"{path}/commits/{number + 1}")
    return number + 1


def read_committed_trades(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table at its newest commit, or at an earlier one.

    The semi-join to the commit is on partition columns, so versions that were replaced or never
    committed are pruned when the query runs. Spark prunes for a filtered side only, hence the filter on
    the names of versions, which all rows pass.
    """
    number = number or _last_commit(spark, path)
    if not number:
        raise ValueError(f"{path} has no commit")
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in CANONICAL_TRADES.fields] + ["date string", "version string"]
    )
    files = spark.read.schema(schema).parquet(f"{path}/files")
    commit = spark.read.schema(_commits_schema(TRADE_PARTITIONS)).parquet(f"{path}/commits/{number}")
    commit = commit.where(F.length("version") == 32)
    return files.join(commit, [*TRADE_PARTITIONS, "version"], "left_semi").drop("version")


def write_features(features: DataFrame, path: str) -> None:
    """Features, one directory per (symbol, date); a day is bounded by the decision grid."""
    _write(features, path, FEATURE_PARTITIONS, ("decision_time_ns",), "decision_time_ns", 2**62)


def read_features(
    spark: SparkSession, path: str, symbols: Sequence[str], start: str, end: str, columns: Sequence[str],
    schema=None,
) -> DataFrame:
    """Chosen columns of a date range; the filter prunes partition directories."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (
        reader.parquet(path)
        .where(F.col("symbol").isin(*symbols) & F.col("date").cast("string").between(start, end))
        .select("symbol", F.col("date").cast("string").alias("date"), "decision_time_ns", *columns)
    )


def write_report(frame: DataFrame, path: str) -> None:
    """A small result as one CSV file; the header is written even without rows."""
    frame.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def empty_report(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per stored file: rows, time range, timestamp unit and SHA-256."""
    trades = read_trades(spark, path)
    file = F.col("_metadata.file_path").alias("file")
    counts = trades.select("*", file).groupBy("symbol", "market_type", "date", "file").agg(
        F.count("*").alias("rows"),
        F.min("event_time_ns").alias("first_event_time_ns"),
        F.max("event_time_ns").alias("last_event_time_ns"),
    )
    # The two readers spell local paths differently (file:/ and file:///).
    plain = F.regexp_replace("path", "^file:/+", "/")
    digests = read_binary(spark, path, "*.parquet").select(
        plain.alias("_file"), F.sha2("content", 256).alias("sha256")
    )
    return (
        counts.withColumn("_file", F.regexp_replace("file", "^file:/+", "/"))
        .join(digests, "_file", "left")
        .drop("_file")
        .withColumn("timestamp_unit", F.lit("ns"))
    )


def partition_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The file inventory per (symbol, market, date), with whether every file was hashed."""
    return file_inventory(spark, path).groupBy("symbol", "market_type", "date").agg(
        F.sum("rows").alias("rows"),
        F.min("first_event_time_ns").alias("first_event_time_ns"),
        F.max("last_event_time_ns").alias("last_event_time_ns"),
        F.min(F.coalesce(F.length("sha256"), F.lit(0)) == 64).alias("hashed"),
    )
