"""Raw trade files: ZIP archives with one CSV member, plain CSV, and checksum sidecars."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources.schema import (
    RAW_PERPETUAL_HEADER,
    RAW_SPOT_COLUMNS,
    RAW_TRADES,
    SchemaMismatch,
    require_columns,
)
from tidegrid.sources.trades import one_unit

CHUNK_ROWS = 200_000

# The name of a raw file, <symbol>-<market>-<date>[-part].zip, and of a sidecar line.
FILE_NAME = r"([^/]+)-(spot|perpetual)-(\d{4}-\d{2}-\d{2})[^/]*$"
SIDECAR = r"^\s*([0-9a-fA-F]{64})\s+\*?(\S+)\s*$"


def read_binary(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, content), one row per file; files are at most 2 GB each."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true").load(path).select("path", "content")


def _name_part(group: int) -> Column:
    return F.regexp_extract("path", FILE_NAME, group)


def ingest_archives(files: DataFrame) -> DataFrame:
    """Raw text rows (``RAW_TRADES``) of ZIP archives given as (path, content).

    An archive must hold exactly one CSV. Spot files have no header and eight columns,
    perpetual files the exact seven-column header. A file has one timestamp unit. Members are decompressed and parsed in
    chunks, so a task holds one compressed archive and one chunk, never a whole table.
    """
    named = files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        _name_part(1).alias("symbol"),
        _name_part(2).alias("market_type"),
        _name_part(3).alias("date"),
        "content",
    )
    return named.mapInPandas(_unpack, RAW_TRADES)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            if not row.market_type:
                raise SchemaMismatch(f"unrecognised file name {row.source_file}")
            with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                members = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                if len(members) != 1:
                    raise SchemaMismatch(f"{row.source_file}: expected one CSV, found {members}")
                seen, digits = 0, set()
                with archive.open(members[0]) as stream:
                    for chunk in _chunks(stream, row.market_type, row.source_file):
                        seen += len(chunk)
                        digits |= set(chunk["transact_time"].str.strip().str.len())
                        if len(digits) > 1:
                            raise SchemaMismatch(f"{row.source_file}: timestamps of {sorted(digits)} digits, mixed units")
                        identity = {
                            name: getattr(row, name)
                            for name in ("market_type", "symbol", "date", "source_file")
                        }
                        yield chunk.assign(**identity)[RAW_TRADES.fieldNames()]
                if not seen:
                    raise SchemaMismatch(f"{row.source_file}: no trades")


def _chunks(stream, market: str, name: str) -> Iterator[pd.DataFrame]:
    """Text chunks with canonical column names; the header and the width are checked."""
    headed = market == "perpetual"
    options = {"dtype": str, "chunksize": CHUNK_ROWS, "keep_default_na": False}
    try:
        reader = pd.read_csv(stream, header=0 if headed else None, index_col=False, **options)
        for chunk in reader:
            if headed:
                if tuple(chunk.columns) != RAW_PERPETUAL_HEADER:
                    raise SchemaMismatch(f"{name}: unexpected header {list(chunk.columns)}")
                yield chunk.rename(columns={"agg_trade_id": "aggregate_trade_id"})
            else:
                if chunk.shape[1] != len(RAW_SPOT_COLUMNS):
                    raise SchemaMismatch(f"{name}: {chunk.shape[1]} columns")
                yield chunk.set_axis(list(RAW_SPOT_COLUMNS), axis=1)
    except pd.errors.EmptyDataError:
        return


def read_csv_files(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Raw text rows of plain or gzip CSV files; Spark splits plain files over tasks."""
    reader = spark.read.option("recursiveFileLookup", "true").option("mode", "FAILFAST")
    if market == "spot":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_SPOT_COLUMNS])
        frame = reader.csv(path, schema=schema, header=False)
    else:
        header = spark.read.option("recursiveFileLookup", "true").csv(path, header=True)
        require_columns(header, RAW_PERPETUAL_HEADER)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_PERPETUAL_HEADER])
        frame = reader.csv(path, schema=schema, header=True, enforceSchema=False)
        frame = frame.withColumnRenamed("agg_trade_id", "aggregate_trade_id")
    named = frame.withColumn("path", F.input_file_name())
    raw = named.withColumns(
        {
            "market_type": F.lit(market),
            "symbol": _name_part(1),
            "date": _name_part(3),
            "source_file": F.element_at(F.split("path", "/"), -1),
        }
    ).select(*RAW_TRADES.fieldNames())
    return one_unit(raw)


def _by_place(raw: DataFrame, most_rows: int) -> DataFrame:
    """Rows with ``_part``: the place of a trade in its (symbol, market, day), by id, in files of ``most_rows``."""
    day = ["symbol", "market_type", "date"]
    block = F.floor(F.col("aggregate_trade_id").cast("long") / most_rows)
    blocks = raw.groupBy(*day, block.alias("_block")).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(*day).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(*day, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # a block of ids has no more rows than a file, however many its day has
    place = F.row_number().over(W.partitionBy(*day, "_block").orderBy(F.col("aggregate_trade_id").cast("long")))
    placed = raw.withColumn("_block", block).withColumn("_place", place).join(before, [*day, "_block"])
    return placed.select(*raw.columns, F.floor((F.col("_before") + F.col("_place") - 1) / most_rows).alias("_part"))


def pack_archives(raw: DataFrame, rows_per_file: int | None = None, most_rows: int = 1_000_000) -> DataFrame:
    """The inverse of ingestion: (path, content) archives of at most ``most_rows`` rows.

    A day of a symbol and market that fits one file is one, whatever its trade ids; a crowded one becomes several
    files, each built by its own task. With ``rows_per_file`` a file instead covers so many consecutive ids.
    """
    if rows_per_file:
        placed = raw.withColumn("_part", F.floor(F.col("aggregate_trade_id").cast("long") / rows_per_file))
    else:
        placed = _by_place(raw, most_rows)
    name = F.concat_ws("-", "symbol", "market_type", "date", F.lpad(F.col("_part").cast("string"), 6, "0"))

    def zipped(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        market = rows["market_type"].iloc[0]
        rows = rows.assign(order=rows["aggregate_trade_id"].astype("int64")).sort_values("order")
        if market == "spot":
            body = rows.assign(is_best_match="True")[list(RAW_SPOT_COLUMNS)]
            text = body.to_csv(index=False, header=False)
        else:
            body = rows.rename(columns={"aggregate_trade_id": "agg_trade_id"})
            text = body[list(RAW_PERPETUAL_HEADER)].to_csv(index=False)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            stamp = zipfile.ZipInfo(f"{key[0]}.csv", date_time=(1980, 1, 1, 0, 0, 0))
            archive.writestr(stamp, text, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [f"{key[0]}.zip"], "content": [buffer.getvalue()]})

    return placed.groupBy(name.alias("_name")).applyInPandas(zipped, "path string, content binary")


def sidecars_for(files: DataFrame) -> DataFrame:
    """(path, text) checksum sidecars of (path, content) files."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.concat("path", F.lit(".CHECKSUM")).alias("path"),
        F.concat(F.sha2("content", 256), F.lit("  "), name, F.lit("\n")).alias("text"),
    )


def read_sidecars(spark: SparkSession, path: str, glob: str = "*.CHECKSUM") -> DataFrame:
    content = read_binary(spark, path, glob)
    return content.select("path", F.decode("content", "UTF-8").alias("text"))


def verify_checksums(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(file, status): ok, mismatch, missing_sidecar, bad_sidecar or wrong_name.

    Only names and digests are joined; contents stay where they were read.
    """
    observed = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("observed")
    )
    declared = sidecars.select(
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.CHECKSUM$", "").alias("file"),
        F.lower(F.regexp_extract("text", SIDECAR, 1)).alias("expected"),
        F.element_at(F.split(F.regexp_extract("text", SIDECAR, 2), "/"), -1).alias("named"),
    )
    status = (
        F.when(F.col("expected").isNull(), "missing_sidecar")
        .when(F.col("expected") == "", "bad_sidecar")
        .when(F.col("named") != F.col("file"), "wrong_name")
        .when(F.col("expected") != F.col("observed"), "mismatch")
        .otherwise("ok")
    )
    return observed.join(declared, "file", "left").select("file", status.alias("status"))
