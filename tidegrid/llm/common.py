"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import scratch_path

#: Fixed value: a word is a run without space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark deletes the shuffle files of a query when it ends; otherwise they stay until the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths written while ``settled`` makes its table; None outside.
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    Later stages read it instead of the work before it, also after an executor is lost.
    """
    return kept_at(frame, name, compression)[0]


def kept_at(frame: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """As ``kept``, with the path, for tables that ``release`` removes once nothing reads them."""
    spark = frame.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    written = _within.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(frame.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Delete a kept table; call it only when all that was derived from it is kept itself."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Keep the table that ``make`` returns and delete those it kept on the way.

    The result is written before anything goes, so that a lost executor cannot ask for the deleted tables.
    """
    written: list[str] = []
    outer = _within.set(written)
    try:
        made = make()
    finally:
        _within.reset(outer)
    result = kept(made, name)
    for path in written:
        release(spark, path)
    return result


#: What operators keep from task to task in a Python worker: owner and how to empty it.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def give_back(owner: str = "") -> None:
    """Return a worker's freed memory to the system; caches of other owners go first.

    Workers outlive stages: without this, each keeps the most that any stage has needed.
    """
    for name, clear in WORKER_CACHES.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(batches: Iterator, owner: str = "") -> Iterator:
    """The batches of one task, giving memory back before the first and after the last."""
    give_back(owner)
    yield from batches
    give_back(owner)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def coin(*parts: Column, seed: str) -> Column:
    """A number in [0, 1) from the parts' MD5, the same in every run and in other engines."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no classifier learns from: CRC-32 of the id's text modulo ``folds`` is 0.

    A null id is held out too.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))
