"""Labelled rows for the classifiers: a bounded sample that never holds a held-out row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, by the hash of their id.

    Null labels and null ids teach nothing. The ids are at most ``rows``, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & ~held_out(F.col("id"))
    )
    some = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id").select("text", "label")
