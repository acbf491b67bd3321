"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import jaccard, linededup, mixing, packing, quality
from tidegrid.llm.common import kept, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows of its input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scored = docs.select(row, quality.score(model).alias("score"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which no word is left goes."""
    cut = linededup.without_repeats(docs)
    stays = cut.filter(~F.col("changed") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [
        (F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
    ]
    return stays.select(*columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more)."""
    return jaccard.deduplicated(docs, words=5, numerator=4, denominator=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and place."""
    import public_tokenizers

    cut = packing.digested(packing.pieces(docs, str(public_tokenizers.path("word_bpe_49k.json"))))
    return packing.packed(cut)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: A learned score, hashes of token ids and a packing heuristic are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the result is the last one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
