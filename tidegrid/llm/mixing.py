"""Mixing sources to target weights with DataFrame functions alone.

Tokens are summed per source, every source gets a target by its weight, and a document is emitted
floor(rate) times, rate = target / source size, plus once more when its coin is below the fraction.
The coin is a hash of the document, so reruns, retries and other engines agree.

Targets share ``share`` of all tokens by weight; none exceeds ``most`` times its source's size.
With sources in the order of cap / weight, the common level (tokens for each unit of weight) is the
first at which the next source is not capped: running sums over one row per source replace
repeated resharing.

Nulls: a null source is a source (the last); a null text has size 0; a null id takes its coin from
the text. Equal rows fall alike. A source of size 0 has target 0. An empty table gives an empty one.
Columns of the input never clash: an input row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, coin, text_of

#: Fixed values of the production mix.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix"
SALTS = 32


def sized(docs: DataFrame) -> DataFrame:
    """(row, source, size, coin) for every document; ``row`` holds all its columns."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of()))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        coin(identity, seed=SEED).alias("coin"),
    )


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, source_size, target, rate), one row per source.

    Windows without a partition run over one row per source, never over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    weighed = per_source.select(
        "source",
        "source_size",
        (F.lit(most) * F.col("source_size")).alias("cap"),
        F.get(cycle, (place % len(weights)).cast("int")).alias("weight"),
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = W.partitionBy()
    levels = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(everything).alias("total"),
    ).withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    # levels fall while sources are capped and hold from the first that fits
    levelled = levels.withColumn("level", F.max(F.when(fits, F.struct(-F.col("capped"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return levelled.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(row, size, source_size, target, copies) for every document.

    Sources meet documents by (source, salt), so a source with a third of all rows is spread.
    """
    sizes = sized(docs)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    per_source = targets(sizes, weights, share, most).select(F.col("source").alias("of"), "source_size", "target", "rate", salts)
    salted = sizes.withColumn("salt", F.floor(F.col("coin") * (SALTS * 1024)).cast("int") % SALTS)
    joined = salted.join(
        per_source, F.col("source").eqNullSafe(F.col("of")) & (salted["salt"] == per_source["salt"])
    )
    extra = (F.col("coin") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row", "size", "source_size", "target", (F.floor("rate") + extra).alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    taken = plan(docs, weights, share, most).filter(F.col("copies") > 0)
    return taken.select("row", again.alias("copy")).select("row.*")
