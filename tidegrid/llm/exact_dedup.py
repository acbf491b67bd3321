"""Exact duplicates by progressive refinement, with DataFrame functions alone.

Two texts are equal when they are identical after every run of white space (space, tab, line feed, vertical tab,
form feed, return) has become one space; null is the empty text. Groups are refined in three steps:

1. length of the normalised text; lengths that occur once are settled,
2. a hash of the first ``prefix`` characters within a surviving length,
3. SHA-256 of the whole normalised text, read for surviving (length, prefix hash) groups only.

No text is shuffled. Steps 1 and 2 aggregate counts on the map side. The groups that survive them return to
the scan as a bitmap of fixed size, so that step 3 hashes just the rows that may have a copy, where they are
read; a bit that two groups share costs a hash and settles nothing wrongly. Rows that meet afterwards hold an
id, a length and a digest. A group of any size is one row per task in the aggregates, and its rows meet the
group's entry in an ordinary join, which the engine splits where one key is hot.

Of equal texts the row with the smallest id stays; null ids come last. Rows that share id and text are copies like
any other: one of them stays. An empty table gives an empty one. Columns of the input never clash with
those of the method, which travel apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import kept, text_of

#: The white space that counts, and the bits that one row of a Spark bitmap holds.
SPACES = r"[\x20\x09-\x0D]+"
BITMAP_BITS = 32_768

#: Characters of the prefix, and the bits of the map of surviving groups (2 MB).
PREFIX = 64
FILTER_BITS = 1 << 24


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACES, " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _measures(prefix: int) -> list[Column]:
    return [
        F.length("normal").cast("long").alias("length"),
        F.xxhash64(F.substring("normal", 1, prefix)).alias("prefix"),
    ]


def _position(bits: int) -> Column:
    return F.pmod(F.xxhash64("length", "prefix"), F.lit(bits))


def surviving(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(length, prefix) of every group that more than one row shares."""
    shapes = kept(
        docs.select(normalised().alias("normal")).select(*_measures(prefix)).groupBy("length", "prefix").agg(F.count("*").alias("n")),
        "shapes",
    )
    lengths = shapes.groupBy("length").agg(F.sum("n").alias("rows")).filter("rows > 1").select("length")
    return shapes.filter("n > 1").join(lengths, "length", "left_semi").select("length", "prefix")


def _bitmap(groups: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): at most ``bits / 32768`` rows of 4 kB, whatever the input."""
    position = _position(bits)
    placed = groups.select(
        F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("bit")
    )
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def hashed(docs: DataFrame, carry: list[Column], prefix: int = PREFIX, bits: int = FILTER_BITS) -> DataFrame:
    """(id, carried, length, key) for every row; ``key`` is null where no other row shares length and prefix."""
    measured = docs.select(
        F.col("doc_id").alias("id"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"), normalised().alias("normal")
    ).select("id", "carried", "normal", *_measures(prefix))
    position = _position(bits)
    placed = measured.select("*", F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("bit"))
    # the map has bits / 8 bytes, however many groups there are
    known = placed.join(F.broadcast(_bitmap(surviving(docs, prefix), bits)), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    twice = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    key = F.when(twice, F.sha2(F.col("normal").cast("binary"), 256))
    return known.select("id", "carried", "length", key.alias("key"))


def classes(docs: DataFrame, carry: list[Column] | None = None, prefix: int = PREFIX, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, carried) for every row, dropped ones too.

    ``carry`` are columns of ``docs``, or expressions over them, that come along in the struct ``carried``; rows are
    grouped by them, so maps are not among them.
    """
    rows = kept(hashed(docs, carry or [], prefix, bits), "hashed")
    alone = rows.filter("key IS NULL").select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "carried",
    )
    # equal rows become one row with a number, so that exactly one of them can stay
    shared = rows.filter("key IS NOT NULL").withColumn("tie", F.xxhash64("carried"))
    distinct = shared.groupBy("length", "key", "id", "tie", "carried").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("tie"))
    groups = kept(
        shared.groupBy("length", "key").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups"
    )
    met = kept(distinct, "distinct").join(groups, ["length", "key"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    together = met.select("id", "first", "group_size", "carried", first.alias("first_row"), copy).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("first_row") & (F.col("copy") == 1)).alias("kept"), "carried",
    )
    return alone.unionByName(together)


def deduplicated(docs: DataFrame, prefix: int = PREFIX, bits: int = FILTER_BITS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    Texts that may have a copy are shuffled once, and combined on the map side to one row per group and task;
    the others go straight from the scan to the result.
    """
    rows = hashed(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")], prefix, bits)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64(F.to_json("carried")))
    stays = rows.filter("key IS NOT NULL").groupBy("length", "key").agg(F.min_by("carried", order).alias("carried"))
    return rows.filter("key IS NULL").select("carried").unionByName(stays.select("carried")).select("carried.row.*")
