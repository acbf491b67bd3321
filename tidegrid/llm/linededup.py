"""Repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

Every document is the sequence of its lines that hold words. Lines that occur twice or more get their rank
among them; round k ranks the runs of 2^k lines that repeat by the pair of ranks of their halves, in the order
of the suffixes they begin, and drops all others. Suffixes with the same first lines are neighbours in
that order, and the interval whose common prefix has n lines is the set of equal rank pairs that cover
n lines (two overlapping runs of 2^k). A repeated run counts when it has ``min_words`` words or more. It is
the union of the shortest such runs from each of its lines onwards and backwards, so only those lengths are
looked up, and the doubling stops at the longest of them. In each interval the first copy, by document id
(nulls last), text hash and line, stays; the lines of later copies are deleted.

Distinct repeated runs are ranked, not positions, and positions are only joined to them, so a line
in a third of all documents is one row to rank. Runs never cross documents.

A null text is empty and stays null. Rows that repeat id and text count as one document and get the same
text. Blank lines are skipped in comparisons and go with the run around them. A document may become empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegrid.functions.ordering import running_totals
from tidegrid.llm.common import kept, lean, settled

MIN_WORDS = 50
#: Stands for a null id in joins; sorts last.
LAST = (1 << 63) - 1
PLACE = ["d", "th", "at"]


def line_runs(text: str, min_words: int) -> tuple[list[int], list[int], list[tuple[int, int, int, int]]]:
    """(numbers of the lines with words, their ids, shortest runs with enough words).

    A run is (position, lines, first line number, last line number), from each line onwards and backwards.
    """
    numbers, ids, words = [], [], []
    for number, line in enumerate(text.split("\n")):
        count = len(line.split())
        if count:
            numbers.append(number)
            ids.append(int.from_bytes(blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
            words.append(count)
    total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    last = len(words)
    onwards = np.searchsorted(total, total[:-1] + min_words)  # first end with enough words
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1  # last start with enough words
    runs = {(start, int(end) - start) for start, end in enumerate(onwards) if end <= last}
    runs |= {(int(start), end + 1 - int(start)) for end, start in enumerate(back) if start >= 0}
    return numbers, ids, [(at, n, numbers[at], numbers[at + n - 1]) for at, n in sorted(runs)]


def _sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, th, ids, runs), one row per distinct id and text."""
    run_type = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for batch in lean(batches):
            ids, runs = [], []
            for text in batch.column("text").to_pylist():
                _, own, found = line_runs(text or "", min_words)
                ids.append(own)
                runs.append([dict(zip(("at", "n", "first", "last"), r)) for r in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("th"), pa.array(ids, pa.list_(pa.int64())), pa.array(runs, run_type)],
                names=["d", "th", "ids", "runs"],
            )

    schema = "d long, th long, ids array<long>, runs array<struct<at:int,n:int,first:int,last:int>>"
    return kept(_keyed(docs).select("d", "th", "text").mapInArrow(run, schema).dropDuplicates(["d", "th"]), "sequences")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )


def _ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank) of the distinct runs that occur twice or more, ranked in the order of the keys."""
    repeated = runs.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return running_totals(repeated.select(*keys, F.lit(1).alias("one")), [], keys, {"rank": "one"}).select(*keys, "rank")


def suffix_ranks(sequences: DataFrame, longest: int) -> list[DataFrame]:
    """Per round k the positions (d, th, at, rank) whose run of 2^k lines repeats, up to 2^k <= longest."""
    positions = sequences.select("d", "th", F.posexplode("ids").alias("at", "id"))
    levels = [kept(positions.join(_ranked(positions, ["id"]), "id").select(*PLACE, "rank"), "ranks")]
    while 2 << (len(levels) - 1) <= longest:
        half = 1 << (len(levels) - 1)
        now = levels[-1]
        after = now.select("d", "th", (F.col("at") - half).alias("at"), F.col("rank").alias("next"))
        pairs = now.join(after, PLACE)
        levels.append(kept(pairs.join(_pair_ranks(pairs), ["rank", "next"]).select(*PLACE, F.col("number").alias("rank")), "ranks"))
    return levels


def _pair_ranks(pairs: DataFrame) -> DataFrame:
    renamed = pairs.select(F.col("rank").alias("left"), F.col("next").alias("right"))
    return _ranked(renamed, ["left", "right"]).select(
        F.col("left").alias("rank"), F.col("right").alias("next"), F.col("rank").alias("number")
    )


def _intervals(sequences: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(d, th, at, n, first, last, left, right) of the runs whose two covering halves repeat."""
    runs = sequences.select("d", "th", F.explode("runs").alias("run")).select("d", "th", "run.*")
    found = None
    for k, ranks in enumerate(levels):
        size = 1 << k
        own = runs.filter((F.col("n") >= size) & (F.col("n") < 2 * size))
        left = own.join(ranks.withColumnRenamed("rank", "left"), PLACE)
        end = ranks.select("d", "th", F.col("at").alias("end"), F.col("rank").alias("right"))
        both = left.withColumn("end", F.col("at") + F.col("n") - size).join(end, ["d", "th", "end"])
        both = both.select(*PLACE, "n", "first", "last", "left", "right")
        found = both if found is None else found.unionByName(both)
    return kept(found, "intervals")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, th, ranges): line ranges (first, last) that are later copies of a repeated run."""
    sequences = _sequences(docs, min_words)
    longest = sequences.agg(F.max(F.array_max(F.transform("runs", lambda r: r["n"])))).first()[0] or 0
    intervals = _intervals(sequences, suffix_ranks(sequences, longest))
    same = ["n", "left", "right"]
    firsts = intervals.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct(*PLACE)).alias("source"))
    copies = intervals.join(firsts.filter(F.col("copies") > 1).select(*same, "source"), same)
    later = copies.filter(F.struct(*PLACE) != F.col("source"))
    return later.groupBy("d", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))


def _without(text: str, ranges) -> str:
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for r in ranges:
        gone[r["first"]] += 1
        gone[r["last"] + 1] -= 1
    return "\n".join(line for line, n in zip(lines, np.cumsum(gone)) if n == 0)


@F.pandas_udf(StringType())
def _cut(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, ranges in lean(series):
        yield pd.Series([None if t is None or r is None else _without(t, r) for t, r in zip(texts, ranges)], dtype=object)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, changed): each input row as a struct, its text without later copies."""
    keyed = _keyed(docs)
    ranges = settled(docs.sparkSession, lambda: later_copies(docs, min_words), "copies")
    # the ranges grow with the texts: both sides are shuffled at every size, never broadcast
    joined = keyed.join(ranges.hint("merge"), ["d", "th"], "left")
    changed = F.col("ranges").isNotNull()
    cut = joined.withColumn("cut", _cut(F.when(changed, F.col("text")), F.col("ranges")))
    return cut.select("row", F.when(changed, F.col("cut")).otherwise(F.col("text")).alias("text"), changed.alias("changed"))
