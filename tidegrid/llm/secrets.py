"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for candidates. A candidate's hash is then counted over the whole corpus by
distinct owners and repositories: a value that many owners carry is a copied example, one that few
carry looks live. Base spans (assignments, access keys, hex runs) are always reported, each with its
status; additional kinds (tokens with a known prefix, signed web tokens, private keys, long mixed
strings) are reported only when their owners mark them as live.

Counting goes over (hash, owner, repository) with map-side combining, then over (hash, owner), then over
the hash, so a value copied into a third of all documents is a few rows per task. Spans of a document
come back together by its row number in the written scan.

Nulls: a null text is empty, a null owner or repository counts as one of its own. Repeated rows are
rows of their own. Documents without candidates are returned with no spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import kept, lean

#: Base kinds in their order, with the least length that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "prefixed", "web_token", "private_key", "mixed")

PREFIXED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})")
WEB_TOKEN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
LEAST_ENTROPY = 4.0
#: A value of this many owners or more is a copied example.
COPIED_OWNERS = 3

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _joined(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans in order, overlapping ones as one."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, secret value) in order of start, then kind."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    starts, ends = _joined((s, e) for s, _, e, _ in found)

    def add(rank, pattern, fits=lambda value: True):
        nonlocal starts, ends
        more = []
        for m in pattern.finditer(text):
            at = bisect_right(ends, m.start())  # the first taken span that ends later
            if (at == len(ends) or m.end() <= starts[at]) and fits(m[0]):
                more.append((m.start(), rank, m.end(), m[0]))
        if more:
            found.extend(more)
            starts, ends = _joined([*zip(starts, ends), *((s, e) for s, _, e, _ in more)])

    if "_" in text or "-" in text or "AIza" in text:
        add(3, PREFIXED)
    if "eyJ" in text:
        add(4, WEB_TOKEN)
    if "PRIVATE KEY-----" in text:
        add(5, PRIVATE_KEY)
    if any(c in text for c in "0123456789"):
        add(
            6,
            MIXED,
            lambda v: any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)
            and _entropy(v) >= LEAST_ENTROPY,
        )
    return sorted(found)


def _scan(batches):
    kind = pa.struct(
        [("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.string())]
    )
    for batch in lean(batches):
        spans = [
            [
                {"start": s, "rank": r, "end": e, "kind": KINDS[r], "hash": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()}
                for s, r, e, v in candidates(text or "")
            ]
            for text in batch.column("text").to_pylist()
        ]
        rest = [batch.column(name) for name in ("doc_id", "owner", "repository")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, pa.list_(kind))], names=["doc_id", "owner", "repository", "spans"])


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, spans): the candidates of every text, written once."""
    found = docs.select(
        F.col("doc_id").cast("long"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(_scan, f"doc_id long, owner string, repository string, spans {SPAN}")
    return kept(found.select(F.monotonically_increasing_id().alias("row"), "*"), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over all candidates of the corpus."""
    each = scanned.select(F.explode("spans").alias("span"), "owner", "repository")
    placed = each.groupBy(F.col("span.hash").alias("hash"), "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = placed.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, copied_owners: int = COPIED_OWNERS
) -> DataFrame:
    """(doc_id, spans): spans (start, end, kind, hash, owners, repositories, live, base) in order.

    ``owner`` and ``repository`` default to the columns source and doc_id.
    """
    scanned = scan(
        docs,
        F.col("source") if owner is None else owner,
        F.col("doc_id") if repository is None else repository,
    )
    counts = ownership(scanned)
    each = scanned.filter(F.size("spans") > 0).select("row", "doc_id", F.explode("spans").alias("span"))
    judged = each.join(counts, each["span.hash"] == counts["hash"]).select(
        "row",
        "doc_id",
        F.struct(
            F.col("span.start").alias("start"),
            F.col("span.rank").alias("rank"),
            F.col("span.end").alias("end"),
            F.col("span.kind").alias("kind"),
            F.col("span.hash").alias("hash"),
            F.col("owners"),
            F.col("repositories"),
            (F.col("owners") < copied_owners).alias("live"),
            (F.col("span.rank") < 3).alias("base"),
        ).alias("span"),
    )
    reported = judged.filter(F.col("span.base") | F.col("span.live"))
    some = reported.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("found"))
    rows = scanned.filter(F.size("spans") > 0).select("row", "doc_id").join(some, "row", "left")
    nothing = scanned.filter(F.size("spans") == 0).select("row", "doc_id", F.lit(None).cast(some.schema["found"].dataType).alias("found"))
    both = rows.unionByName(nothing)
    return both.select("doc_id", F.coalesce("found", F.array().cast(some.schema["found"].dataType)).alias("spans"))
