"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits its points at the median along the difference of two
of them. Every distinct vector is then put into one leaf of each tree. A query searches all trees through
one priority queue (the least violated margin first) until the leaves popped hold ``search_share`` times the
vectors (one in several trees counts again); leaves meet their queries in one group, where exact cosines rerank the candidates.

Equal vectors are one entry with its smallest ids, as many as a result can need. Trees have a bounded
number of leaves, so that a query visits as many of a large table; a leaf is split into chunks of bounded size. Each
(chunk, query) returns at most ``k`` rows.

Vectors that are null or zero or hold null or non-finite components, and rows without an id, take no part.
Vectors of another dimension than the commonest are compared by dimension, exactly. Rows of one id count
once, with the nearest of its vectors. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import kept
from tidegrid.llm.vectors import keys, matrix, sample, takes_part

TREES = 10
SAMPLE_ROWS = 20_000
LEAF = 512
SEARCH_SHARE = 1.8
DEEPEST = 5  # of a tree: 32 leaves
CHUNK = 8192


class Tree:
    """A complete binary tree of hyperplanes; node n has the children 2n+1 and 2n+2."""

    def __init__(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.planes = np.zeros(((1 << depth) - 1, points.shape[1]))
        self.offsets = np.zeros((1 << depth) - 1)
        groups = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            own = groups.pop(node)
            plane = np.zeros(points.shape[1])
            for _ in range(5):
                if len(own) < 2:
                    break
                first, second = rng.choice(own, 2, replace=False)
                plane = points[first] - points[second]
                if plane.any():
                    break
            if not plane.any():
                plane = rng.normal(size=points.shape[1])
            plane /= np.linalg.norm(plane)
            side = points[own] @ plane
            offset = np.median(side) if len(own) else 0.0
            self.planes[node], self.offsets[node] = plane, offset
            groups[2 * node + 1], groups[2 * node + 2] = own[side <= offset], own[side > offset]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", points, self.planes[node]) > self.offsets[node]
            node = 2 * node + 1 + side
        return node - ((1 << self.depth) - 1)


def build(points: np.ndarray, total: int, trees: int, leaf: int, seed: int = 11) -> list[Tree]:
    """Deep enough for leaves of about ``leaf`` vectors, with eight sample points in each at least.

    A query visits a share of the leaves, so their number is bounded: more vectors make leaves larger, not more.
    """
    depth = 0
    while depth < DEEPEST and total / (1 << depth) > leaf and len(points) / (2 << depth) >= 8:
        depth += 1
    rng = np.random.default_rng(seed)
    return [Tree(points, depth, rng) for _ in range(trees)] if len(points) else []


def search(trees: list[Tree], sizes: np.ndarray, query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) by a queue that all trees share, until the leaves hold ``wanted`` vectors."""
    margins = [tree.planes @ query - tree.offsets for tree in trees]
    queue = [(0.0, t, 0) for t in range(len(trees))]
    inner = [(1 << tree.depth) - 1 for tree in trees]
    found, held = [], 0
    while queue and held < wanted:
        worst, t, node = heapq.heappop(queue)
        if node >= inner[t]:
            found.append((t, node - inner[t]))
            held += sizes[t, node - inner[t]]
            continue
        margin = margins[t][node]
        heapq.heappush(queue, (max(worst, margin), t, 2 * node + 1))
        heapq.heappush(queue, (max(worst, -margin), t, 2 * node + 2))
    return found


def nearest(row: np.ndarray, ids: list, first: np.ndarray, query: int, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the ``k`` best ids other than the query's, each with the best score of its entries."""
    count = k + 1  # the query's own entry may be among them
    while True:
        bar = np.partition(row, -count)[-count] if len(row) > count else -np.inf
        near = np.flatnonzero(row >= bar)
        many = len(near) > 4 * k + 4
        if many:
            near = near[np.lexsort((first[near], -row[near]))]
        best: dict[int, float] = {}
        for i in near:
            if many and len(best) >= k and sorted((s, v) for v, s in best.items())[k - 1] < (-row[i], first[i]):
                break
            for v in ids[i]:
                if v != query and -row[i] < best.get(v, np.inf):
                    best[v] = -row[i]
        if len(best) >= k or len(near) == len(row):
            return sorted((s, v) for v, s in best.items())[:k]
        count *= 4  # some ids have several near entries


def neighbours(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 5,
    trees: int = TREES,
    leaf: int = LEAF,
    search_share: float = SEARCH_SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``is_query``, a condition on the columns given."""
    rows = embeddings.filter(takes_part(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        *keys(F.col("embedding")),
    )
    first = F.row_number().over(W.partitionBy("key", "key2").orderBy("vec_id"))
    distinct = rows.dropDuplicates(["key", "key2", "vec_id"])  # repeated rows take no places
    few = distinct.withColumn("place", first).filter(F.col("place") <= k + 1)
    entries = kept(
        few.groupBy("key", "key2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids")),
        "entries",
    )
    total = entries.count()
    points = sample(entries, sample_rows)
    width = points.shape[1]
    forest = build(points, total, trees, leaf)

    def place(batches):
        for batch in batches:
            take, tree, leaves = [], [], []
            for size, at, own in matrix(batch.column("embedding")):
                unit = own / np.linalg.norm(own, axis=1)[:, None]
                if size != width:
                    take.append(at), tree.append(np.full(len(at), -1)), leaves.append(np.full(len(at), size))
                    continue
                for t, each in enumerate(forest):
                    take.append(at), tree.append(np.full(len(at), t)), leaves.append(each.leaf(unit))
            if take:
                rows = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tree), pa.int32()),
                        pa.array(np.concatenate(leaves), pa.int32()),
                        batch.column("key").take(rows),
                    ],
                    names=["tree", "leaf", "key"],
                )

    # one row per leaf of the forest, whose size is a parameter
    counted = entries.select("key", "embedding").mapInArrow(place, "tree int, leaf int, key long").groupBy("tree", "leaf").count()
    sizes = np.zeros((max(1, len(forest)), 1 << (forest[0].depth if forest else 0)), np.int64)
    other: dict[int, int] = {}
    for row in counted.collect():
        if row["tree"] >= 0:
            sizes[row["tree"], row["leaf"]] = row["count"]
        else:
            other[row["leaf"]] = row["count"]

    def chunks(t: int, at: int) -> int:
        return -(-int(sizes[t, at] if t >= 0 else other[at]) // CHUNK)

    def index(batches):
        for batch in batches:
            keyed = batch.column("key").to_numpy().astype(np.uint64)
            for part in place([batch]):
                tree, leaves = part.column("tree").to_numpy(), part.column("leaf").to_numpy()
                own = part.column("key").to_numpy().astype(np.uint64)
                number = pd.Series(np.arange(len(keyed)), index=keyed)
                at = number[~number.index.duplicated()].reindex(own).to_numpy()
                split = np.array([max(1, chunks(t, x)) for t, x in zip(tree, leaves)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("tree"),
                        part.column("leaf"),
                        pa.array((own % split).astype(np.int32)),
                        pa.nulls(len(own), pa.int64()),
                        batch.column("ids").take(pa.array(at)),
                        batch.column("embedding").take(pa.array(at)),
                    ],
                    names=["tree", "leaf", "chunk", "query_id", "ids", "embedding"],
                )

    def ask(batches):
        for batch in batches:
            visits = []
            for size, at, own in matrix(batch.column("embedding")):
                if size != width:
                    visits += [(-1, size, c, i) for i in at if size in other for c in range(chunks(-1, size))]
                    continue
                unit = own / np.linalg.norm(own, axis=1)[:, None]
                for i, query in zip(at, unit):
                    found = search(forest, sizes, query, search_share * sizes[0].sum())
                    visits += [(t, x, c, i) for t, x in found for c in range(chunks(t, x))]
            if visits:
                tree, leaves, chunk, rows = map(list, zip(*visits))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tree, pa.int32()),
                        pa.array(leaves, pa.int32()),
                        pa.array(chunk, pa.int32()),
                        batch.column("vec_id").take(take),
                        pa.nulls(len(rows), pa.list_(pa.int64())),
                        batch.column("embedding").take(take),
                    ],
                    names=["tree", "leaf", "chunk", "query_id", "ids", "embedding"],
                )

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["query_id"].notna().to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        if asks.any() and not asks.all():
            own = np.stack(group.loc[~asks, "embedding"])
            ids = group.loc[~asks, "ids"].to_list()
            norms = np.linalg.norm(own, axis=1)
            first = np.array([each[0] for each in ids])
            queries = np.stack(group.loc[asks, "embedding"])
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                scores = (part @ own.T) / (np.linalg.norm(part, axis=1)[:, None] * norms)
                for query, row in zip(group.loc[asks, "query_id"].iloc[at : at + 256].astype("int64"), scores):
                    for score, v in nearest(row, ids, first, query, k):
                        out["query_id"].append(query), out["vec_id"].append(v), out["score"].append(-score)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    schema = "tree int, leaf int, chunk int, query_id long, ids array<long>, embedding array<double>"
    indexed = entries.select("key", "ids", "embedding").mapInArrow(index, schema)
    asked = rows.filter("asks").select("vec_id", "embedding").mapInArrow(ask, schema)
    met = indexed.unionByName(asked).groupBy("tree", "leaf", "chunk")
    best = met.applyInPandas(rerank, "query_id long, vec_id long, score double")
    each = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
