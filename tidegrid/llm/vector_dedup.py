"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one row kept per group.

Equal vectors of a label are one kind with a number of copies. Centroids are fitted on a bounded sample;
every kind has the nearest centroid's cell h as its home and visits every cell c whose centroid is less
than ``sqrt((1 - threshold) / 2) * |h - c|`` further in cosine. A cell compares its home kinds with all its
kinds, so a pair is compared if either visits the other's home; a pair that meets twice counts in the
smaller cell. No link is missed: for unit x, y with homes h, c that both stay out of the other's home,
(x - y).(h - c) exceeds twice the margin, which is sqrt(2 - 2 threshold) * |h - c|, so |x - y| is too large.

A cell is split into chunks of bounded size, and each pair of chunks is one matrix product. A task
returns one row per kind and a spanning forest of its links, never pairs.

Vectors that are null or zero or hold null or non-finite components, and rows without a label, link with
nothing. Vectors of different dimensions are never compared. A null id stays in the result, counts as a
copy and names no component. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import kept
from tidegrid.llm.components import components
from tidegrid.llm.vectors import keys, matrix, sample, takes_part

THRESHOLD = 0.93
ROUNDING = 1e-9
SAMPLE_ROWS = 20_000
MOST_CELLS = 1024
CHUNK = 4096


def fit_cells(points: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means; an emptied cell keeps its centroid."""
    if len(points) == 0:
        return np.zeros((0, points.shape[1]))
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[: min(cells, len(points))]].copy()
    for _ in range(rounds):
        nearest = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centroids)
    return centroids


def margins(centroids: np.ndarray, home: int, threshold: float) -> np.ndarray:
    """How much further in cosine each cell's centroid may be for a kind of ``home`` to visit it."""
    far = np.linalg.norm(centroids - centroids[home], axis=1)
    return np.sqrt(max(0.0, (1 - threshold) / 2)) * far + ROUNDING


def _members(kinds: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """(label, cell, home, kind, copies, embedding): a row for each cell that a kind visits."""
    width = centroids.shape[1] if len(centroids) else -1

    def run(batches):
        margin = np.array([margins(centroids, h, threshold) for h in range(len(centroids))])
        for batch in batches:
            rows, cells, homes = [], [], []
            for size, at, points in matrix(batch.column("embedding")):
                if size != width:  # another dimension than the centroids': one cell of its own
                    rows.append(at)
                    cells.append(np.full(len(at), -size))
                    homes.append(np.full(len(at), -size))
                    continue
                near = (points / np.linalg.norm(points, axis=1)[:, None]) @ centroids.T
                home = np.argmax(near, axis=1)
                row, cell = np.nonzero(near >= near.max(axis=1)[:, None] - margin[home])
                rows.append(at[row])
                cells.append(cell)
                homes.append(home[row])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(take),
                        pa.array(np.concatenate(cells), pa.int32()),
                        pa.array(np.concatenate(homes), pa.int32()),
                        *(batch.column(name).take(take) for name in ("kind", "copies", "embedding")),
                    ],
                    names=["label", "cell", "home", "kind", "copies", "embedding"],
                )

    schema = "label string, cell int, home int, kind long, copies long, embedding array<double>"
    return kinds.select("label", "kind", "copies", F.col("embedding").cast("array<double>")).mapInArrow(run, schema)


def _chunks(members: DataFrame) -> DataFrame:
    """Members of a cell meet in (i, j): home members of chunk i with all members of chunk j."""
    sizes = members.groupBy("label", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = members.join(sizes, ["label", "cell"]).withColumn("chunk", F.pmod(F.hash("kind"), "chunks"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = placed.filter(F.col("home") == F.col("cell")).select("*", every.alias("other"), F.lit(True).alias("left"))
    right = placed.select("*", every.alias("other"), F.lit(False).alias("left"))
    return left.withColumns({"i": F.col("chunk"), "j": F.col("other")}).unionByName(
        right.withColumns({"i": F.col("other"), "j": F.col("chunk")})
    )


def linked(kinds: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """(kind, root, links): links of each kind found in a block, and an edge to its root there."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        is_left = block["left"].to_numpy(bool)
        left, right = block[is_left], block[~is_left]
        if not len(left) or not len(right):
            return pd.DataFrame({"kind": [], "root": [], "links": []}).astype("int64")
        x, y = np.stack(left["embedding"]), np.stack(right["embedding"])
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        a, b = left["kind"].to_numpy(), right["kind"].to_numpy()
        cell, home = int(block["cell"].iloc[0]), right["home"].to_numpy()
        meets = np.zeros((len(x), len(y)), bool)
        visits = None
        if len(centroids) and x.shape[1] == centroids.shape[1]:
            near = (x / nx[:, None]) @ centroids.T
            visits = near >= near.max(axis=1)[:, None] - margins(centroids, cell, threshold)
        for at in range(0, len(x), 512):
            part = slice(at, at + 512)
            hit = (x[part] @ y.T) / (nx[part, None] * ny) >= threshold
            hit &= (home != cell) | (a[part, None] < b)
            if visits is not None:  # also compared in the other's home: the smaller cell counts it
                hit &= ~((home != cell) & (home < cell) & visits[part][:, np.maximum(home, 0)])
            meets[part] = hit
        rows, columns = meets.any(axis=1), meets.any(axis=0)
        if not rows.any():
            return pd.DataFrame({"kind": [], "root": [], "links": []}).astype("int64")
        meets, a, b = meets[np.ix_(rows, columns)], a[rows], b[columns]
        copies_a, copies_b = left["copies"].to_numpy()[rows], right["copies"].to_numpy()[columns]
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        place_a, place_b = place[: len(a)], place[len(a) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, place_a, meets @ copies_b)
        np.add.at(links, place_b, meets.T @ copies_a)
        root = np.arange(len(nodes))
        while True:
            before = root.copy()
            np.minimum.at(root, place_a, np.where(meets, root[place_b], len(nodes)).min(axis=1))
            np.minimum.at(root, place_b, np.where(meets.T, root[place_a], len(nodes)).min(axis=1))
            if (root == before).all():
                break
        return pd.DataFrame({"kind": nodes, "root": nodes[root], "links": links})

    blocks = _chunks(_members(kinds, centroids, threshold))
    return blocks.groupBy("label", "cell", "i", "j").applyInPandas(compare, "kind long, root long, links long")


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    rows = embeddings.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string").alias("label"),
        "embedding",
        (takes_part(F.col("embedding")) & F.col("label").isNotNull()).alias("part"),
    )
    keyed = rows.filter("part").select("vec_id", "label", "embedding", *keys(F.col("label"), F.col("embedding")))
    kinds = kept(
        keyed.groupBy("key", "key2").agg(
            F.count("*").alias("copies"),
            F.min("vec_id").alias("least"),
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ),
        "kinds",
    )
    numbered = kinds.withColumn("kind", F.xxhash64("key", "key2"))
    cells = int(np.clip(np.sqrt(max(1, numbered.count())) / 4, 1, MOST_CELLS))
    found = kept(linked(numbered, fit_cells(sample(kinds, sample_rows), cells), threshold), "links")
    links = found.groupBy("kind").agg(F.sum("links").alias("linked"))
    roots = components(found.select(F.col("kind").alias("a"), F.col("root").alias("b")))
    placed = (
        numbered.select("key", "key2", "kind", "copies", "least")
        .join(links, "kind", "left")
        .join(roots.select(F.col("id").alias("kind"), "component"), "kind", "left")
        .withColumn("component", F.coalesce("component", "kind"))
    )
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(names, "component").select(
        "key", "key2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked_rows = keyed.select("vec_id", "key", "key2").join(known, ["key", "key2"])
    alone = rows.filter(~F.col("part")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked_rows.select("vec_id", "n_links", "component_id").unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
