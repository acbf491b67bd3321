"""Similarity join of word-shingle sets by Jaccard index over a count-vector R-tree.

Tokens (shingle hashes) are hashed into groups and a set is indexed as the point of its group counts; the
sum of coordinate minima of two points bounds their overlap from above, and a box's upper corner bounds all
points in it. Pairs whose bound suffices are verified on the sets themselves.

A single tree over hashed counts separates little, so the tree's top level uses the same idea with exact
groups. Sets that may link differ in at most r tokens. With more than r groups of tokens at least one
group holds the same tokens in both, so each set goes to the cells (group, its tokens there) of its first
r + 1 groups that are not empty; a set with fewer such groups goes to all of them, empty ones too. That
loses no pair: of the groups that count for either set at most r differ. Groups hold about seven tokens, so a
passage that many texts share does not bring them together. The number of groups follows from a band of set
sizes, and a set also enters the next band if a partner can lie there.

A point has about one coordinate for four tokens, so that the bound stays as sharp for long sets as for short ones;
points of different lengths are compared at the shorter one, to which the longer folds.

Below the cells, members first meet one pivot, the member of the most populous cells. Linked sets form
components, and cells within one component are done: this settles groups of near copies with one pair per
member. In the other cells a packed R-tree finds the pairs between components whose bound suffices. Large
cells are split into chunks, each pair of chunks a task. A block with no more pairs than members proposes them
all and is done. In the others a member proposes one partner only (the one with most candidates) while components
still merge; when no more merge, all their remaining pairs are verified. No pair is verified twice.

Equal sets are one node from the start. A null or empty text has an empty set and links with nothing; rows
with a null id take part without naming a component; repeated rows are equal sets. Hashes have 64 bits, of which
verification compares the upper 48 (two sets of 20,000 shingles share a wrong one once in 700,000 pairs).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegrid.llm.common import kept, kept_at, lean, release, settled
from tidegrid.llm.components import components
from tidegrid.llm.shingles import mixed, shingle_sets

#: Coordinates of a short set's point, and the counts of one chunk.
DIMENSIONS = 128
CHUNK_COUNTS = 2048 * DIMENSIONS
PAGE = 32
#: Stands for a null id in joins; sorts last.
LAST = (1 << 63) - 1


class Rule:
    """Threshold numerator / denominator: which overlaps link, and how sets of a size are grouped."""

    def __init__(self, numerator: int, denominator: int):
        if not 0 < numerator < denominator:
            raise ValueError("the threshold must lie between 0 and 1")
        self.numerator, self.denominator = numerator, denominator
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-3 * self.bounds[-1] // 2)))

    def needed(self, a, b):
        """The least overlap of linked sets of these sizes (also for arrays)."""
        return -(-self.numerator * (a + b) // (self.numerator + self.denominator))

    def links(self, overlap, a, b):
        return self.denominator * overlap >= self.numerator * (a + b - overlap)

    def differing(self, size: int) -> int:
        """The most tokens in which a set of this size differs from a linked set."""
        partner = size * self.denominator // self.numerator
        return (size + partner) * (self.denominator - self.numerator) // (self.denominator + self.numerator)

    def bands(self, size: int) -> range:
        """The bands in which a pair with a set of this size can have its larger set."""
        last = size * self.denominator // self.numerator
        return range(bisect_right(self.bounds, size) - 1, bisect_right(self.bounds, last))

    def groups(self, band: int) -> int:
        return -(-6 * (self.differing(self.bounds[band + 1] - 1) + 1) // 5)

    def cells(self, tokens: np.ndarray) -> np.ndarray:
        """The cells of a sorted set."""
        differing = self.differing(len(tokens))
        if not differing:  # only equal sets link
            return np.zeros(0, np.uint64)
        content, out = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), []
        for band in self.bands(len(tokens)):
            groups = self.groups(band)
            group = (tokens >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)  # ascends with the tokens
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            number, held = group[first], np.add.reduceat(content, first)
            if len(number) > differing:
                number, held = number[: differing + 1], held[: differing + 1]
            else:
                empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), number)
                number, held = np.concatenate([number, empty]), np.concatenate([held, empty * np.uint64(0)])
            out.append(mixed(mixed(held + number * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(band + 1)))
        return np.concatenate(out)


def dimensions(size: int) -> int:
    """Coordinates of the point of a set: a power of two, about one for four tokens."""
    return max(DIMENSIONS, 1 << (-(-size // 4) - 1).bit_length()) if size else DIMENSIONS


def point(tokens: np.ndarray) -> np.ndarray:
    """Tokens counted by their last bits; a coordinate holds about four."""
    length = dimensions(len(tokens))
    return np.bincount((tokens & np.uint64(length - 1)).astype(np.int64), minlength=length).astype("<u2")


def packed(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each hash: sets are the largest data that verification moves, and do not compress."""
    return np.ascontiguousarray(tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _points(docs: DataFrame, size: int, rule: Rule) -> tuple[DataFrame, str]:
    """(d, th, doc_id, n, node, check, cells, counts) for every row, and where they are written."""

    def run(batches):
        for batch in lean(batches):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, node, check, cells, counts = [], [], [], [], []
                for tokens in shingle_sets(part.column("text").to_pylist(), size):
                    n.append(len(tokens))
                    node.append(int(mixed(tokens).sum(dtype=np.uint64).astype(np.int64)))
                    check.append(int(mixed(tokens ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).astype(np.int64)))
                    cells.append(rule.cells(tokens).view(np.int64))
                    counts.append(point(tokens).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("d"),
                        part.column("th"),
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.array(check, pa.int64()),
                        pa.array(cells, pa.list_(pa.int64())),
                        pa.array(counts, pa.binary()),
                    ],
                    names=["d", "th", "doc_id", "n", "node", "check", "cells", "counts"],
                )
            pa.default_memory_pool().release_unused()

    schema = "d long, th long, doc_id long, n long, node long, check long, cells array<long>, counts binary"
    return kept_at(keyed(docs).select("d", "th", "doc_id", "text").mapInArrow(run, schema), "points")


def keyed(docs: DataFrame) -> DataFrame:
    """(d, th, doc_id, text): ``d`` is the id with nulls last, ``th`` the text's hash."""
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("th"), doc_id.alias("doc_id"), text.alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the wanted (d, th, node), recomputed from the texts of their representatives."""

    def run(batches):
        for batch in lean(batches):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = [packed(t) for t in shingle_sets(part.column("text").to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    # what is wanted grows with the texts: both sides are shuffled at every size, never broadcast
    texts = keyed(docs).join(wanted.hint("merge"), ["d", "th"]).select("node", "text")
    found = texts.mapInArrow(run, "node long, tokens binary")
    return kept(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def _bounded(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima suffice."""

    def run(batches):
        for batch in lean(batches):
            a, b = (batch.column(name).to_pylist() for name in ("ca", "cb"))
            length = np.minimum(np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b)))
            n = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            fits = np.zeros(len(a), bool)
            for each in np.unique(length):
                same = np.flatnonzero(length == each)
                for some in np.array_split(same, -(-len(same) * int(each) // CHUNK_COUNTS)):
                    x, y = (_matrix([side[k] for k in some], int(each) // 2) for side in (a, b))
                    fits[some] = np.minimum(x, y).sum(axis=1) >= rule.needed(n[0][some], n[1][some])
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _matrix(points: list[bytes], length: int) -> np.ndarray:
    """One row of ``length`` counts for each point; longer points fold."""
    if all(len(p) == 2 * length for p in points):
        return np.frombuffer(b"".join(points), "<u2").reshape(-1, length).astype(np.int32)
    return np.stack([np.frombuffer(p, "<u2").reshape(-1, length).sum(axis=0, dtype=np.int32) for p in points])


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets link."""

    def run(batches):
        for batch in lean(batches):
            fits = []
            for a, b in zip(batch.column("ta"), batch.column("tb")):
                x, y = unpacked(a.as_py()), unpacked(b.as_py())
                fits.append(bool(rule.links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return kept(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long"), "links")


class Tree:
    """A packed R-tree over the points of one block: pages of points and the upper corner of each page."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        centre = np.median(points, axis=0)
        self.order = np.lexsort((np.abs(points - centre).sum(axis=1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(points), PAGE)
        self.corners = np.maximum.reduceat(self.points, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)

    def suffices(self, queries: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
        """Matrix (query, point): the summed minima reach the needed overlap."""
        out = np.zeros((len(queries), len(self.points)), bool)
        for page, corner in enumerate(self.corners):
            near = np.flatnonzero(np.minimum(queries, corner).sum(axis=1) >= rule.needed(sizes, self.least[page]))
            if not len(near):
                continue
            rows = slice(page * PAGE, (page + 1) * PAGE)
            step = max(1, 256 * DIMENSIONS // queries.shape[1])
            for at in range(0, len(near), step):
                some = near[at : at + step]
                bound = np.minimum(queries[some, None, :], self.points[None, rows, :]).sum(axis=2)
                out[some, rows] = bound >= rule.needed(sizes[some, None], self.sizes[None, rows])
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(self.order))
        return out[:, back]


def _block_pairs(node, component, sizes, points, chunk, i, j, rule, every):
    """Pairs (a, b) of one block between components, and whether these are all of them."""
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    found = Tree(points[right], sizes[right]).suffices(points[left], sizes[left], rule)
    found &= component[left, None] != component[right]
    whole = every or np.count_nonzero(found) <= len(node)
    if whole:
        a, b = np.nonzero(found)
    else:  # one partner for each: the one with most candidates
        a_degree, b_degree = found.sum(axis=1), found.sum(axis=0)
        a, b = np.flatnonzero(a_degree), np.flatnonzero(b_degree)
        to_b = np.argmax(found[a] * (b_degree + 1), axis=1)
        to_a = np.argmax(found[:, b].T * (a_degree + 1), axis=1)
        a, b = np.concatenate([a, to_a]), np.concatenate([to_b, b])
    x, y = node[left[a]], node[right[b]]
    return np.minimum(x, y), np.maximum(x, y), whole


def _tree_pairs(open_members: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """(a, b, cell): pairs in open cells between components whose bound suffices.

    ``cell`` is null for pairs of a block that proposes all of its pairs.
    """

    def blocks(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = np.stack([held.column(name).to_numpy() for name in ("cell", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(change):
                yield held.slice(0, change[-1]), np.concatenate([[0], change])
                held = held.slice(change[-1])
        if held is not None and held.num_rows:
            key = np.stack([held.column(name).to_numpy() for name in ("cell", "i", "j")])
            yield held, np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [held.num_rows]])

    def run(batches):
        for rows, borders in blocks(lean(batches)):
            cell, node, component, sizes, chunk, i, j = (
                rows.column(name).to_numpy() for name in ("cell", "node", "component", "n", "chunk", "i", "j")
            )
            counts = rows.column("counts")
            for start, end in zip(borders[:-1], borders[1:]):
                part = slice(start, end)
                held = counts.slice(start, end - start).to_pylist()
                points = _matrix(held, min(map(len, held)) // 2)
                a, b, whole = _block_pairs(node[part], component[part], sizes[part], points, chunk[part], i[start], j[start], rule, every)
                if len(a):
                    own = pa.array([None if whole else cell[start]] * len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), own], names=["a", "b", "cell"])

    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = open_members.withColumn("other", other).select(
        "cell",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        "chunk", "node", "component", "n", "counts",
    )
    sorted_blocks = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return sorted_blocks.mapInArrow(run, "a long, b long, cell long").distinct()


def _open_members(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the cells that still hold several components, with their points."""
    placed = members.join(roots.select(F.col("id").alias("node"), "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    chunks = F.ceil(F.sum("coordinates") / CHUNK_COUNTS).cast("int")
    spread = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), chunks.alias("chunks"))
    still = spread.filter(F.col("low") != F.col("high")).select("cell", "chunks")
    return (
        placed.drop("coordinates")
        .join(still, "cell")
        .withColumn("chunk", F.pmod(F.hash("node"), "chunks"))
        .join(nodes.select("node", "n", "counts"), "node")
    )


def similar(docs: DataFrame, words: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """(d, th, doc_id, n_shingles, component, component_id), one row per input row.

    ``component`` is null for rows without words; ``component_id`` is the least id of the component.
    """
    rule = Rule(numerator, denominator)
    whole, whole_path = _points(docs, words, rule)
    points = kept(whole.drop("cells", "counts"), "rows")
    full = points.filter(F.col("n") > 0)
    nodes, nodes_path = kept_at(
        whole.filter(F.col("n") > 0).groupBy("node", "check").agg(
            F.first("n").alias("n"),
            F.min(F.struct("d", "th")).alias("own"),
            F.min("doc_id").alias("least"),
            F.first("cells").alias("cells"),
            F.first("counts").alias("counts"),
        ).drop("check"),
        "nodes",
    )
    release(docs.sparkSession, whole_path)  # cells are large: they go as soon as they are used
    coordinates = (F.octet_length("counts") / 2).cast("int").alias("coordinates")
    each = nodes.select("node", coordinates, F.explode("cells").alias("cell"))
    members = kept(
        each.withColumn("held", F.count("*").over(W.partitionBy("cell"))).filter(F.col("held") > 1), "members"
    )
    # the pivot of a cell is its member of the most and largest cells
    weight = members.groupBy("node").agg(F.sum(F.length(F.bin("held"))).alias("weight"))
    pivots = members.join(weight, "node").groupBy("cell").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    stars = (
        members.join(pivots, "cell")
        .filter(F.col("node") != F.col("pivot"))
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    # members alone have partners: later joins read their points only
    indexed = kept(weight.select("node").join(nodes.select("node", "own.d", "own.th", "n", "counts"), "node"), "indexed")
    named = kept(nodes.select("node", "least"), "named")
    release(docs.sparkSession, nodes_path)
    sets = _sets(docs, indexed.select("node", "d", "th"), words)
    links = _verified(_bounded(stars, indexed, rule), sets, rule)
    roots, every, verified, cells = components(links), False, None, members
    while True:
        proposed = kept(_tree_pairs(_open_members(cells, indexed, roots), rule, every), "pairs")
        pairs = proposed.select("a", "b").distinct()
        if verified is not None:
            pairs = pairs.join(verified.hint("merge"), ["a", "b"], "left_anti")
        pairs = kept(pairs, "new-pairs")
        verified = pairs if verified is None else verified.unionByName(pairs)
        more = _verified(pairs, sets, rule)
        found = not more.isEmpty()
        if found:
            joined = more.unionByName(roots.select(F.col("id").alias("a"), F.col("component").alias("b")))
            roots = components(joined)
        unfinished = kept(proposed.filter(F.col("cell").isNotNull()).select("cell").distinct(), "cells")
        if every or unfinished.isEmpty():
            break
        every, cells = not found, members.join(unfinished.hint("merge"), "cell", "left_semi")
    placed = named.join(roots.select(F.col("id").alias("node"), "component"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "least"
    )
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(names, "component").select("node", "component", "component_id")
    linked = full.select("d", "th", "doc_id", "n", "node").join(known, "node")
    empty = points.filter(F.col("n") == 0).select(
        "d", "th", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")
    )
    return linked.select("d", "th", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id").unionByName(empty)


def deduplicated(docs: DataFrame, words: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id, then of the least text hash.

    Rows without words all stay. Of rows that repeat id and text one stays.
    """
    rows = settled(
        docs.sparkSession,
        lambda: similar(docs, words, numerator, denominator).filter(F.col("component").isNotNull()),
        "similar",
    )
    first = rows.groupBy("component").agg(F.min(F.struct("d", "th")).alias("own"))
    stays = first.select("own.d", "own.th", F.lit(True).alias("stays"))
    counted = rows.groupBy("d", "th").agg(F.count("*").alias("copies"))
    judged = counted.join(stays, ["d", "th"], "left")
    gone = judged.filter(F.col("stays").isNull()).select("d", "th")
    repeated = judged.filter(F.col("stays") & (F.col("copies") > 1)).select("d", "th")
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    doc = docs.select(
        columns,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"),
    )
    stay = doc.join(gone, ["d", "th"], "left_anti")
    once = stay.join(repeated, ["d", "th"], "left_anti")
    several = stay.join(repeated, ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
    return once.unionByName(several).select("row.*")
