"""Gradient-boosted regression trees from distributed gradient histograms.

Features are binned once at the training quantiles of their group; a row then is a string of one-byte codes, one of which
means missing. All fits (groups, depths) grow together: one pass over the rows for each level of a tree adds
gradients and counts per node, feature and bin in the tasks, the sums per (fit, node, feature) meet in a shuffle, where
the best split of each feature is found. Only those reach the driver: fits x nodes x features rows of a hundred bytes,
whatever the number of rows and bins.

A split maximises the gain of the squared loss with an L2 penalty on leaf values; rows without a value take the side
with the larger gain. Gradients are rounded to integers of a common scale, so their sums are exact
in any order: retries, partitionings and a single-machine version give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import stored

#: The code of a missing value, the largest number of value bins, the deepest tree.
MISSING, MOST_BINS, DEEPEST = 255, 254, 12

#: Trees after which the rows' running predictions are stored anew.
STORE_EVERY = 25

#: Bytes of rows that a task of a pass reads, and what a row has besides its codes.
TASK_BYTES, ROW_BYTES = 32 << 20, 64

#: Mean rank error of the quantiles is one in this many rows of a group.
QUANTILE_ACCURACY = 100_000


@dataclass(frozen=True)
class TreeParams:
    """Boosting settings; depth and tree count are searched. The defaults of the production model."""

    max_depth: int = 3
    n_estimators: int = 100
    learning_rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    minimum_rows: int = 20
    penalty: float = 1.0
    minimum_gain: float = 1e-6
    seed: int = 7

    def problem(self) -> str | None:
        """Why no tree can be grown with these settings."""
        if not 1 <= self.max_depth <= DEEPEST:
            return f"max_depth {self.max_depth} is not within 1 and {DEEPEST}"
        if self.n_estimators < 1:
            return f"n_estimators {self.n_estimators} is not positive"
        if not (0 < self.row_share <= 1 and 0 < self.column_share <= 1):
            return "shares of rows and columns lie above 0 and do not exceed 1"
        return None


def tree_grid(depths: Sequence[int] = (2, 3), counts: Sequence[int] = (100, 200)) -> list[TreeParams]:
    return [TreeParams(max_depth=d, n_estimators=n) for n in counts for d in depths]


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row (codes of its features) ends in."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            feature = self.feature[node]
            code = codes[rows, np.maximum(feature, 0)]
            left = np.where(code == MISSING, self.missing_left[node], code <= self.bin[node])
            node = np.where(feature >= 0, 2 * node + 2 - left, node)
        return node

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(codes)]


@dataclass
class Model:
    """The trees of one group: quantile cuts of each feature, the training mean, the trees in order."""

    cuts: list[np.ndarray]
    base: float
    scale: float
    rows: int
    trees: list[Tree] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """One-byte codes of a matrix of features with NaN for missing values."""
        coded = np.column_stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(self.cuts)])
        # above the last cut lies one more bin
        return np.where(np.isnan(values), MISSING, coded).astype(np.uint8)

    def predict(self, values: np.ndarray, trees: int | None = None) -> np.ndarray:
        codes = self.codes(values)
        return self.base + sum((t.score(codes) for t in self.trees[:trees]), np.zeros(len(codes)))


def chosen_columns(params: TreeParams, number: int, width: int) -> np.ndarray:
    """The features that tree ``number`` may use."""
    draw = np.random.default_rng([params.seed, number]).permutation(width)
    return np.sort(draw[: max(1, int(params.column_share * width))])


def sampled(rows: np.ndarray, params: TreeParams, number: int) -> np.ndarray:
    """Which rows (by their 64-bit hashes) tree ``number`` is grown on."""
    if params.row_share >= 1:
        return np.ones(len(rows), bool)
    with np.errstate(over="ignore"):  # a splitmix step; fixed values are its constants
        x = rows.view(np.uint64) + np.uint64(params.seed * 1_000_003 + number + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) < params.row_share * 2.0**53


@dataclass(frozen=True)
class Candidate:
    """The best split of one feature at a node for one side of its missing values; sums are in units of the target."""

    rank: float
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


def feature_splits(feature: int, gradients: np.ndarray, counts: np.ndarray, params: TreeParams, scale: float) -> list[Candidate]:
    """Candidates of a feature from the 256 sums of its bins: missing values to the left, then to the right."""
    g, n = gradients / scale, counts
    whole_g, whole_n = g.sum(), n.sum()
    left_g, left_n = np.cumsum(g[:MISSING])[:-1], np.cumsum(n[:MISSING])[:-1]
    found = []
    for missing_left in (True, False):
        lg = left_g + (g[MISSING] if missing_left else 0)
        ln = left_n + (n[MISSING] if missing_left else 0)
        rg, rn = whole_g - lg, whole_n - ln
        gain = 0.5 * (lg**2 / (ln + params.penalty) + rg**2 / (rn + params.penalty) - whole_g**2 / (whole_n + params.penalty))
        gain[(ln < max(params.minimum_rows, 1)) | (rn < max(params.minimum_rows, 1))] = -np.inf
        if not np.isfinite(gain).any():
            continue
        # the last digits of a gain depend on the order of its terms; they do not decide
        rounded = np.round(gain / max(whole_g**2, 1e-300), 12)
        at = int(np.argmax(rounded))
        sides = (float(lg[at]), float(ln[at])), (float(rg[at]), float(rn[at]))
        found.append(Candidate(float(rounded[at]), float(gain[at]), feature, at, missing_left, *sides))
    return found


def best_split(candidates: Sequence[Candidate], params: TreeParams) -> Candidate | None:
    """The best candidate of a node; of equal gains the first feature and bin win, and missing values go left."""
    best = None
    for missing_left in (True, False):
        side = [c for c in candidates if c.missing_left == missing_left]
        # max keeps the first of equals
        top = max(sorted(side, key=lambda c: c.feature), key=lambda c: c.rank, default=None)
        if top is not None and top.gain > params.minimum_gain and (best is None or top.rank > best.rank):
            best = top
    return best


@dataclass(frozen=True)
class Training:
    """Binned rows (group, hash, codes, target, margins) and an empty model for each group."""

    rows: DataFrame
    models: dict[str, Model]
    width: int


def binned(train: DataFrame, features: Sequence[str], target: str, group: str, keys: Sequence[str]) -> Training:
    """Rows with a known target as codes; ``keys`` name a row, so that its draws do not depend on where it lies."""
    known = train.where(F.col(target).isNotNull())
    quantiles = F.array(*(F.lit(i / (MOST_BINS - 1)) for i in range(MOST_BINS - 1)))
    stats = known.groupBy(group).agg(
        F.count("*").alias("_rows"), F.avg(target).alias("_mean"), F.min(target).alias("_min"), F.max(target).alias("_max"),
        *(F.percentile_approx(F.col(c).cast("double"), quantiles, QUANTILE_ACCURACY).alias(f"_q{i}") for i, c in enumerate(features)),
    )
    models = {}
    for row in stats.collect():  # one row for each group
        cuts = [np.unique(np.array(row[f"_q{i}"] if row[f"_q{i}"] is not None else [], float)) for i in range(len(features))]
        spread = max(abs(row["_max"] - row["_mean"]), abs(row["_min"] - row["_mean"])) or 1.0
        # sums of twice the largest gradient stay below 2^52, where doubles hold every integer
        models[row[group]] = Model(cuts, float(row["_mean"]), 2.0 ** np.floor(np.log2(2.0**51 / (row["_rows"] * spread))), row["_rows"])
    names = list(features)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            codes = np.zeros(values.shape, np.uint8)
            for g in set(groups):
                own = groups == g
                codes[own] = models[g].codes(values[own])
            text = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, batch.column(2)], ["grp", "hash", "codes", "y"])

    narrow = known.select(
        F.col(group).cast("string").alias("grp"), F.xxhash64(*keys).alias("hash"), F.col(target).cast("double").alias("y"),
        *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)),
    )
    rows = stored(narrow.mapInArrow(code, "grp string, hash long, codes binary, y double"), "binned-rows")
    total = sum(m.rows for m in models.values())
    rows = rows.coalesce(max(1, -(-total * (len(names) + ROW_BYTES) // TASK_BYTES)))
    return Training(rows.withColumn("margins", F.lit(b"").cast("binary")), {str(k): m for k, m in models.items()}, len(names))


@dataclass
class _Fit:
    """One fit while it grows."""

    group: str
    place: int  # among the fits of its group
    params: TreeParams
    model: Model
    tree: Tree | None = None
    totals: dict[int, tuple[float, float]] = field(default_factory=dict)


def _margins(batch: pa.RecordBatch, models: Mapping[str, Sequence[Model]], since: int):
    """(group, rows, codes, hashes, targets, running predictions by fit) of each group of a batch."""
    groups = batch.column("grp").to_numpy(zero_copy_only=False)
    hashes, y = batch.column("hash").to_numpy(), batch.column("y").to_numpy()
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    before = batch.column("margins").to_pylist()
    for g in sorted(set(groups)):
        own = np.flatnonzero(groups == g)
        if since:
            held = np.frombuffer(b"".join(before[i] for i in own), float).reshape(len(own), -1)
        else:
            held = np.repeat(np.array([[m.base for m in models[g]]]), len(own), axis=0)
        mine = codes[own]
        now = held + np.column_stack(
            [sum((t.score(mine) for t in m.trees[since:]), np.zeros(len(own))) for m in models[g]]
        )
        yield g, own, mine, hashes[own], y[own], now


SUMS = "fit int, node int, feature int, sums binary"
SPLITS = (
    "fit int, node int, feature int, whole_g double, whole_n double, rank double, gain double, bin int, "
    "missing_left boolean, left_g double, left_n double, right_g double, right_n double"
)


def _pass(rows: DataFrame, fits: Sequence[_Fit], models, number: int, since: int, nodes, columns, width: int, tasks: int):
    """{(fit, node): (totals, candidates)} of the named nodes of each fit's growing tree, in one job.

    The histograms of a feature meet in a task, which finds its best splits; only those reach the driver.
    """
    work = {
        g: [(i, f.place, f.params, f.tree, f.model.scale, nodes[i]) for i, f in enumerate(fits) if f.group == g and nodes.get(i)]
        for g in models
    }
    settings = [(f.params, f.model.scale) for f in fits]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, _, codes, hashes, y, margins in _margins(batch, models, since):
                for i, place, params, tree, scale, wanted in work[g]:
                    at = tree.leaves(codes)
                    gradient = np.round((margins[:, place] - y) * scale)
                    inside = sampled(hashes, params, number)
                    size = len(columns[i])
                    offsets = np.arange(size) * 256
                    for node in wanted:
                        here = np.flatnonzero(inside & (at == node))
                        index = (codes[np.ix_(here, columns[i])] + offsets).ravel()
                        held = totals.setdefault((i, node), np.zeros((2, size * 256)))
                        held[0] += np.bincount(index, np.repeat(gradient[here], size), size * 256)
                        held[1] += np.bincount(index, minlength=size * 256)
        keys = [(i, node, f, at) for i, node in totals for at, f in enumerate(columns[i])]
        sums = [totals[i, node].reshape(2, -1, 256)[:, at].tobytes() for i, node, _, at in keys]
        out = [np.array([k[j] for k in keys], np.int32) for j in range(3)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(sums, pa.binary())], ["fit", "node", "feature", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, sums in zip(*(batch.column(c).to_pylist() for c in ("fit", "node", "feature", "sums"))):
                held = totals.setdefault(tuple(key), np.zeros(512))
                held += np.frombuffer(sums, float)
        out = []
        for (i, node, feature), held in totals.items():
            params, scale = settings[i]
            g, n = held.reshape(2, 256)
            head = (i, node, feature, g.sum() / scale, n.sum())
            found = feature_splits(feature, g, n, params, scale)
            out += [(*head, c.rank, c.gain, c.bin, c.missing_left, *c.left, *c.right) for c in found] or [(*head, *[None] * 8)]
        integer, number_, flag = pa.int32(), pa.float64(), pa.bool_()
        types = [integer] * 3 + [number_] * 4 + [integer, flag] + [number_] * 4
        names = [part.split()[0] for part in SPLITS.split(", ")]
        lines = list(zip(*out)) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(lines, types)], names)

    if tasks > 1:
        summed = rows.mapInArrow(add, SUMS)
        splits = summed.repartition(min(tasks, 64), "fit", "node", "feature").mapInArrow(meet, SPLITS)
    else:  # the sums of a single task are whole
        splits = rows.mapInArrow(lambda batches: meet(add(batches)), SPLITS)
    found: dict[tuple[int, int], tuple[tuple[float, float], list[Candidate]]] = {}
    for r in splits.toArrow().to_pylist():
        _, candidates = found.setdefault((r["fit"], r["node"]), ((r["whole_g"], r["whole_n"]), []))
        if r["bin"] is not None:
            sides = (r["left_g"], r["left_n"]), (r["right_g"], r["right_n"])
            candidates.append(Candidate(r["rank"], r["gain"], r["feature"], r["bin"], r["missing_left"], *sides))
    return found


def _advance(rows: DataFrame, models, since: int) -> DataFrame:
    """Rows with their running predictions stored."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for _, own, _, _, _, now in _margins(batch, models, since):
                for i, line in zip(own, now):
                    out[i] = line.tobytes()
            columns = [batch.column(c) for c in ("grp", "hash", "codes", "y")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["grp", "hash", "codes", "y", "margins"])

    schema = "grp string, hash long, codes binary, y double, margins binary"
    return stored(rows.mapInArrow(update, schema), "margins")


def grown(training: Training, wanted: Sequence[tuple[str, TreeParams]]) -> list[Model]:
    """A model for each (group, settings); all trees of a round, of all fits, grow in the same jobs."""
    fits = []
    models: dict[str, list[Model]] = {g: [] for g in training.models}
    for g, params in wanted:
        if problem := params.problem():
            raise ValueError(problem)
        model = replace(training.models[g], trees=[])
        fits.append(_Fit(g, len(models[g]), params, model))
        models[g].append(model)
    models = {g: m for g, m in models.items() if m}
    rows, width = training.rows.where(F.col("grp").isin(sorted(models))), training.width
    rows = rows.persist()
    tasks = rows.rdd.getNumPartitions()
    spark = rows.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # the jobs are many, alike and of a known size: there is nothing to plan anew while they run
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _grow(rows, fits, models, width, tasks)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [f.model for f in fits]


def _grow(rows: DataFrame, fits: Sequence[_Fit], models: Mapping[str, Sequence[Model]], width: int, tasks: int) -> None:
    since = 0
    for number in range(max((f.params.n_estimators for f in fits), default=0)):
        growing = [f for f in fits if number < f.params.n_estimators]
        columns = [chosen_columns(f.params, number, width) for f in growing]
        for f in growing:
            f.tree, f.totals = Tree.empty(f.params.max_depth), {}
        # fits number -> nodes of one level that may be split
        todo = {i: [0] for i in range(len(growing))}
        while todo:
            found = _pass(rows, growing, models, number, since, todo, columns, width, tasks)
            todo = {}
            for (i, node), (whole, candidates) in sorted(found.items(), key=lambda item: item[0]):
                f = growing[i]
                f.totals.setdefault(node, whole)
                split = best_split(candidates, f.params)
                if split is None:
                    continue
                f.tree.feature[node], f.tree.bin[node], f.tree.missing_left[node] = split.feature, split.bin, split.missing_left
                f.totals[2 * node + 1], f.totals[2 * node + 2] = split.left, split.right
                if (node + 1).bit_length() < f.params.max_depth:
                    todo.setdefault(i, []).extend((2 * node + 1, 2 * node + 2))
        for f in growing:
            for node, (g, n) in f.totals.items():
                if f.tree.feature[node] < 0:
                    f.tree.value[node] = -f.params.learning_rate * g / (n + f.params.penalty)
            f.model.trees.append(f.tree)
        if (number + 1) % STORE_EVERY == 0:
            held = _advance(rows, models, since).persist()
            rows.unpersist()
            # fits that are done keep their number of trees; all others have this many
            rows, since = held, number + 1
    rows.unpersist()


def shared_fits(grid: Sequence[TreeParams]) -> list[list[TreeParams]]:
    """Candidates that differ in their number of trees alone, most trees first."""
    alike: dict[TreeParams, list[TreeParams]] = {}
    for params in grid:
        alike.setdefault(replace(params, n_estimators=0), []).append(params)
    return [sorted(same, key=lambda p: -p.n_estimators) for same in alike.values()]


def losses(
    held: DataFrame, features: Sequence[str], target: str, group: str, fits: Sequence[tuple[str, Model, Sequence[int]]]
) -> dict[tuple[int, int], float]:
    """{(fit, trees): mean squared error} of each fit's first so many trees on its group's rows, in one pass.

    Boosting adds trees one by one, so the first trees of a fit are the smaller candidate's.
    """
    names = list(features)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy()
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            out = []
            for i, (g, model, counts) in enumerate(fits):
                own = groups == g
                for n in counts:
                    error = y[own] - model.predict(values[own], n)
                    out.append((i, n, float(error @ error), int(own.sum())))
            columns = list(zip(*out))
            types = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["fit", "trees", "error", "n"])

    if not fits:
        return {}
    narrow = held.where(F.col(target).isNotNull()).select(
        F.col(group).cast("string").alias("grp"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double") for c in names)
    )
    summed = narrow.mapInArrow(add, "fit int, trees int, error double, n long").groupBy("fit", "trees").agg(
        F.sum("error").alias("error"), F.sum("n").alias("n")
    )
    return {(r["fit"], r["trees"]): r["error"] / r["n"] for r in summed.collect() if r["n"]}


def score(frame: DataFrame, features: Sequence[str], group: str, models: Mapping[str, Model]) -> DataFrame:
    """The frame with ``predicted``: NULL where a group has no model."""
    names, columns = list(features), list(frame.columns)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("_group").to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            out = np.full(batch.num_rows, np.nan)
            for g in set(groups):
                if g in models:
                    own = groups == g
                    out[own] = models[g].predict(values[own])
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, mask=np.isnan(out))], [*columns, "predicted"])

    wide = frame.select(
        *columns, F.col(group).cast("string").alias("_group"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names))
    )
    schema = frame.schema.add("predicted", "double")
    return wide.mapInArrow(predict, schema)
