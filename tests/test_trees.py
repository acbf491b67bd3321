"""Boosted trees against a single-machine version that grows them row by row."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidegrid import catalog
from tidegrid.operators import trees
from tidegrid.plans import research

NAMES = ("a", "b", "c", "d")


def table(seed=3, days=6, per_day=50, symbol="AAA", sign=1.0):
    """Rows with missing features and targets; ``c`` matters where it is missing, ``d`` has few values."""
    draw = np.random.default_rng(seed)
    n = days * per_day
    x = draw.normal(size=(n, 3))
    c = np.where(draw.random(n) < 0.3, np.nan, x[:, 2])
    d = draw.integers(0, 3, n).astype(float)
    y = sign * (x[:, 0] + np.where(np.isnan(c), 1.5, 0.2 * np.nan_to_num(c)) + (d == 2)) + 0.3 * draw.normal(size=n)
    y[draw.random(n) < 0.05] = np.nan
    a = np.where(draw.random(n) < 0.1, np.nan, x[:, 0])
    return pd.DataFrame({
        "symbol": symbol, "date": [f"2024-01-{1 + i // per_day:02d}" for i in range(n)],
        "decision_time_ns": np.arange(n) * 1_000 + seed, "a": a, "b": x[:, 1], "c": c, "d": d, "y": y,
    })


def spark_table(spark, rows):
    text = rows.astype(object).where(rows.notna(), None)
    return spark.createDataFrame(
        [tuple(r) for r in text.itertuples(index=False)],
        "symbol string, date string, decision_time_ns long, a double, b double, c double, d double, y double",
    ).repartition(5)


class Plain:
    """One group's trees: thresholds by trying every cut on the rows themselves."""

    def __init__(self, x, y, hashes, params):
        self.params, self.base = params, y.mean()
        quantiles = np.arange(trees.MOST_BINS - 1) / (trees.MOST_BINS - 1)
        self.cuts = []
        for column in x.T:
            known = np.sort(column[~np.isnan(column)])
            at = np.minimum(np.ceil(quantiles * len(known)).astype(int), len(known))
            self.cuts.append(np.unique(known[np.maximum(at, 1) - 1]))
        spread = max(y.max() - y.mean(), y.mean() - y.min())
        scale = 2.0 ** np.floor(np.log2(2.0**51 / (len(y) * spread)))
        margin, self.trees = np.full(len(y), y.mean()), []
        for number in range(params.n_estimators):
            gradient = np.round((margin - y) * scale) / scale
            rows = np.flatnonzero(trees.sampled(hashes, params, number))
            tree = self.grow(x, gradient, rows, trees.chosen_columns(params, number, x.shape[1]), 0)
            self.trees.append(tree)
            margin = margin + np.array([self.walk(tree, row) for row in x])

    def grow(self, x, gradient, rows, columns, depth):
        p = self.params
        g, n = gradient[rows].sum(), len(rows)
        best = None
        for missing_left in (True, False) if depth < p.max_depth else ():
            for column in columns:
                values = x[rows, column]
                for cut in self.cuts[column]:
                    left = np.where(np.isnan(values), missing_left, values <= cut)
                    gl, nl = gradient[rows[left]].sum(), left.sum()
                    if min(nl, n - nl) < p.minimum_rows:
                        continue
                    gain = 0.5 * (gl**2 / (nl + p.penalty) + (g - gl) ** 2 / (n - nl + p.penalty) - g**2 / (n + p.penalty))
                    rank = round(gain / max(g**2, 1e-300), 12)
                    if gain > p.minimum_gain and (best is None or rank > best[0]):
                        best = (rank, column, cut, missing_left, left)
        if best is None:
            return 0.0 if depth == 0 and not n else -p.learning_rate * g / (n + p.penalty)
        _, column, cut, missing_left, left = best
        return (column, cut, missing_left, *(self.grow(x, gradient, rows[side], columns, depth + 1) for side in (left, ~left)))

    @staticmethod
    def walk(tree, row):
        while isinstance(tree, tuple):
            column, cut, missing_left, below, above = tree
            left = missing_left if np.isnan(row[column]) else row[column] <= cut
            tree = below if left else above
        return tree

    def predict(self, x):
        return np.array([self.base + sum(self.walk(t, row) for t in self.trees) for row in x])


def hashes_of(frame):
    rows = frame.select("symbol", "decision_time_ns", F.xxhash64("symbol", "decision_time_ns").alias("h")).collect()
    return {(r["symbol"], r["decision_time_ns"]): r["h"] for r in rows}


def plain(frame, rows, symbol, params):
    known = rows[(rows.symbol == symbol) & rows.y.notna()]
    hashes = hashes_of(frame)
    of = np.array([hashes[symbol, t] for t in known.decision_time_ns], np.int64)
    return Plain(known[list(NAMES)].to_numpy(float), known.y.to_numpy(), of, params)


GRID = [
    trees.TreeParams(max_depth=2, n_estimators=4, learning_rate=0.3, minimum_rows=5),
    trees.TreeParams(max_depth=3, n_estimators=6, learning_rate=0.2, minimum_rows=3, row_share=1.0, column_share=1.0),
    trees.TreeParams(max_depth=1, n_estimators=3, learning_rate=0.5, minimum_rows=400),  # nothing can be split
]


@pytest.mark.parametrize("every, task_bytes", [(25, 32 << 20), (2, 4_000)])
def test_trees_equal_a_plain_version(spark, monkeypatch, every, task_bytes):
    """All fits grow together, over several tasks and with stored margins, to the trees of a single machine."""
    monkeypatch.setattr(trees, "STORE_EVERY", every)
    monkeypatch.setattr(trees, "TASK_BYTES", task_bytes)
    rows = pd.concat([table(), table(4, 4, 40, "BBB", -1.0)])
    frame = spark_table(spark, rows)
    training = trees.binned(frame, NAMES, "y", "symbol", ("symbol", "decision_time_ns"))
    wanted = [(s, p) for s in ("BBB", "AAA") for p in GRID]
    models = trees.grown(training, wanted)
    for (symbol, params), model in zip(wanted, models):
        direct = plain(frame, rows, symbol, params)
        for cuts, own in zip(direct.cuts, model.cuts):
            assert np.array_equal(cuts, own)
        x = rows[rows.symbol == symbol][list(NAMES)].to_numpy(float)
        assert np.abs(model.predict(x) - direct.predict(x)).max() < 1e-9
    # a missing value of c has a side of its own choice
    assert any(t.feature[0] >= 0 for t in models[4].trees) and not any(t.feature[0] >= 0 for t in models[5].trees)
    assert trees.grown(training, wanted)[1].predict(x).tolist() == models[1].predict(x).tolist()


def test_search_scores_every_candidate_and_names_failures(spark):
    rows = pd.concat([table(), table(4, symbol="BBB", sign=-1.0)])
    frame = spark_table(spark, rows)
    train, held = frame.where("date < '2024-01-05'"), frame.where("date >= '2024-01-05'")
    grid = [trees.TreeParams(max_depth=d, n_estimators=n) for d in (2, 99) for n in (3, 5)]
    found = {(r["symbol"], r["max_depth"], r["n_estimators"]): r for r in research.tree_search(train, held, NAMES, "y", grid).collect()}
    assert len(found) == 8 and sum(r["message"] is not None for r in found.values()) == 4
    for symbol in ("AAA", "BBB"):
        for params in grid[:2]:  # the shared fit has the losses of a fit of each count
            direct = plain(frame, rows[rows.date < "2024-01-05"], symbol, params)
            own = rows[(rows.symbol == symbol) & (rows.date >= "2024-01-05") & rows.y.notna()]
            mse = np.mean((own.y.to_numpy() - direct.predict(own[list(NAMES)].to_numpy(float))) ** 2)
            assert found[symbol, 2, params.n_estimators]["validation_mse"] == pytest.approx(mse, rel=1e-9)
        assert found[symbol, 99, 3]["validation_mse"] is None and found[symbol, 99, 3]["error_type"] == "ValueError"
    with pytest.raises(RuntimeError):
        research.tree_search(train, held, NAMES, "y", grid[2:])
    with pytest.raises(ValueError):
        research.tree_search(train.where("symbol = 'AAA'"), held, NAMES, "y", grid)
    assert {(p.max_depth, p.n_estimators) for p in catalog.TREE_GRID} == {(d, n) for d in (2, 3) for n in (100, 200)}


def test_a_failed_job_stops_the_search(spark, monkeypatch):
    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(trees, "_pass", lost)
    frame = spark_table(spark, table())
    with pytest.raises(RuntimeError, match="executor lost"):
        research.tree_search(frame, frame, NAMES, "y", GRID[:1])
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_holdout_predictions_and_means(spark):
    rows = pd.concat([table(), table(4, symbol="BBB", sign=-1.0)])
    frame = spark_table(spark, rows)
    train, held = frame.where("date < '2024-01-05'"), frame.where("date >= '2024-01-05'")
    chosen = {"AAA": GRID[0], "BBB": GRID[1], "CCC": GRID[0]}
    out = research.tree_holdout(train, held, NAMES, "y", chosen, 1).toPandas()
    assert len(out) == held.where("y IS NOT NULL").count()
    means = rows[rows.date < "2024-01-05"].groupby("symbol").y.mean()
    for symbol, own in out.groupby("symbol"):
        direct = plain(frame, rows[rows.date < "2024-01-05"], symbol, chosen[symbol])
        assert np.abs(own.predicted - direct.predict(own[list(NAMES)].to_numpy(float))).max() < 1e-9
        assert own.training_mean.iloc[0] == pytest.approx(means[symbol]) and (own.actual == own.y).all()
    with pytest.raises(ValueError):
        research.tree_holdout(train, held, NAMES, "y", {"AAA": GRID[0]}, 1)
    assert research.tree_holdout(train, held.where("false"), NAMES, "y", chosen, 1).count() == 0


def test_constant_and_empty_features(spark):
    rows = table().assign(b=1.0, d=np.nan)
    frame = spark_table(spark, rows)
    training = trees.binned(frame, NAMES, "y", "symbol", ("symbol", "decision_time_ns"))
    (model,) = trees.grown(training, [("AAA", GRID[0])])
    direct = plain(frame, rows, "AAA", GRID[0]) if not np.isnan(rows.d).all() else None
    assert direct is None and [len(c) for c in model.cuts][1::2] == [1, 0]
    assert not any((t.feature == 3).any() or (t.feature == 1).any() for t in model.trees)
    still = table().assign(y=2.0)
    training = trees.binned(spark_table(spark, still), NAMES, "y", "symbol", ("symbol", "decision_time_ns"))
    (model,) = trees.grown(training, [("AAA", GRID[0])])
    assert np.allclose(model.predict(still[list(NAMES)].to_numpy(float)), 2.0)


def test_histograms_stay_with_the_tasks(spark, monkeypatch):
    """What reaches the driver is the best splits of each feature, not its bins."""
    frame, sizes = type(spark.range(1)), []
    collect = frame.toArrow

    def weighed(self):
        found = collect(self)
        sizes.append(found.nbytes)
        return found

    training = trees.binned(spark_table(spark, table()), NAMES, "y", "symbol", ("symbol", "decision_time_ns"))
    monkeypatch.setattr(frame, "toArrow", weighed)
    trees.grown(training, [("AAA", GRID[1])])
    assert len(sizes) >= 6 and max(sizes) < 4 * len(NAMES) * 256


def test_queries_grow_trees_on_every_row(spark, monkeypatch):
    """The search, the chosen trees and the threshold see every row of their periods with a known target."""
    monkeypatch.setattr(catalog, "TREE_GRID", [trees.TreeParams(max_depth=d, n_estimators=3) for d in (1, 2)])
    taken, binned = [], trees.binned

    def counted(*arguments):
        training = binned(*arguments)
        taken.append({symbol: model.rows for symbol, model in training.models.items()})
        return training

    monkeypatch.setattr(trees, "binned", counted)
    names, target, keys = list(catalog.SETS.expanded), catalog.TARGET, ["symbol", "date", "decision_time_ns"]
    features = catalog._features(spark, SF).select(*keys, target, *names)
    rows = features.toPandas().rename(columns={target: "y"})
    known = rows[rows.y.notna()].sort_values("decision_time_ns")
    (_, first, end, _), (_, later, last, _), _ = catalog.PERIODS
    catalog.forget("tree_search", "holdout")
    try:
        found = catalog.gbt_holdout(spark, SF).toPandas()
        chosen = research.chosen_trees(catalog._tree_search(spark, SF))
        catalog.holdout_economics(spark, SF).collect()
    finally:
        catalog.forget("tree_search", "holdout")
    early = known[(known.date >= first) & (known.date < catalog.TUNING_BOUNDARY)]
    boundary = pd.Timestamp(catalog.TUNING_BOUNDARY).value
    early = early[early.decision_time_ns < boundary - catalog.PURGE_SECONDS * 1_000_000_000]
    development, both = (known[known.date.between(first, e)] for e in (end, last))
    assert taken == [dict(side.symbol.value_counts()) for side in (early, development, early, both)]
    hashes = hashes_of(features)
    for symbol, own in development.groupby("symbol"):
        of = np.array([hashes[symbol, t] for t in own.decision_time_ns], np.int64)
        direct = Plain(own[names].to_numpy(float), own.y.to_numpy(), of, chosen[symbol])
        held = known[(known.symbol == symbol) & known.date.between(later, last)]
        scored = found[found.symbol == symbol].sort_values("decision_time_ns")
        assert scored.decision_time_ns.tolist() == held.decision_time_ns.tolist()
        assert np.abs(scored.predicted.to_numpy() - direct.predict(held[names].to_numpy(float))).max() < 1e-7


def test_trees_of_a_holdout_refuse_a_sample(spark):
    frame = spark_table(spark, table())
    with pytest.raises(ValueError, match="every training row"):
        research.tree_holdout(frame, frame, NAMES, "y", {"AAA": GRID[0]}, 2)
