import hashlib

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, SECOND, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid.functions.ordering import average_ranks, exact_medians, running_totals
from tidegrid.operators import evaluation, inference, linear, splits
from tidegrid.params import DAY_NS, FeatureSets
from tidegrid.plans import research


def _crowded(seed=1, count=3_000):
    """A third of the rows share one value."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "g": rng.choice(["a", "b"], count, p=[0.8, 0.2]),
            "t": np.arange(count),
            "actual": np.round(rng.normal(size=count), 2),
            "predicted": np.where(rng.random(count) < 0.34, 0.0, np.round(rng.normal(size=count), 1)),
        }
    )
    return frame


def test_running_totals_over_ranges(spark):
    table = _crowded()
    frame = spark.createDataFrame(table)
    out = running_totals(frame.selectExpr("*", "1L AS one"), ["g"], ["predicted", "t", "g"], {"before": "one"})
    got = out.toPandas().sort_values(["g", "predicted", "t"])
    assert (got["before"] == got.groupby("g").cumcount()).all()
    assert (got["before_total"] == got.groupby("g")["t"].transform("size")).all()


def test_average_ranks(spark):
    table = _crowded()
    got = average_ranks(spark.createDataFrame(table), ["g"], "predicted", "rank").toPandas()
    want = table.assign(rank=table.groupby("g")["predicted"].rank()).drop_duplicates(["g", "predicted"])
    merged = want.merge(got, on=["g", "predicted"])
    assert len(merged) == len(got) and (merged["rank_x"] == merged["rank_y"]).all()


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_medians(spark, accuracy):
    table = _crowded(count=4_001)
    table.loc[::7, "actual"] = np.nan
    frame = spark.createDataFrame(table).selectExpr("g", "nullif(actual, double('NaN')) AS actual", "predicted")
    got = exact_medians(frame, ["g"], ["actual", "predicted"], accuracy).toPandas()
    for row in got.itertuples():
        part = table.loc[table["g"] == row.g, row.name].dropna()
        assert row.median == part.median() and row.rows == len(part)


def test_median_brackets_are_narrowed(spark):
    """Few rows may be ordered at once: ties, outliers and magnitudes far apart need bin counts first."""
    rng = np.random.default_rng(3)
    parts = {
        "spread": rng.normal(size=3_000),
        "even": rng.normal(size=2_500),
        "magnitudes": 10.0 ** rng.uniform(-200, 200, 3_001),
        "ties": np.repeat([1.0, 2.0, 3.0], [900, 1_400, 701]),
        "two": np.repeat([1.0, 5.0], [1_000, 1_000]),
        "one": np.array([7.0]),
    }
    table = pd.DataFrame([(g, float(v)) for g, values in parts.items() for v in values], columns=["g", "v"])
    got = exact_medians(spark.createDataFrame(table), ["g"], ["v"], accuracy=20, inside=10).toPandas()
    assert dict(zip(got["g"], got["median"])) == {g: float(np.median(v)) for g, v in parts.items()}


def test_regression_metrics(spark):
    table = _crowded().assign(training_mean=0.1)
    whole = evaluation.regression_metrics(spark.createDataFrame(table), ["g"]).toPandas().set_index("g")
    daily = evaluation.daily_regression_metrics(spark.createDataFrame(table), ["g"]).toPandas().set_index("g")
    for g, part in table.groupby("g"):
        a, p = part["actual"], part["predicted"]
        want = [
            1 - ((a - p) ** 2).sum() / ((a - 0.1) ** 2).sum(), ((a - p) ** 2).mean(), (a - p).abs().mean(),
            np.corrcoef(a, p)[0, 1], np.corrcoef(a.rank(), p.rank())[0, 1],
        ]
        for out in (whole, daily):
            assert list(out.loc[g, ["oos_r2", "mse", "mae", "pearson_ic", "rank_ic"]]) == pytest.approx(want)


def test_degenerate_metrics_are_zero(spark):
    frame = spark.createDataFrame([("a", 1.0, 0.5, 1.0)] * 3, "g string, actual double, predicted double, training_mean double")
    row = evaluation.regression_metrics(frame, ["g"]).first()
    assert (row["oos_r2"], row["pearson_ic"], row["rank_ic"]) == (0.0, 0.0, 0.0)
    one_class = frame.selectExpr("g", "1 AS actual", "predicted")
    row = evaluation.classification_metrics(one_class, ["g"]).first()
    assert (row["roc_auc"], row["pr_auc"], row["accuracy"], row["class_balance"]) == (0.0, 1.0, 1.0, 1.0)


def test_classification_metrics(spark):
    table = _crowded()
    table = pd.DataFrame(
        {"g": table["g"], "actual": (table["actual"] > 0.2).astype(int), "predicted": 1 / (1 + np.exp(-table["predicted"]))}
    )
    table["predicted"] = table["predicted"].round(3)
    for function in (evaluation.classification_metrics, evaluation.daily_classification_metrics):
        out = function(spark.createDataFrame(table), ["g"]).toPandas().set_index("g")
        for g, part in table.groupby("g"):
            pos, neg = part[part.actual == 1].predicted.to_numpy(), part[part.actual == 0].predicted.to_numpy()
            auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
            precision, recall, ap = [], 0.0, 0.0
            for cut in sorted(set(part.predicted), reverse=True):
                tp, fp = (pos >= cut).sum(), (neg >= cut).sum()
                ap += (tp / len(pos) - recall) * tp / (tp + fp)
                recall = tp / len(pos)
            assert out.loc[g, "roc_auc"] == pytest.approx(auc)
            assert out.loc[g, "pr_auc"] == pytest.approx(ap)
            assert out.loc[g, "brier"] == pytest.approx(((part.predicted - part.actual) ** 2).mean())


def test_decile_rules(spark):
    frame = spark.range(13).selectExpr("'a' AS g", "id AS t", "CAST(id DIV 5 AS DOUBLE) AS predicted", "1.0D AS actual")
    floor = [r[0] for r in evaluation.deciles_floor(frame, ["g"], ["t"]).orderBy("decile").select("rows").collect()]
    equal = [r[0] for r in evaluation.deciles_equal(frame, ["g"], ["t"]).orderBy("decile").select("rows").collect()]
    assert floor == [2, 1, 1, 2, 1, 1, 2, 1, 1, 1]
    assert equal == [len(part) for part in np.array_split(np.arange(13), 10)]


def test_circular_shift(spark):
    frame = spark.range(903).selectExpr("'a' AS symbol", "'d' AS date", "id AS t", "CAST(id AS DOUBLE) AS v", "id AS kept")
    out = evaluation.circular_shift(frame, ("symbol", "date"), ["v"], 900, "t").orderBy("t").collect()
    assert out[0]["v"] == 3.0 and out[900]["v"] == 0.0 and out[5]["kept"] == 5
    assert [r["v"] for r in out] == np.roll(np.arange(903.0), 900).tolist()


def _dates(spark, count):
    return spark.range(count).selectExpr("date_format(date_add(DATE'2024-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS date")


def test_expanding_folds(spark):
    folds = splits.expanding_folds(_dates(spark, 22), 10, 5)
    counts = rows(folds.groupBy("fold", "role").count(), "fold", "role")
    assert counts == [(1, "evaluate", 5), (1, "train", 10), (2, "evaluate", 5), (2, "train", 15)]
    with pytest.raises(ValueError):
        splits.require_folds(splits.expanding_folds(_dates(spark, 14), 10, 5))
    with pytest.raises(ValueError):
        splits.expanding_folds(_dates(spark, 14), 0, 5)


def test_purge_around_the_boundary(spark):
    boundary = DAY0
    frame = spark.createDataFrame(
        [("2024-01-01", boundary - k * SECOND) for k in (5, 11)] + [("2024-01-02", boundary + k * SECOND) for k in (5, 11)],
        "date string, decision_time_ns long",
    )
    split = splits.walk_forward_split(frame, splits.expanding_folds(frame, 1, 1), 10)
    assert rows(split.select("role", "decision_time_ns"), "decision_time_ns") == [
        ("train", boundary - 11 * SECOND), ("evaluate", boundary + 11 * SECOND)
    ]
    left, right = splits.boundary_split(frame, "2024-01-02", 10)
    assert (left.count(), right.count()) == (1, 1)


def test_bad_splits_raise(spark):
    def folded(days, frame_days, initial=2, evaluation=2, purge=0):
        folds = splits.expanding_folds(_dates(spark, days), initial, evaluation)
        frame = _dates(spark, days).where(F.col("date").isin(frame_days))
        time = F.unix_date(F.col("date").cast("date")).cast("long") * DAY_NS
        splits.require_split(frame.withColumn("decision_time_ns", time), folds, purge)

    every = [f"2024-01-0{d}" for d in range(1, 7)]
    folded(6, every)
    with pytest.raises(ValueError, match="do not fill one fold"):
        folded(3, every)
    with pytest.raises(ValueError, match="fold 2 has no evaluation rows"):
        folded(6, every[:4])
    with pytest.raises(ValueError, match="fold 1 has no training rows"):
        folded(6, every[2:])
    with pytest.raises(ValueError, match="fold 1 has no training rows"):
        folded(6, every, purge=3 * 86_400)  # the purge leaves nothing


def test_sealed_periods_are_unreadable(spark):
    periods = [("a", "2024-01-01", "2024-01-02", "open"), ("b", "2024-01-03", "2024-01-09", "sealed")]
    out = splits.sample_periods(_dates(spark, 5), periods)
    assert rows(out.select("date", "period"), "date") == [("2024-01-01", "a"), ("2024-01-02", "a")]


def test_bootstrap_is_deterministic(spark):
    frame = spark.range(8).selectExpr("id AS day", "CAST(id - 2 AS DOUBLE) AS improvement")
    a, b = (inference.day_bootstrap(frame, "day", 200, 7).first() for _ in range(2))
    other = inference.day_bootstrap(frame, "day", 200, 8).first()
    assert a == b and a != other
    assert a["estimate"] == 1.5 and a["lower"] < 1.5 < a["upper"] and a["days"] == 8
    twice = frame.unionByName(frame.withColumn("improvement", F.col("improvement") + 0.0))
    assert inference.day_bootstrap(twice, "day", 200, 7).first() == a  # symbols of a day are one block
    draws = [int(hashlib.md5(f"7-3-{i}".encode()).hexdigest()[:8], 16) % 8 for i in range(8)]
    means = [np.mean([int(hashlib.md5(f"7-{r}-{i}".encode()).hexdigest()[:8], 16) % 8 - 2 for i in range(8)]) for r in range(200)]
    assert means[3] == np.mean(draws) - 2
    assert np.allclose([a["lower"], a["upper"]], np.quantile(means, [0.025, 0.975]))
    with pytest.raises(PySparkException):
        inference.day_bootstrap(frame.where("day = 0"), "day", 200, 7).collect()


SETS = FeatureSets()


def _model_table(days=6, per_day=60, seed=3):
    rng = np.random.default_rng(seed)
    count = days * per_day
    names = SETS.expanded
    table = pd.DataFrame(rng.normal(size=(count, len(names))), columns=list(names))
    table.insert(0, "symbol", "AAA")
    day = np.repeat(np.arange(days), per_day)
    table.insert(1, "date", [f"2024-01-{d + 2:02d}" for d in day])
    table.insert(2, "decision_time_ns", DAY0 + day * DAY_NS + np.tile(np.arange(1, per_day + 1), days) * 1_380 * SECOND)
    signal = table[names[0]] - 0.5 * table[names[20]]
    table["y"] = signal + rng.normal(size=count)
    table["up"] = (table["y"] > 0).astype(float)
    for i, name in enumerate(names[::5]):
        table.loc[table.index % (9 + i) == 0, name] = np.nan
    table.loc[table.index % 17 == 0, "y"] = np.nan
    return table


def _spark_table(spark, table):
    frame = spark.createDataFrame(table)
    kinds = dict(frame.dtypes)
    return frame.selectExpr(*(f"nullif({c}, double('NaN')) AS {c}" if kinds[c] == "double" else c for c in frame.columns))


def _design(train, other, names):
    medians = train[names].median()
    a, b = train[names].fillna(medians), other[names].fillna(medians)
    mean, std = a.mean(), a.std(ddof=0)
    return ((a - mean) / std).to_numpy(), ((b - mean) / std).to_numpy()


def test_linear_walk_forward_equals_direct_fits(spark):
    table = _model_table()
    frame = _spark_table(spark, table).cache()
    folds = splits.expanding_folds(frame, 3, 1)
    purge = 7_200
    got = research.linear_predictions(frame, folds, SETS, "y", 2.0, purge).toPandas()
    dates = sorted(table["date"].unique())
    checked = 0
    for fold in (1, 2, 3):
        boundary = DAY0 + (2 + fold) * DAY_NS
        known = table[table["y"].notna()]
        train = known[known["date"].isin(dates[: 2 + fold]) & (known["decision_time_ns"] < boundary - purge * SECOND)]
        test = known[(known["date"] == dates[2 + fold]) & (known["decision_time_ns"] >= boundary + purge * SECOND)]
        for scope, names in (("baseline", list(SETS.baseline)), ("expanded", list(SETS.expanded))):
            x, z = _design(train, test, names)
            for model, alpha in (("linear", 0.0), ("ridge", 2.0)):
                y = train["y"].to_numpy()
                w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
                part = got[(got.fold == fold) & (got.model == model) & (got.scope == scope)].sort_values("decision_time_ns")
                assert part["predicted"].tolist() == pytest.approx((y.mean() + z @ w).tolist())
                assert part["training_mean"].iloc[0] == pytest.approx(y.mean())
                checked += len(part)
    assert checked == len(got)


def test_logistic_walk_forward_is_the_penalised_optimum(spark):
    table = _model_table()
    frame = _spark_table(spark, table)
    folds = splits.expanding_folds(frame, 4, 2)
    got, failures = research.logistic_predictions(frame, folds, SETS, "up", 0.7, 10)
    assert failures.count() == 0
    got = got.toPandas()
    dates = sorted(table["date"].unique())
    train, test = table[table["date"].isin(dates[:4])], table[table["date"].isin(dates[4:])]
    for scope, names in (("baseline", list(SETS.baseline)), ("expanded", list(SETS.expanded))):
        x, z = _design(train, test, names)
        x, z = np.column_stack([np.ones(len(x)), x]), np.column_stack([np.ones(len(z)), z])
        y, penalty = train["up"].to_numpy(), np.r_[0.0, np.full(len(names), 1 / 0.7)]
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        part = got[got.scope == scope].sort_values("decision_time_ns")
        assert part["predicted"].tolist() == pytest.approx((1 / (1 + np.exp(-z @ w))).tolist(), abs=1e-6)


def test_two_feature_ridge_equals_general_solution(spark):
    table = _model_table().dropna()
    frame = _spark_table(spark, table)
    names = list(SETS.expanded[:2])
    row = linear.two_feature_regression(frame, ["symbol"], *names, "y", 5.0).first()
    x, _ = _design(table, table, names)
    w = np.linalg.solve(x.T @ x + 5 * np.eye(2), x.T @ (table["y"] - table["y"].mean()))
    assert (row["coefficient_1"], row["coefficient_2"]) == pytest.approx(tuple(w))


def test_training_scaling(spark):
    table = _model_table()
    names = list(SETS.expanded[:6])
    out = linear.train_scaling(_spark_table(spark, table), ["symbol"], names).toPandas().set_index("name")
    for name in names:
        filled = table[name].fillna(table[name].median())
        assert tuple(out.loc[name, ["median", "mean", "deviation"]]) == pytest.approx(
            (table[name].median(), filled.mean(), filled.std(ddof=0))
        )


@pytest.mark.parametrize("block_rows", [25, 50_000])
def test_hac_errors_over_blocks(spark, block_rows):
    table = _model_table()
    names = list(SETS.expanded[:3])
    out = inference.hac_regression(_spark_table(spark, table), "symbol", names, "y", 4, block_rows).toPandas()
    known = table[table["y"].notna()].sort_values("decision_time_ns")
    x, _ = _design(known, known, names)
    x, y = np.column_stack([np.ones(len(x)), x]), known["y"].to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, 5):
        gamma = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 5) * (gamma + gamma.T)
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))
    out = out.set_index("term").loc[["intercept", *names]]
    assert out["coefficient"].tolist() == pytest.approx(beta.tolist())
    assert out["standard_error"].tolist() == pytest.approx(errors.tolist())
    assert out["observations"].unique().tolist() == [len(known)]


def test_hac_answers_for_constant_and_empty_features(spark):
    table = _model_table()
    names = list(SETS.expanded[:3])
    plain = inference.hac_regression(_spark_table(spark, table), "symbol", names[:1], "y", 4).toPandas()
    table[names[1]], table[names[2]] = 3.7, np.nan
    out = inference.hac_regression(_spark_table(spark, table), "symbol", names, "y", 4).toPandas()
    out, plain = out.set_index("term"), plain.set_index("term")
    for term in ("intercept", names[0]):
        for column in ("coefficient", "standard_error", "p_value"):
            assert out.loc[term, column] == pytest.approx(plain.loc[term, column], rel=1e-6)
    assert out.loc[names[1], "coefficient"] == 0 and np.isnan(out.loc[names[1], "t_value"])
    assert np.isnan(out.loc[names[2], "coefficient"]) and np.isnan(out.loc[names[2], "standard_error"])


def test_placebo_rotates_only_the_additions(spark):
    table = _model_table()
    frame = _spark_table(spark, table)
    train, test = frame.where("date < '2024-01-05'"), frame.where("date >= '2024-01-05'")
    out = research.placebo_predictions(train, test, SETS, "y", 1.0, 7)
    assert out.count() == table[(table.date >= "2024-01-05") & table.y.notna()].shape[0]


def test_fold_sums_of_rolling_folds_and_of_symbols_without_rows(spark):
    """Differences of running sums equal direct sums; a symbol that starts late has zeros for the folds before it."""
    table = _model_table()
    names = list(SETS.baseline[:3])
    late = table[table["date"] > "2024-01-05"].assign(symbol="ZZZ")
    frame = _spark_table(spark, pd.concat([table, late]))
    rolling = [(1, "2024-01-02", "2024-01-04"), (2, "2024-01-03", "2024-01-05"), (3, "2024-01-04", "2024-01-06")]
    dates = sorted(table["date"].unique())
    folds = spark.createDataFrame(
        [
            (f, d, "train", int(DAY0 + (dates.index(last) + 1) * DAY_NS))
            for f, first, last in rolling for d in dates if first <= d <= last
        ],
        "fold int, date string, role string, boundary_ns long",
    )
    purge = 7_200
    marked = frame.withColumn("late", F.pmod("decision_time_ns", F.lit(DAY_NS)) >= DAY_NS - purge * SECOND)
    daily = linear.products(marked, ("symbol", "date", "late"), names, ["y"]).drop("target")
    got = {(r["symbol"], r["fold"]): np.frombuffer(r["m"]).reshape(8, 8) for r in linear.fold_products(daily, folds).collect()}
    assert set(got) == {(s, f) for s in ("AAA", "ZZZ") for f in (1, 2, 3)}
    for (symbol, fold), matrix in got.items():
        _, first, last = rolling[fold - 1]
        rows = pd.concat([table, late])
        rows = rows[(rows.symbol == symbol) & (rows.date >= first) & (rows.date <= last) & rows.y.notna()]
        rows = rows[rows.decision_time_ns < DAY0 + (dates.index(last) + 1) * DAY_NS - purge * SECOND]
        values = rows[names].to_numpy()
        design = np.column_stack([np.ones(len(rows)), np.nan_to_num(values), np.isnan(values), rows.y])
        assert matrix == pytest.approx(design.T @ design, abs=1e-9)
    scaled = {
        (r["symbol"], r["fold"]): r
        for r in linear.scaling(
            linear.fold_products(daily, folds),
            linear.train_medians(splits.walk_forward_split(frame, folds, purge).where("y IS NOT NULL"), ("symbol", "fold"), names),
            ("symbol", "fold"), names,
        ).collect()
    }
    assert scaled["ZZZ", 1]["train_rows"] == 0 and scaled["ZZZ", 1]["names"] == []
    own = table[(table.date <= "2024-01-04") & table.y.notna() & (table.decision_time_ns < DAY0 + 3 * DAY_NS - purge * SECOND)][names]
    filled = own.fillna(own.median())
    assert scaled["AAA", 1]["median"] == pytest.approx(own.median().tolist())
    assert scaled["AAA", 1]["mean"] == pytest.approx(filled.mean().tolist())
    assert scaled["AAA", 1]["deviation"] == pytest.approx(filled.std(ddof=0).tolist())


def test_symbols_without_training_rows_have_null_fits(spark):
    table = _model_table()
    late = table[table["date"] > "2024-01-05"].assign(symbol="ZZZ")
    frame = _spark_table(spark, pd.concat([table, late]))
    folds = splits.expanding_folds(frame, 3, 1)
    fits = research.linear_fits(frame, folds, SETS, "y", 1.0, 10)
    empty = fits.where("train_rows = 0")
    assert {r["fold"] for r in empty.where("symbol = 'ZZZ'").collect()} == {1, 2} and empty.where("symbol = 'AAA'").count() == 0
    assert empty.where("_intercept IS NOT NULL").count() == 0
    out = research.linear_predictions(frame, folds, SETS, "y", 1.0, 10)
    assert {r["fold"] for r in out.where("symbol = 'ZZZ'").select("fold").distinct().collect()} == {3}
    _, failures = research.logistic_predictions(frame, folds, SETS, "up", 1.0, 10)
    assert [(r["symbol"], r["fold"]) for r in failures.orderBy("fold").collect()] == [("ZZZ", 1), ("ZZZ", 2)]


def test_training_rows_are_stored_once_with_their_folds(spark):
    table = _model_table()
    frame = _spark_table(spark, table)
    folds = splits.expanding_folds(frame, 3, 1)
    once = splits.training_folds(frame, folds, 7_200)
    many = splits.walk_forward_split(frame, folds, 7_200).where("role = 'train'").select("decision_time_ns", "fold")
    assert once.count() == once.select("decision_time_ns").distinct().count()
    assert sorted(map(tuple, once.select("decision_time_ns", F.explode("folds")).collect())) == sorted(map(tuple, many.collect()))
