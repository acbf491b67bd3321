"""Models carried to signals: thresholds from predictions a model has not been fitted on."""

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, SECOND
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid.operators import linear, trees
from tidegrid.params import DAY_NS, ExecutionParams
from tidegrid.plans import backtest, models

NAMES = ("a", "b")
BOUNDARY, PURGE = "2024-01-05", 3_600


def table(symbol="AAA", seed=1, days=6, per_day=24):
    draw = np.random.default_rng(seed)
    n = days * per_day
    day = np.repeat(np.arange(days), per_day)
    frame = pd.DataFrame({"a": draw.normal(size=n), "b": draw.normal(size=n), "vol": draw.random(n) + 0.1})
    frame["y"] = frame["a"] - 0.5 * frame["b"] + 0.2 * draw.normal(size=n)
    frame.loc[frame.index % 11 == 0, "a"] = np.nan
    frame.loc[frame.index % 13 == 0, "y"] = np.nan
    frame["symbol"], frame["date"] = symbol, [f"2024-01-{d + 2:02d}" for d in day]
    frame["decision_time_ns"] = DAY0 + day * DAY_NS + (np.tile(np.arange(per_day), days) + 1) * 3_500 * SECOND
    return frame


def spark_table(spark, rows):
    frame = spark.createDataFrame(rows)
    return frame.selectExpr(*(f"nullif({c}, double('NaN')) AS {c}" if k == "double" else c for c, k in frame.dtypes))


def ridge(train, rows, alpha):
    x, z = (f[list(NAMES)].fillna(train[list(NAMES)].median()) for f in (train, rows))
    mean, std = x.mean(), x.std(ddof=0)
    x, z, y = ((x - mean) / std).to_numpy(), ((z - mean) / std).to_numpy(), train["y"].to_numpy()
    return y.mean() + z @ np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (y - y.mean()))


def test_ridge_threshold_and_predictions_equal_direct_fits(spark):
    rows = pd.concat([table(), table("BBB", 2)])
    frame = spark_table(spark, rows)
    early = frame.where("date < '2024-01-07'")
    fitted = models.ridge_models(early, NAMES, "y", 2.0, BOUNDARY, PURGE, 1.5, "vol")
    scored = models.ridge_predictions(fitted, frame.where("date = '2024-01-07'"), NAMES, "y", "vol").toPandas()
    at = DAY0 + 3 * DAY_NS
    for row in fitted.collect():
        own = rows[(rows.symbol == row["symbol"]) & (rows.date < "2024-01-07")]
        known = own[own.y.notna()]
        train = known[known.decision_time_ns < at - PURGE * SECOND]
        checked = known[known.decision_time_ns >= at + PURGE * SECOND]
        assert row["signal_threshold"] == pytest.approx(1.5 * ridge(train, checked, 2.0).std())
        assert row["median_volatility"] == pytest.approx(own.vol.median())
        last = rows[(rows.symbol == row["symbol"]) & (rows.date == "2024-01-07") & rows.y.notna()]
        found = scored[scored.symbol == row["symbol"]].sort_values("decision_time_ns")
        assert found.prediction.tolist() == pytest.approx(ridge(known, last, 2.0).tolist())
        assert found.volatility.tolist() == pytest.approx(last.vol.tolist())


def test_thresholds_that_are_no_positive_number_raise(spark):
    rows = table()
    frame = spark_table(spark, rows.assign(y=1.0))  # the predictions do not vary
    with pytest.raises(PySparkException, match="no positive signal threshold for AAA"):
        models.ridge_models(frame, NAMES, "y", 2.0, BOUNDARY, PURGE, 1.0, "vol")
    for side in ("date < '2024-01-05'", "date >= '2024-01-05'"):
        with pytest.raises(ValueError, match="side of the calibration split is empty"):
            models.calibration(frame.where(side), "y", BOUNDARY, PURGE)


def test_trees_are_traded_at_their_validation_threshold(spark):
    rows = table(per_day=30)
    frame = spark_table(spark, rows)
    params = {"AAA": trees.TreeParams(max_depth=2, n_estimators=5, learning_rate=0.3, minimum_rows=5)}
    limits = models.tree_thresholds(frame, NAMES, "y", params, BOUNDARY, PURGE, 1, 2.0, "vol")
    train, validation = models.calibration(frame, "y", BOUNDARY, PURGE)
    from tidegrid.plans import research

    direct = research.tree_holdout(train, validation, NAMES, "y", params, 1).toPandas()
    row = limits.first()
    assert row["signal_threshold"] == pytest.approx(2.0 * direct.predicted.std(ddof=0))
    assert row["median_volatility"] == pytest.approx(rows.vol.median())


def test_a_carried_threshold_decides_the_signals(spark):
    """The model table replaces calibration rows: the same thresholds give the same backtest."""
    from helpers import trades

    events = [("spot", i * 60 * SECOND, i + 1, 100.0 + (i % 7), 1.0, False) for i in range(600)]
    market = trades(spark, events)
    scored = spark.createDataFrame(
        [("AAA", "2024-01-02", DAY0 + i * 600 * SECOND, (-1) ** i * i / 10.0, 0.5) for i in range(1, 30)],
        "symbol string, date string, decision_time_ns long, prediction double, volatility double",
    )
    params = ExecutionParams(latencies_ms=(60_000,), primary_latency_ms=60_000, holding_seconds=600)
    plain = backtest.run_backtest(market, scored, scored, params)
    table = plain.thresholds.withColumn("_weights", F.array(F.lit(1.0)))
    carried = backtest.run_signals(market, scored, table, params)
    names = ["decision_time_ns", "direction", "entry_time_ns", "exit_time_ns", "gross_pnl", "sizing"]
    order = lambda run: sorted(map(tuple, run.trades.select(*names).collect()))
    assert order(plain) == order(carried) and plain.signals.count() > 0


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_rounding_of_a_constant_is_no_feature(alpha):
    """A third that differs in its last digit from row to row gets no weight and moves no other one."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=400)
    third = np.where(draw.random(400) < 0.5, 1 / 3, np.nextafter(1 / 3, 1))
    y = 2 * x + draw.normal(size=400)
    design = np.column_stack([np.ones(400), x, third, np.zeros((400, 2)), y])
    sums, names = design.T @ design, ["x", "third"]
    both = linear.solve(sums, names, names, {"x": 0.0, "third": 1 / 3}, alpha)
    alone = linear.solve(sums, names, ["x"], {"x": 0.0}, alpha)
    assert both.weights[1] == 0.0 and both.weights[0] == pytest.approx(alone.weights[0], rel=1e-12)
