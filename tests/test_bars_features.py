import math

import pandas as pd
import pytest
from helpers import DAY0, MS, column, rows, trades

from tidegrid.operators import flow
from tidegrid.operators.bars import base_bars, market_bars
from tidegrid.operators.quality import validate_features
from tidegrid.params import DAY_NS, FeatureSets, GridParams
from tidegrid.plans import features
from tidegrid.plans.features import MARKET_DAY

HOUR = 3_600_000
GRID = GridParams(HOUR, 2 * HOUR, (HOUR, 2 * HOUR, 3 * HOUR), (HOUR, 2 * HOUR), 3 * HOUR, 1)


def hours(n):
    return n * HOUR * MS


def test_bars_are_open_on_the_right_in_both_markets(spark):
    """Quarter-hour bars: an event at midnight opens the day's first bar, one on an edge opens the bar after it."""
    quarter = 900_000 * MS
    edge, near = 5 * quarter, 5 * quarter - MS
    frame = trades(
        spark,
        [
            ("spot", 0, 1, 7.0, 4.0, True), ("spot", near, 2, 8.0, 0.5, False), ("spot", edge, 3, 9.0, 0.25, True),
            ("perpetual", near, 4, 70.0, 3.0, True), ("perpetual", edge, 5, 71.0, 6.0, True), ("perpetual", DAY_NS - 1, 6, 72.0, 1.0, False),
        ],
    )
    bars = base_bars(frame, quarter)
    assert bars.groupBy("market_type").count().orderBy("market_type").collect() == [("perpetual", 96), ("spot", 96)]
    at = {(r["market_type"], (r["decision_time_ns"] - DAY0) // quarter): r for r in bars.collect()}
    assert [at["spot", n]["quantity"] for n in (1, 2, 5, 6, 7)] == [4.0, 0.0, 0.5, 0.25, 0.0]
    assert [at["spot", n]["last_price"] for n in (1, 4, 5, 6, 96)] == [7.0, 7.0, 8.0, 9.0, 9.0]
    assert [at["spot", n]["seller_trade_count"] for n in (1, 5, 6)] == [1, 0, 1]
    assert [at["perpetual", n]["last_price"] for n in (4, 5, 6, 95, 96)] == [None, 70.0, 71.0, 71.0, 72.0]
    assert at["perpetual", 96]["buyer_trade_count"] == 1 and ("spot", 0) not in at


def test_ties_take_the_highest_id_and_prices_carry_forward(spark):
    frame = trades(
        spark,
        [
            ("spot", 0, 1, 10, 1, False),
            ("spot", 5, 3, 12, 1, False),
            ("spot", 5, 2, 11, 1, True),
            ("perpetual", 5, 9, 50, 1, True),
            ("spot", hours(1), 4, 13, 1, False),
        ],
    )
    bars = market_bars(frame, HOUR * MS)
    assert column(bars, "spot_trade_count", "decision_time_ns")[:3] == [3, 1, 0]
    assert column(bars, "spot_last_price", "decision_time_ns")[:3] == [12.0, 13.0, 13.0]
    assert column(bars, "perpetual_last_price", "decision_time_ns")[:3] == [50.0, 50.0, 50.0]


def test_no_price_before_the_first_event(spark):
    bars = base_bars(trades(spark, [("spot", hours(5), 1, 10, 1, False)]), HOUR * MS)
    prices = column(bars, "last_price", "decision_time_ns")
    assert prices[:5] == [None] * 5 and prices[5:] == [10.0] * 19
    assert column(bars, "trade_count", "decision_time_ns") == [0] * 5 + [1] + [0] * 18


def test_trailing_imbalance_and_direction(spark):
    frame = trades(
        spark,
        [
            ("spot", 0, 1, 100, 2, False),
            ("spot", hours(1), 2, 110, 1, True),
            ("spot", hours(2), 3, 105, 3, True),
            ("perpetual", 0, 4, 101, 1, False),
        ],
    )
    out = features.trade_flow_features(frame, GRID).where("market_type = 'spot'")
    got = column(out, f"quantity_imbalance_{2 * HOUR}ms", "decision_time_ns")[:4]
    assert got == pytest.approx([1.0, 1 / 3, -1.0, -1.0])
    assert column(out, f"log_return_{2 * HOUR}ms", "decision_time_ns")[:2] == [None, None]
    volatility = column(out, f"realised_volatility_{2 * HOUR}ms", "decision_time_ns")
    assert volatility[0] is None and volatility[1] == pytest.approx(math.log(1.1))
    labels = features.future_labels(frame, GRID)
    direction = column(labels, f"target_spot_direction_{HOUR}ms", "decision_time_ns")
    assert direction[:2] == [1, 0] and direction[-1] is None


def test_volatility_skips_bars_without_a_return(spark):
    """A zero price has no log: the returns around it are missing, those of earlier bars in a window are not."""
    prices = [100, 110, 0, 121, 121]
    frame = trades(
        spark, [(m, hours(h), 10 * h + i, p, 1, False) for h, p in enumerate(prices) for i, m in enumerate(("spot", "perpetual"))]
    )
    up = math.log(1.1)
    want = {1: [None, up, None, None, 0.0], 2: [None, up, up, None, 0.0], 3: [None, up, up, up, 0.0]}
    for out in (features.trade_flow_features(frame, GRID), features.realised_volatility(frame, GRID)):
        spot = out.where("market_type = 'spot'")
        for k in want:
            got = column(spot, f"realised_volatility_{k * HOUR}ms", "decision_time_ns")[:5]
            assert got == [None if v is None else pytest.approx(v, abs=1e-12) for v in want[k]]
    lagged = features.feature_frame(frame, GRID)
    got = dict(rows(lagged.select("feature_cutoff_ns", f"spot_realised_volatility_{2 * HOUR}ms")))
    assert got[DAY0 + hours(3)] == pytest.approx(up)


def test_trailing_sums_equal_rolling_sums(spark):
    values = [float((7 * i) % 11) for i in range(50)]
    frame = spark.createDataFrame(
        [("AAA", "spot", "d", i, v, i % 3) for i, v in enumerate(values)],
        "symbol string, market_type string, date string, decision_time_ns long, quantity double, trade_count long",
    )
    steps = (1, 3, 6, 7, 42)
    out = flow.trailing_sums(frame, ["quantity", "trade_count"], steps, MARKET_DAY)
    table = out.orderBy("decision_time_ns").toPandas()
    for k in steps:
        for name in ("quantity", "trade_count"):
            want = table[name].rolling(k, min_periods=1).sum()
            assert table[f"{name}__{k}"].tolist() == pytest.approx(want.tolist())


def _day(spark, extra=()):
    base = [
        (m, int(hours(h)) + 7, 10 * h + i, 100 + h + i + (h * h) % 7, 1 + h % 4, h % 2 == 0)
        for h in range(0, 24)
        for i, m in enumerate(("spot", "perpetual"))
    ]
    return trades(spark, [*base, *extra])


@pytest.mark.parametrize("decision", [HOUR, 2 * HOUR])
def test_feature_frame_equals_lagged_bars(spark, decision):
    grid = GridParams(HOUR, decision, (HOUR, 2 * HOUR, 3 * HOUR), (HOUR, 2 * HOUR), 3 * HOUR, 2)
    source = _day(spark).cache()
    out = features.feature_frame(source, grid).orderBy("decision_time_ns").toPandas()
    flows = features.trade_flow_features(source, grid).toPandas()
    labels = features.future_labels(source, grid).toPandas()
    cross = features.cross_market_features(source, grid).toPandas().sort_values("decision_time_ns")
    name = f"spot_perp_basis_change_{HOUR}ms"
    lagged = cross.set_index("decision_time_ns")[name].shift(2)
    assert out["decision_time_ns"].tolist() == [
        DAY0 + k * decision * MS for k in range(1, 24 * HOUR // decision)
    ]
    assert (out["decision_time_ns"] - out["feature_cutoff_ns"]).unique().tolist() == [2 * HOUR * MS]
    pd.testing.assert_series_equal(
        out.set_index("decision_time_ns")[name], lagged.loc[out["decision_time_ns"]], check_names=False
    )
    for market in ("spot", "perpetual"):
        part = flows[flows["market_type"] == market].sort_values("decision_time_ns")
        for measure in ("quantity", "trade_count", "flow_volatility_interaction"):
            column_name = f"{measure}_{2 * HOUR}ms"
            want = part.set_index("decision_time_ns")[column_name].shift(2).loc[out["decision_time_ns"]]
            got = out.set_index("decision_time_ns")[f"{market}_{column_name}"].astype(float)
            pd.testing.assert_series_equal(got, want.astype(float), check_names=False)
    target = f"target_spot_log_return_{2 * HOUR}ms"
    want = labels.set_index("decision_time_ns")[target].loc[out["decision_time_ns"]]
    pd.testing.assert_series_equal(out.set_index("decision_time_ns")[target], want, check_names=False)


def test_a_future_event_changes_no_earlier_predictor(spark):
    names = flow.predictor_names(GRID)
    before = features.feature_frame(_day(spark), GRID).select("decision_time_ns", *names)
    shock = [("spot", hours(12) + 9, 999, 500, 40, False), ("perpetual", hours(12) + 9, 998, 1, 40, True)]
    after = features.feature_frame(_day(spark, shock), GRID).select("decision_time_ns", *names)
    cut = f"decision_time_ns <= {DAY0 + hours(13)}"
    assert before.where(cut).exceptAll(after.where(cut)).count() == 0
    assert before.exceptAll(after).count() > 0


def test_feature_contract_report(spark):
    frame = features.feature_frame(_day(spark), GRID)
    names = flow.predictor_names(GRID)
    report = validate_features(frame, names, flow.label_names(GRID)).first()
    assert report["rows"] == report["unique_times"] == 11
    assert report["late_cutoffs"] == report["non_finite_values"] == report["imbalances_out_of_range"] == 0
    broken = frame.withColumn("feature_cutoff_ns", frame["decision_time_ns"]).withColumn(
        f"spot_quantity_imbalance_{HOUR}ms", frame["decision_time_ns"] * 1.0
    )
    report = validate_features(broken, names, flow.label_names(GRID)).first()
    assert report["late_cutoffs"] == 11 and report["imbalances_out_of_range"] == 11


def test_parameters_are_validated():
    for bad in (
        {"windows_ms": (150,)},
        {"windows_ms": (1_000, 500)},
        {"label_horizons_ms": (1_000, 1_000)},
        {"feature_lag_bars": 0},
        {"base_interval_ms": 7_777},
    ):
        with pytest.raises(ValueError):
            GridParams(**bad)
    sets = FeatureSets()
    assert (len(sets.baseline), len(sets.additions), len(sets.expanded)) == (12, 15, 27)
    assert (len(sets.hac_baseline), len(sets.hac_expanded)) == (6, 9)
    names = flow.predictor_names(GridParams())
    assert len(names) == 157 and set(sets.expanded) <= set(names)
