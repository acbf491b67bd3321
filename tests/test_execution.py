import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DAY0, DATE0, MS, SECOND, rows, trades

from tidegrid.operators import asof, fills, ledger
from tidegrid.params import ExecutionParams
from tidegrid.plans import backtest
from tidegrid.session import stored


def _requests(spark, targets):
    return spark.createDataFrame(
        [("AAA", DATE0, i, None if t is None else DAY0 + t) for i, t in enumerate(targets)],
        "symbol string, date string, n int, target long",
    )


@pytest.mark.parametrize("bucket_ns", [7_000, 60 * SECOND, 86_400 * SECOND])
def test_asof_equals_binary_search(spark, bucket_ns):
    rng = np.random.default_rng(5)
    # A third of the events in one second, the rest over a few hours; many equal times.
    crowd = 3_600 * SECOND + rng.integers(0, 20, 100) * 1_000
    times = np.concatenate([crowd, rng.integers(0, 6 * 3_600, 200) * SECOND])
    events = trades(spark, [("spot", int(t), i, 100 + i, 1, False) for i, t in enumerate(times)])
    targets = [int(t) for t in np.concatenate([crowd[:30], rng.integers(0, 7 * 3_600, 60) * SECOND, [0]])]
    index = asof.index_events(events, ("symbol", "date"), bucket_ns)
    out = asof.first_at_or_after(_requests(spark, [*targets, None]), index, "target", "hit")
    got = {r["n"]: (r["hit_time_ns"], r["hit_price"]) for r in out.collect()}
    order = np.lexsort((np.arange(len(times)), times))
    ordered = times[order]
    for n, target in enumerate(targets):
        place = np.searchsorted(ordered, target, side="left")
        want = (None, None)
        if place < len(ordered):
            want = (DAY0 + int(ordered[place]), 100.0 + order[place])
        assert got[n] == want
    assert got[len(targets)] == (None, None) and len(got) == len(targets) + 1


@pytest.mark.parametrize("bucket_ns", [SECOND, 3_600 * SECOND])
def test_equal_requests_all_get_an_answer(spark, bucket_ns):
    events = trades(spark, [("spot", i * SECOND, i, 100 + i, 1, False) for i in range(50)])
    index = asof.index_events(events, ("symbol", "date"), bucket_ns)
    requests = _requests(spark, [i * SECOND for i in range(60)])
    out = asof.first_at_or_after(requests.unionByName(requests).unionByName(requests), index, "target", "hit")
    got = [r["hit_time_ns"] for r in out.orderBy("n").collect()]
    want = [DAY0 + i * SECOND for i in range(50)] + [None] * 10
    assert got == [time for time in want for _ in range(3)]


def test_nothing_matches_across_days(spark):
    today = trades(spark, [("spot", 0, 1, 100, 1, False)])
    tomorrow = trades(spark, [("spot", 86_400 * SECOND, 2, 200, 1, False)], date="2024-01-03")
    index = asof.index_events(today.unionByName(tomorrow), ("symbol", "date"))
    out = asof.first_at_or_after(_requests(spark, [1]), index, "target", "hit")
    assert out.first()["hit_time_ns"] is None


def test_no_event_is_shuffled_or_sorted_as_a_row(spark):
    """Events meet their targets by a broadcast of checked size and are combined before the only shuffle."""
    events = trades(spark, [("spot", i * SECOND, i, 100 + i, 1, False) for i in range(50)])
    index = asof.index_events(events, ("symbol", "date"))
    targets = spark.createDataFrame(
        [("AAA", DATE0, DAY0, [DAY0, DAY0 + 5])],
        "symbol string, date string, _bucket long, _targets array<long>",
    )
    targets = stored(targets, "targets")
    plan = asof.earliest_events(index, targets)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert sum("Exchange hashpartitioning" in line for line in lines) == 1
    assert "HashAggregate" in lines[exchange + 1] and "Sort " not in plan
    assert any("BroadcastHashJoin" in line for line in lines[exchange:])


def test_a_null_key_matches_nothing(spark):
    events = trades(spark, [("spot", 5, 1, 100, 1, False)]).withColumn("symbol", F.lit(None).cast("string"))
    asked = _requests(spark, [1]).withColumn("symbol", F.lit(None).cast("string"))
    out = asof.first_at_or_after(asked, asof.index_events(events, ("symbol", "date")), "target", "hit")
    assert out.first()["hit_time_ns"] is None


def _signals(spark, times):
    return spark.createDataFrame(
        [("AAA", DATE0, DAY0 + t, p, 0.1, 1.0, 0.1) for t, p in times],
        "symbol string, date string, decision_time_ns long, prediction double, volatility double, "
        "signal_threshold double, median_volatility double",
    )


def test_fills_follow_latency_and_do_not_overlap(spark):
    events = trades(spark, [("spot", i * SECOND + 1, i, 100 + i, 1, False) for i in range(20)])
    seconds = [(0, 2.0), (1, -2.0), (2, 0.5), (7, -2.0), (8, 2.0), (13, 2.0), (17, 2.0), (30, 2.0)]
    chosen = fills.signals(_signals(spark, [(t * SECOND, p) for t, p in seconds]))
    assert chosen.count() == 7
    candidates = fills.candidate_fills(chosen, fills.spot_index(events), [500], 5)
    statuses = fills.fill_status(candidates)
    got = rows(statuses.select("decision_time_ns", "status", "entry_time_ns", "exit_time_ns", "direction"), "decision_time_ns")
    at = lambda t: DAY0 + t * SECOND + 1
    assert got == [
        (DAY0, "taken", at(1), at(6), 1),
        (DAY0 + 1 * SECOND, "overlapping", at(2), at(7), -1),
        (DAY0 + 7 * SECOND, "taken", at(8), at(13), -1),
        (DAY0 + 8 * SECOND, "overlapping", at(9), at(14), 1),
        # The decision is one nanosecond before the open trade closes.
        (DAY0 + 13 * SECOND, "overlapping", at(14), at(19), 1),
        (DAY0 + 17 * SECOND, "skipped_exit", at(18), None, 1),
        (DAY0 + 30 * SECOND, "skipped_entry", None, None, 1),
    ]
    assert all(entry >= decision + 500 * MS for decision, _, entry, _, _ in got if entry)
    taken = fills.non_overlapping(candidates).orderBy("decision_time_ns").collect()
    assert taken[0]["gross_return"] == pytest.approx(106 / 101 - 1)
    assert taken[1]["gross_return"] == pytest.approx(-(113 / 108 - 1)) and taken[1]["holding_seconds"] == 5.0
    report = rows(fills.execution_diagnostics(statuses, 500), "sizing")
    assert report[0] == ("AAA", 500, 2, 1, 1, "fixed") and report[1][-1] == "inverse_volatility"


def test_sizes_and_costs(spark):
    params = ExecutionParams()
    assert params.reference_cost_bps == 7.0
    frame = spark.createDataFrame(
        [(v, 1.0) for v in (None, 0.0, 0.25, 0.5, 2.0, 100.0)], "volatility double, median_volatility double"
    )
    sized = fills.sized_signals(frame, params).where("sizing = 'inverse_volatility'")
    assert [r["size"] for r in sized.collect()] == [None, 1.0, 1.0, 1.0, 0.5, 0.25]
    costed = fills.apply_cost(
        spark.createDataFrame([(1.0, 0.01), (0.5, 0.01)], "size double, gross_pnl double"), [7.0]
    )
    assert [r["cost_pnl"] for r in costed.collect()] == pytest.approx([0.0007, 0.00035])
    assert [r["net_pnl"] for r in costed.collect()] == pytest.approx([0.0093, 0.00965])
    with pytest.raises(ValueError):
        fills.apply_cost(costed, [-1.0])
    for bad in ({"latencies_ms": (0,)}, {"primary_latency_ms": 3}, {"cost_grid_bps": (-1.0,)}):
        with pytest.raises(ValueError):
            ExecutionParams(**bad)


def _candidates(spark, data):
    return spark.createDataFrame(
        [(s, d, 500, 0.0, e, x, n) for s, d, e, x, n in data],
        "symbol string, date string, latency_ms int, cost_bps double, entry_time_ns long, exit_time_ns long, net_pnl double",
    )


def test_loss_limit_stops_and_resumes(spark):
    data = [
        ("AAA", "d1", 1, 5, -0.03),   # closes at 5 and breaches the limit
        ("BBB", "d1", 2, 20, 0.05),   # open winner, closes at 20
        ("AAA", "d1", 5, 6, 1.0),     # refused: the loss is realised at its entry
        ("BBB", "d1", 10, 11, 1.0),   # refused, and never realised
        ("AAA", "d1", 20, 21, 0.01),  # resumes: the winner has closed
        ("AAA", "d2", 1, 2, 0.01),    # a new day starts clean
    ]
    out = ledger.portfolio_ledger(_candidates(spark, data), ("latency_ms", "cost_bps"), 0.02)
    got = [(r["date"], r["entry_time_ns"]) for r in out.orderBy("date", "entry_time_ns").collect()]
    assert got == [("d1", 1), ("d1", 2), ("d1", 20), ("d2", 1)]


@pytest.mark.parametrize("seed", range(20))
def test_loss_limit_equals_a_walk_in_entry_order(seed):
    rng = np.random.default_rng(seed)
    entry = np.sort(rng.integers(0, 60, 80))
    leave = entry + rng.integers(1, 15, 80)
    net = rng.integers(-5, 6, 80) / 4.0
    want = np.zeros(80, bool)
    for i in range(80):
        closed = want & (leave <= entry[i])
        want[i] = net[closed].sum() > -2.0
    assert (ledger.within_limit(entry, leave, net, 2.0) == want).all()


def test_daily_pnl_keeps_empty_days_and_reconciles(spark):
    trades_ = spark.createDataFrame(
        [("a", "2024-01-01", 1.0, 0.3, 0.1, 0.2, 60.0), ("a", "2024-01-03", 0.5, -0.2, 0.1, -0.3, 30.0)],
        "entity string, date string, size double, gross_pnl double, cost_pnl double, net_pnl double, holding_seconds double",
    )
    entities = spark.createDataFrame([("a",), ("idle",)], "entity string")
    daily = ledger.daily_pnl(trades_, entities, ledger.calendar(trades_), ["entity"])
    assert rows(daily.where("entity = 'a'").select("date", "trades", "net_pnl"), "date") == [
        ("2024-01-01", 1, 0.2), ("2024-01-02", 0, 0.0), ("2024-01-03", 1, -0.3)
    ]
    assert daily.count() == 6
    assert ledger.pnl_reconciliation(trades_, daily, ["entity"]).where("NOT reconciled").count() == 0
    metrics = {r["entity"]: r for r in ledger.performance_metrics(trades_, daily, ["entity"], 365).collect()}
    net = np.array([0.2, 0.0, -0.3])
    a = metrics["a"]
    assert a["annualised_sharpe"] == pytest.approx(np.sqrt(365) * net.mean() / net.std(ddof=1))
    assert a["annualised_sortino"] == 0.0  # one losing day has no sample deviation
    assert a["maximum_drawdown"] == pytest.approx(0.9 / 1.2 - 1)
    assert a["exposure"] == pytest.approx((60 + 15) / (3 * 86_400)) and a["turnover"] == 3.0
    assert a["largest_day_share"] == pytest.approx(0.6) and a["win_rate"] == 0.5
    assert a["break_even_bps"] == pytest.approx(0.1 / 1.5 * 10_000)
    idle = metrics["idle"].asDict()
    assert {v for k, v in idle.items() if k != "entity"} == {0}


def test_drawdown_counts_the_initial_capital(spark):
    daily = spark.createDataFrame(
        [("a", f"d{i}", 0.0, n) for i, n in enumerate((-0.5, -0.7, 0.1))],
        "entity string, date string, gross_pnl double, net_pnl double",
    )
    curve = ledger.equity_curve(daily, ["entity"]).orderBy("date").collect()
    assert [r["drawdown"] for r in curve] == pytest.approx([-0.5, -1.0, -1.0])


def test_risk_weights(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "symbol string, median_volatility double")
    assert dict(rows(ledger.risk_weights(frame).select("symbol", "weight"))) == pytest.approx({"a": 0.75, "b": 0.25})


def test_backtest_over_a_small_market(spark):
    rng = np.random.default_rng(2)
    data = []
    for s in ("AAA", "BBB"):
        for i in range(180):
            data.append(("spot", i * SECOND, i, 100 + rng.normal(), 1, False, s))
    events = trades(spark, data)
    scored = pd.DataFrame(
        [(s, DATE0, DAY0 + i * SECOND, float(rng.normal()), 0.1 + 0.01 * i) for s in ("AAA", "BBB") for i in range(5, 170)],
        columns=["symbol", "date", "decision_time_ns", "prediction", "volatility"],
    )
    frame = spark.createDataFrame(scored)
    params = ExecutionParams(latencies_ms=(500, 1_000), daily_loss_limit=0.001)
    run = backtest.run_backtest(events, frame, frame, params)
    for (symbol, latency), part in run.trades.where("sizing = 'fixed'").toPandas().groupby(["symbol", "latency_ms"]):
        part = part.sort_values("decision_time_ns")
        assert (part["entry_time_ns"] >= part["decision_time_ns"] + latency * MS).all()
        assert (part["decision_time_ns"].to_numpy()[1:] > part["exit_time_ns"].to_numpy()[:-1]).all()
        assert (part["prediction"].abs() >= part["signal_threshold"]).all()
    grid = backtest.sensitivity_grid(run)
    assert grid.count() == 2 * 6 * 3 + 6 * 2
    best = grid.where("entity = 'combined' AND cost_bps = 20").select("trades").first()[0]
    assert best < grid.where("entity = 'combined' AND cost_bps = 0").select("trades").first()[0] * 2
