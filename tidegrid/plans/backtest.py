"""Predictions and events to fills, costs, daily P&L and the portfolio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.ordering import exact_median
from tidegrid.operators import fills, ledger
from tidegrid.params import ExecutionParams
from tidegrid.session import stored

SCENARIO = ("entity", "latency_ms", "cost_bps", "sizing")


def signal_thresholds(calibration: DataFrame, sigma: float) -> DataFrame:
    """Per symbol: sigma times the population deviation of calibration predictions, and the
    exact median volatility of the same rows."""
    spread = calibration.groupBy("symbol").agg(
        (sigma * F.stddev_pop("prediction")).alias("signal_threshold")
    )
    volatility = exact_median(calibration, ["symbol"], "volatility", "median_volatility")
    return spread.join(volatility, "symbol")


def with_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds have one row per symbol; Spark broadcasts them when they are small."""
    return scored.join(thresholds, "symbol")


@dataclass(frozen=True)
class Backtest:
    """Taken trades per (symbol, latency, sizing) with gross P&L, and what they rest on."""

    signals: DataFrame
    statuses: DataFrame
    trades: DataFrame
    thresholds: DataFrame
    dates: DataFrame
    params: ExecutionParams


def run_backtest(
    trades: DataFrame, calibration: DataFrame, evaluation: DataFrame, params: ExecutionParams
) -> Backtest:
    """A backtest with thresholds from the predictions of the calibration rows."""
    thresholds = stored(signal_thresholds(calibration, params.threshold_sigma), "thresholds")
    return run_signals(trades, evaluation, thresholds, params)


def run_signals(
    trades: DataFrame, evaluation: DataFrame, thresholds: DataFrame, params: ExecutionParams
) -> Backtest:
    """Signals, fills at every latency and the non-overlapping choice, once for all scenarios.

    ``thresholds`` has a row (symbol, signal_threshold, median_volatility) per symbol, a model table for
    example. Neither size nor cost influences which trades are taken, so the choice is made once per
    latency; sizes and costs are columns added afterwards. The chosen trades are stored: they
    are few and every scenario table reads them.
    """
    thresholds = thresholds.select("symbol", "signal_threshold", "median_volatility")
    chosen = fills.signals(with_thresholds(evaluation, thresholds))
    candidates = fills.candidate_fills(
        chosen, fills.spot_index(trades), params.latencies_ms, params.holding_seconds
    )
    statuses = stored(fills.fill_status(candidates), "fills")
    taken = statuses.where("status = 'taken'").drop("status")
    sized = fills.sized_signals(taken, params).where(
        (F.col("sizing") == "fixed") | (F.col("latency_ms") == params.primary_latency_ms)
    )
    gross = sized.withColumn("gross_pnl", F.col("size") * F.col("gross_return"))
    return Backtest(chosen, statuses, gross, thresholds, ledger.calendar(evaluation), params)


def primary_trades(run: Backtest) -> DataFrame:
    """Fixed-size trades at the primary latency and the reference cost."""
    chosen = (F.col("latency_ms") == run.params.primary_latency_ms) & (F.col("sizing") == "fixed")
    return fills.apply_cost(run.trades.where(chosen), [run.params.reference_cost_bps])


def weighted_candidates(run: Backtest, costs) -> DataFrame:
    """Fixed-size trades of all latencies, weighted by inverse risk, at every cost."""
    weights = ledger.risk_weights(run.thresholds)
    fixed = run.trades.where("sizing = 'fixed'")
    return fills.apply_cost(ledger.portfolio_candidates(fixed, weights), costs)


def portfolio(run: Backtest, costs) -> DataFrame:
    candidates = weighted_candidates(run, costs)
    return ledger.portfolio_ledger(
        candidates, ("latency_ms", "cost_bps"), run.params.daily_loss_limit
    )


def scenario_trades(run: Backtest) -> DataFrame:
    """Costed trades of every symbol and of the combined portfolio, one ``entity`` column."""
    costs = run.params.cost_grid_bps
    single = fills.apply_cost(run.trades, costs).withColumn("entity", F.col("symbol"))
    combined = portfolio(run, costs).withColumn("entity", F.lit("combined"))
    return single.unionByName(combined)


def scenario_entities(run: Backtest) -> DataFrame:
    """Every scenario that is reported, also those that never trade."""
    params = run.params
    grid = F.array(
        *(
            F.struct(
                F.lit(latency).alias("latency_ms"),
                F.lit(float(cost)).alias("cost_bps"),
                F.lit(sizing).alias("sizing"),
            )
            for latency in params.latencies_ms
            for cost in params.cost_grid_bps
            for sizing in ("fixed", "inverse_volatility")
            if sizing == "fixed" or latency == params.primary_latency_ms
        )
    )
    combined = run.trades.sparkSession.createDataFrame([("combined",)], "entity string")
    names = run.thresholds.select(F.col("symbol").alias("entity")).unionByName(combined)
    return names.select("entity", F.inline(grid)).where("entity <> 'combined' OR sizing = 'fixed'")


def sensitivity_grid(run: Backtest) -> DataFrame:
    """Performance of every entity, latency, cost and sizing rule in one job."""
    trades = stored(scenario_trades(run), "scenarios")
    daily = ledger.daily_pnl(trades, scenario_entities(run), run.dates, SCENARIO)
    return ledger.performance_metrics(trades, daily, SCENARIO, run.params.annualisation_days)
