"""Trades to feature table: bars, trailing features, basis, labels, decision sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegrid.operators.bars import BAR_KEYS, DAY_KEYS, base_bars, market_bars
from tidegrid.operators.flow import (
    DayOrder,
    add_basis,
    add_trailing_columns,
    basis_windows,
    direction_labels,
    label_names,
    last_return,
    predictor_columns,
    relative_columns,
    return_labels,
    returned,
    trade_flow_columns,
    trailing_sums,
    with_sql,
    zscore_column,
)
from tidegrid.params import DAY_NS, MARKETS, GridParams

MARKET_DAY = DayOrder(*BAR_KEYS)
DAY = DayOrder(*DAY_KEYS)


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def trade_flow_features(trades: DataFrame, grid: GridParams) -> DataFrame:
    """All trailing measures at every base bar of each (symbol, market, date)."""
    bars = add_trailing_columns(base_bars(trades, grid.base_ns), [""], grid, MARKET_DAY)
    return bars.selectExpr(*BAR_KEYS, "decision_time_ns", *_named(trade_flow_columns("", grid)))


def realised_volatility(trades: DataFrame, grid: GridParams) -> DataFrame:
    """Base return and realised volatility per window at every base bar."""
    frame = with_sql(base_bars(trades, grid.base_ns), {"_log_price": "ln(last_price)"})
    frame = with_sql(
        frame, {"_return": f"_log_price - lag(_log_price) {MARKET_DAY.over}"}
    )
    frame = with_sql(
        frame, {"_square": "coalesce(_return * _return, 0.0D)", **last_return("", MARKET_DAY)}
    )
    steps = {window: grid.bars(window) for window in grid.windows_ms}
    frame = trailing_sums(frame, ["_square"], list(steps.values()), MARKET_DAY)
    return frame.selectExpr(
        *BAR_KEYS,
        "decision_time_ns",
        "_return AS base_log_return",
        *(
            f"CASE WHEN {returned('', window)} THEN sqrt(_square__{k}) END "
            f"AS realised_volatility_{window}ms"
            for window, k in steps.items()
        ),
    )


def cross_market_features(trades: DataFrame, grid: GridParams) -> DataFrame:
    """Basis, basis change and relative activity at every base bar."""
    totals = [f"{m}_{name}" for m in MARKETS for name in ("quantity", "trade_count")]
    steps = [grid.bars(window) for window in grid.windows_ms]
    bars = trailing_sums(market_bars(trades, grid.base_ns), totals, steps, DAY)
    frame = with_sql(add_basis(bars), basis_windows(grid, DAY))
    return frame.selectExpr(*DAY_KEYS, "decision_time_ns", *_named(relative_columns(grid)))


def basis_zscore(trades: DataFrame, grid: GridParams) -> DataFrame:
    frame = with_sql(add_basis(market_bars(trades, grid.base_ns)), basis_windows(grid, DAY))
    return frame.selectExpr(
        *DAY_KEYS, "decision_time_ns", "spot_perp_log_basis", *_named(zscore_column(grid))
    )


def future_labels(trades: DataFrame, grid: GridParams) -> DataFrame:
    """Forward spot returns and directions at every base bar; NULL in the tail of the day."""
    bars = with_sql(market_bars(trades, grid.base_ns), {"_log_price": "ln(spot_last_price)"})
    frame = with_sql(bars, return_labels("_log_price", grid, DAY))
    return with_sql(frame, direction_labels(grid)).select(
        *DAY_KEYS, "decision_time_ns", "spot_last_price", *label_names(grid)
    )


def decision_sample(bars: DataFrame, grid: GridParams) -> DataFrame:
    """Keep the decision rows of base-bar frames; the bar labelled midnight is not a decision."""
    offset = f"pmod(decision_time_ns, {DAY_NS})"
    return bars.where(f"{offset} > 0 AND pmod({offset}, {grid.decision_ns}) = 0")


def feature_frame(trades: DataFrame, grid: GridParams) -> DataFrame:
    """Lagged predictors and unlagged labels at every decision time.

    Both markets travel in one row and share one partitioning and one sort per (symbol, date).
    Instead of lagging every predictor, the row ``lag`` bars before a decision is kept and
    only the prices are read ahead, so the wide ratios are computed for decision rows alone.
    """
    lag = grid.feature_lag_bars
    # A decision within the first ``lag`` bars has no earlier row: give it an empty one.
    early = grid.decision_ns <= lag * grid.base_ns
    frame = add_trailing_columns(
        add_basis(market_bars(trades, grid.base_ns, lag if early else 0)),
        [f"{market}_" for market in MARKETS],
        grid,
        DAY,
        alongside={
            **basis_windows(grid, DAY),
            **return_labels("spot__log_price", grid, DAY, ahead=lag),
            **{f"_{m}_now": f"lead({m}_last_price, {lag}) {DAY.over}" for m in MARKETS},
        },
    )
    frame = with_sql(frame, {"_decision": f"decision_time_ns + {lag * grid.base_ns}"})
    # Offset of the decision in its day, and the day it closes a bar of.
    frame = with_sql(frame, {"_offset": f"pmod(_decision - 1, {DAY_NS}) + 1"}).where(
        f"pmod(_offset, {grid.decision_ns}) = 0 AND _offset < {DAY_NS} "
        "AND _spot_now IS NOT NULL AND _perpetual_now IS NOT NULL"
    )
    columns = predictor_columns(grid)
    if early:
        inside = "decision_time_ns > _decision - _offset"
        columns = {name: f"CASE WHEN {inside} THEN {sql} END" for name, sql in columns.items()}
    return with_sql(frame, direction_labels(grid)).selectExpr(
        *DAY_KEYS,
        "_decision AS decision_time_ns",
        "decision_time_ns AS feature_cutoff_ns",
        *_named(columns),
        *label_names(grid),
    )
