"""Trailing-window features of one market and across the two markets.

The expressions are SQL text: a feature table has over 150 columns, and building those as
Column objects costs seconds of driver time per query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tidegrid.operators.bars import ACTIVITY_COLUMNS, SUM_COLUMNS
from tidegrid.params import MARKETS, NS_PER_MS, GridParams

LONGEST_CHAIN = 16


class DayOrder:
    """SQL text of a window over one day of bars: ``OVER (PARTITION BY .. ORDER BY ..)``."""

    def __init__(self, *keys: str, time: str = "decision_time_ns") -> None:
        self._spec = f"PARTITION BY {', '.join(keys)} ORDER BY {time}"

    @property
    def over(self) -> str:
        return f"OVER ({self._spec})"

    @property
    def running(self) -> str:
        return f"OVER ({self._spec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def last(self, rows: int) -> str:
        return f"OVER ({self._spec} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def with_sql(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns given as SQL text."""
    return frame.selectExpr("*", *(f"{sql} AS {name}" for name, sql in columns.items()))


def trailing_sums(
    frame: DataFrame, columns: Sequence[str], steps: Sequence[int], order: DayOrder
) -> DataFrame:
    """Add ``{column}__{k}`` = sum of the last k rows (fewer at the start of the day).

    Spark recomputes a sliding frame for each row, k additions per row and column. A window
    that is a multiple of a shorter one is instead the sum of a few lagged copies of it; this
    also avoids the drift of an add-and-subtract running total.
    """
    done: list[int] = []
    for k in sorted(set(steps)):
        parts = [j for j in done if k % j == 0 and k // j <= LONGEST_CHAIN]
        added = {}
        for column in columns:
            if k == 1:
                total = column
            elif parts:
                shorter = f"{column}__{parts[-1]}"
                total = " + ".join(
                    [shorter]
                    + [
                        f"lag({shorter}, {copy * parts[-1]}, CAST(0 AS {_kind(column)})) {order.over}"
                        for copy in range(1, k // parts[-1])
                    ]
                )
            else:
                total = f"sum({column}) {order.last(k)}"
            added[f"{column}__{k}"] = total
        frame = with_sql(frame, added)
        done.append(k)
    return frame


def _kind(column: str) -> str:
    return "DOUBLE" if column.endswith((*SUM_COLUMNS, "_square")) else "BIGINT"


def last_return(prefix: str, order: DayOrder) -> dict[str, str]:
    """The time of the latest return of the day so far; a bar without a positive price has none, nor has the next."""
    known = f"CASE WHEN {prefix}_return IS NOT NULL THEN decision_time_ns END"
    return {f"{prefix}_returned": f"max({known}) {order.running}"}


def returned(prefix: str, window_ms: int) -> str:
    """Whether the window that ends at this bar holds a return."""
    return f"decision_time_ns - {prefix}_returned < {window_ms * NS_PER_MS}"


def market_measures(prefix: str, window_ms: int, k: int) -> dict[str, str]:
    """The measures of one market over one window, from its trailing sums."""

    def total(name: str) -> str:
        return f"{prefix}{name}__{k}"

    def imbalance(signed: str, whole: str) -> str:
        # Trades without any amount have no imbalance; no trades at all are balanced.
        ratio = f"least(greatest({total(signed)} / {total(whole)}, -1.0D), 1.0D)"
        return f"CASE WHEN {trades} = 0 THEN 0.0D WHEN {total(whole)} > 0 THEN {ratio} END"

    trades = total("trade_count")
    volatility = f"CASE WHEN {returned(prefix, window_ms)} THEN sqrt(greatest({total('_square')}, 0.0D)) END"
    quantity_imbalance = imbalance("signed_quantity", "quantity")
    measures = {
        "signed_quantity": total("signed_quantity"),
        "signed_notional": total("signed_notional"),
        "quantity": total("quantity"),
        "notional": total("notional"),
        "quantity_imbalance": quantity_imbalance,
        "notional_imbalance": imbalance("signed_notional", "notional"),
        "buyer_trades": total("buyer_trade_count"),
        "seller_trades": total("seller_trade_count"),
        "trade_count": trades,
        "arrival_intensity": f"{trades} / {window_ms / 1000.0}D",
        "average_trade_size": (
            f"CASE WHEN {trades} > 0 THEN {total('quantity')} / {trades} ELSE 0.0D END"
        ),
        "log_return": f"{prefix}_log_return__{k}",
        "realised_volatility": volatility,
        "flow_volatility_interaction": f"({quantity_imbalance}) * ({volatility})",
    }
    return {f"{prefix}{name}_{window_ms}ms": sql for name, sql in measures.items()}


def add_trailing_columns(
    bars: DataFrame,
    prefixes: Sequence[str],
    grid: GridParams,
    order: DayOrder,
    alongside: Mapping[str, str] | None = None,
) -> DataFrame:
    """Log price, base return, its square, k-step returns and all trailing sums.

    All prefixes are handled together, and further window columns can ride ``alongside`` the
    returns: each step is one pass over the day. A price that is not positive has no log, so its returns are NULL.
    """
    steps = [grid.bars(window) for window in grid.windows_ms]
    frame = with_sql(bars, {f"{p}_log_price": f"ln({p}last_price)" for p in prefixes})
    returns = dict(alongside or {})
    for p in prefixes:
        returns[f"{p}_return"] = f"{p}_log_price - lag({p}_log_price) {order.over}"
        for k in steps:
            before = f"lag({p}_log_price, {k}) {order.over}"
            returns[f"{p}_log_return__{k}"] = f"{p}_log_price - {before}"
    frame = with_sql(frame, returns)
    derived = {f"{p}_square": f"coalesce({p}_return * {p}_return, 0.0D)" for p in prefixes}
    for p in prefixes:
        derived.update(last_return(p, order))
    frame = with_sql(frame, derived)
    columns = [p + name for p in prefixes for name in (*ACTIVITY_COLUMNS, "_square")]
    return trailing_sums(frame, columns, steps, order)


def trade_flow_columns(prefix: str, grid: GridParams) -> dict[str, str]:
    columns: dict[str, str] = {}
    for window in grid.windows_ms:
        columns.update(market_measures(prefix, window, grid.bars(window)))
    return columns


def add_basis(bars: DataFrame) -> DataFrame:
    ratio = "CASE WHEN spot_last_price > 0 THEN perpetual_last_price / spot_last_price END"
    return with_sql(bars, {"spot_perp_log_basis": f"ln({ratio})"})


def basis_windows(grid: GridParams, order: DayOrder) -> dict[str, str]:
    """Earlier values of the log basis and the moments of its z-score window."""
    basis, z = "spot_perp_log_basis", order.last(grid.bars(grid.basis_z_window_ms))
    steps = [grid.bars(window) for window in grid.windows_ms]
    return {
        **{f"_basis_before__{k}": f"lag({basis}, {k}) {order.over}" for k in steps},
        "_basis_count": f"count({basis}) {z}",
        "_basis_mean": f"avg({basis}) {z}",
        "_basis_std": f"stddev_samp({basis}) {z}",
    }


def zscore_column(grid: GridParams) -> dict[str, str]:
    """The z-score needs a full window and a positive deviation."""
    full = f"_basis_count = {grid.bars(grid.basis_z_window_ms)} AND _basis_std > 0"
    sql = f"CASE WHEN {full} THEN (spot_perp_log_basis - _basis_mean) / _basis_std END"
    return {f"spot_perp_basis_zscore_{grid.basis_z_window_ms}ms": sql}


def relative_columns(grid: GridParams) -> dict[str, str]:
    """Log basis, basis changes and relative activity (NULL without spot activity)."""
    columns = {"spot_perp_log_basis": "spot_perp_log_basis"}
    for window in grid.windows_ms:
        k, suffix = grid.bars(window), f"{window}ms"
        columns[f"spot_perp_basis_change_{suffix}"] = f"spot_perp_log_basis - _basis_before__{k}"
        for measure, total in (("quantity", "quantity"), ("intensity", "trade_count")):
            spot, perpetual = f"spot_{total}__{k}", f"perpetual_{total}__{k}"
            columns[f"perpetual_spot_relative_{measure}_{suffix}"] = (
                f"CASE WHEN {spot} > 0 THEN {perpetual} / {spot} END"
            )
    return columns


def return_labels(log_price: str, grid: GridParams, order: DayOrder, ahead: int = 0) -> dict[str, str]:
    """Forward log returns, read ``ahead`` bars after the current row; NULL in the tail."""
    now = f"lead({log_price}, {ahead}) {order.over}" if ahead else log_price
    return {
        f"target_spot_log_return_{horizon}ms": (
            f"lead({log_price}, {ahead + grid.bars(horizon)}) {order.over} - {now}"
        )
        for horizon in grid.label_horizons_ms
    }


def direction_labels(grid: GridParams) -> dict[str, str]:
    """1 for a rise, 0 otherwise, NULL where the return is unknown."""
    return {
        f"target_spot_direction_{horizon}ms": (
            f"CAST(target_spot_log_return_{horizon}ms > 0 AS TINYINT)"
        )
        for horizon in grid.label_horizons_ms
    }


def label_names(grid: GridParams) -> list[str]:
    return [
        f"target_spot_{kind}_{horizon}ms"
        for horizon in grid.label_horizons_ms
        for kind in ("log_return", "direction")
    ]


def predictor_columns(grid: GridParams) -> dict[str, str]:
    columns: dict[str, str] = {}
    for market in MARKETS:
        columns.update(trade_flow_columns(f"{market}_", grid))
    return {**columns, **relative_columns(grid), **zscore_column(grid)}


def predictor_names(grid: GridParams) -> list[str]:
    return list(predictor_columns(grid))
