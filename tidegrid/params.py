"""Plain parameter objects, validated on construction.

Their defaults are fixed values of the production run.
"""

from __future__ import annotations

from dataclasses import dataclass

NS_PER_MS = 1_000_000
NS_PER_SECOND = 1_000_000_000
DAY_MS = 86_400_000
DAY_NS = DAY_MS * NS_PER_MS

MARKETS = ("spot", "perpetual")


@dataclass(frozen=True)
class GridParams:
    """Fixed-grid settings: base bars, decisions, trailing windows and label horizons."""

    base_interval_ms: int = 100
    decision_interval_ms: int = 1_000
    windows_ms: tuple[int, ...] = (100, 500, 1_000, 5_000, 10_000)
    label_horizons_ms: tuple[int, ...] = (1_000, 5_000, 10_000)
    basis_z_window_ms: int = 10_000
    feature_lag_bars: int = 1

    def __post_init__(self) -> None:
        if self.base_interval_ms <= 0 or DAY_MS % self.base_interval_ms:
            raise ValueError("base_interval_ms must divide a UTC day")
        if self.feature_lag_bars < 1:
            raise ValueError("feature_lag_bars must be at least 1")
        spans = (
            self.decision_interval_ms,
            self.basis_z_window_ms,
            *self.windows_ms,
            *self.label_horizons_ms,
        )
        if min(spans) <= 0 or any(span % self.base_interval_ms for span in spans):
            raise ValueError("every interval must be a positive multiple of base_interval_ms")
        for name in ("windows_ms", "label_horizons_ms"):
            values = getattr(self, name)
            if list(values) != sorted(set(values)):
                raise ValueError(f"{name} must be sorted and unique")

    @property
    def base_ns(self) -> int:
        return self.base_interval_ms * NS_PER_MS

    @property
    def decision_ns(self) -> int:
        return self.decision_interval_ms * NS_PER_MS

    def bars(self, span_ms: int) -> int:
        return span_ms // self.base_interval_ms


@dataclass(frozen=True)
class FeatureSets:
    """Column lists for the models, derived from a short, a long and a z-score window."""

    short_ms: int = 1_000
    long_ms: int = 5_000
    z_ms: int = 10_000

    def _pairs(self, market: str, measures: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(
            f"{market}_{measure}_{span}ms"
            for measure in measures
            for span in (self.short_ms, self.long_ms)
        )

    @property
    def baseline(self) -> tuple[str, ...]:
        measures = (
            "log_return",
            "quantity_imbalance",
            "signed_notional",
            "trade_count",
            "notional",
            "realised_volatility",
        )
        return self._pairs("spot", measures)

    @property
    def additions(self) -> tuple[str, ...]:
        measures = (
            "log_return",
            "quantity_imbalance",
            "signed_notional",
            "trade_count",
            "realised_volatility",
        )
        return self._pairs("perpetual", measures) + (
            "spot_perp_log_basis",
            f"spot_perp_basis_change_{self.short_ms}ms",
            f"spot_perp_basis_zscore_{self.z_ms}ms",
            f"perpetual_spot_relative_quantity_{self.short_ms}ms",
            f"perpetual_spot_relative_intensity_{self.short_ms}ms",
        )

    @property
    def expanded(self) -> tuple[str, ...]:
        return self.baseline + self.additions

    @property
    def hac_baseline(self) -> tuple[str, ...]:
        return self._pairs("spot", ("log_return", "quantity_imbalance")) + (
            f"spot_trade_count_{self.short_ms}ms",
            f"spot_realised_volatility_{self.long_ms}ms",
        )

    @property
    def hac_expanded(self) -> tuple[str, ...]:
        return (
            self.hac_baseline
            + self._pairs("perpetual", ("quantity_imbalance",))
            + ("spot_perp_log_basis",)
        )


@dataclass(frozen=True)
class ExecutionParams:
    """Fill timing, sizing, cost and risk settings."""

    latencies_ms: tuple[int, ...] = (100, 500, 1_000, 2_000, 5_000)
    primary_latency_ms: int = 500
    holding_seconds: int = 5
    threshold_sigma: float = 1.0
    entry_fee_bps: float = 2.0
    exit_fee_bps: float = 2.0
    slippage_bps_per_side: float = 1.0
    spread_bps_per_side: float = 0.5
    cost_grid_bps: tuple[float, ...] = (0.0, 2.0, 5.0, 7.0, 10.0, 20.0)
    maximum_size: float = 1.0
    minimum_multiplier: float = 0.25
    maximum_multiplier: float = 2.0
    daily_loss_limit: float = 0.02
    annualisation_days: int = 365

    def __post_init__(self) -> None:
        if not self.latencies_ms or min(self.latencies_ms) <= 0:
            raise ValueError("latencies must be strictly positive")
        if self.primary_latency_ms not in self.latencies_ms:
            raise ValueError("the primary latency must be one of the latencies")
        if min(self.cost_grid_bps) < 0:
            raise ValueError("costs cannot be negative")
        if self.holding_seconds <= 0 or self.daily_loss_limit <= 0:
            raise ValueError("holding time and loss limit must be positive")

    @property
    def reference_cost_bps(self) -> float:
        """All-in round trip: both fees, and slippage and spread on both sides."""
        per_side = self.slippage_bps_per_side + self.spread_bps_per_side
        return self.entry_fee_bps + self.exit_fee_bps + 2 * per_side
