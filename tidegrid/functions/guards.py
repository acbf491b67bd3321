"""Null- and zero-safe column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.params import DAY_NS


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(value: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value, keeping NULL as NULL (greatest and least alone would skip it)."""
    bounded = value
    if upper is not None:
        bounded = F.least(bounded, F.lit(float(upper)))
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(float(lower)))
    return F.when(value.isNotNull(), bounded)


def not_finite(value: Column) -> Column:
    """True for NaN and the infinities, false for NULL and ordinary numbers."""
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.coalesce(bad, F.lit(False))


def day_start_ns(time_ns: Column) -> Column:
    """Midnight (UTC) of the day that contains the timestamp."""
    return time_ns - F.pmod(time_ns, F.lit(DAY_NS))


def date_to_ns(date: Column) -> Column:
    """Nanoseconds since the epoch at UTC midnight of an ISO date string."""
    return F.unix_date(date.cast("date")).cast("long") * F.lit(DAY_NS)


def digits_for(name: str, digits: int) -> int:
    """Quotients of short decimals, and scores of nine digits, often end on a 5 in the ninth
    place, where engines round differently; they keep ten digits."""
    exact = name == "prediction" or "_relative_" in name or "imbalance" in name
    return max(digits, 10) if exact else digits


def rounded(frame: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double column; the results of parallel sums differ in the last bits."""
    return frame.selectExpr(
        *(
            f"round({name}, {digits_for(name, digits)}) AS {name}" if kind == "double" else name
            for name, kind in frame.dtypes
        )
    )
