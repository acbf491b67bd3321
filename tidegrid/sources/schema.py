"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of a stored trade.
CANONICAL_TRADES = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("market_type", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("event_time_ns", T.LongType()),
        T.StructField("aggregate_trade_id", T.LongType()),
        T.StructField("first_trade_id", T.LongType()),
        T.StructField("last_trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("notional", T.DoubleType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
        T.StructField("aggressor_sign", T.ByteType()),
        T.StructField("signed_quantity", T.DoubleType()),
        T.StructField("signed_notional", T.DoubleType()),
        T.StructField("source_file", T.StringType()),
    ]
)

# The column order of the two raw trade files.
RAW_SPOT_COLUMNS = (
    "aggregate_trade_id",
    "price",
    "quantity",
    "first_trade_id",
    "last_trade_id",
    "transact_time",
    "is_buyer_maker",
    "is_best_match",
)
RAW_PERPETUAL_HEADER = (
    "agg_trade_id",
    "price",
    "quantity",
    "first_trade_id",
    "last_trade_id",
    "transact_time",
    "is_buyer_maker",
)

RAW_TRADES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "market_type",
            "symbol",
            "date",
            "source_file",
            "aggregate_trade_id",
            "price",
            "quantity",
            "first_trade_id",
            "last_trade_id",
            "transact_time",
            "is_buyer_maker",
        )
    ]
)


class SchemaMismatch(ValueError):
    """The columns of a frame are not the expected set."""


def require_columns(frame: DataFrame, expected, *, exact: bool = True) -> None:
    """Compare column sets before any job runs."""
    present, wanted = set(frame.columns), set(expected)
    missing, extra = sorted(wanted - present), sorted(present - wanted)
    if missing or (exact and extra):
        raise SchemaMismatch(f"missing={missing}, extra={extra if exact else []}")
