"""Small frames for hand-computed cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.params import DAY_NS
from tidegrid.sources.trades import VENUE, with_flow_columns

DAY0 = 19_724 * DAY_NS  # 2024-01-02
DATE0 = "2024-01-02"
MS = 1_000_000
SECOND = 1_000_000_000


def trades(spark, rows, date=DATE0, start=DAY0):
    """rows: (market, offset_ns, id, price, quantity, is_buyer_maker[, symbol])."""
    full = [(*row, "AAA") if len(row) == 6 else row for row in rows]
    data = [
        (VENUE, m, s, start + at, i, i, i, float(p), float(q), maker, "test", date)
        for m, at, i, p, q, maker, s in full
    ]
    schema = (
        "exchange string, market_type string, symbol string, event_time_ns long, aggregate_trade_id long, "
        "first_trade_id long, last_trade_id long, price double, quantity double, is_buyer_maker boolean, "
        "source_file string, date string"
    )
    return with_flow_columns(spark.createDataFrame(data, schema))


def rows(frame, *order):
    ordered = frame.orderBy(*order) if order else frame
    return [tuple(r) for r in ordered.collect()]


def column(frame, name, *order):
    return [r[0] for r in frame.orderBy(*order).select(F.col(name)).collect()]
