"""Right-labelled fixed-grid bars.

An event belongs to the first grid boundary strictly after it, so a bar only contains
events earlier than its label. Bars reset at UTC midnight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.guards import day_start_ns
from tidegrid.params import DAY_NS, MARKETS

SUM_COLUMNS = ("quantity", "notional", "signed_quantity", "signed_notional")
COUNT_COLUMNS = ("trade_count", "buyer_trade_count", "seller_trade_count")
ACTIVITY_COLUMNS = SUM_COLUMNS + COUNT_COLUMNS
BAR_KEYS = ("symbol", "market_type", "date")
DAY_KEYS = ("symbol", "date")


def bar_label(time_ns: Column, interval_ns: int) -> Column:
    """First boundary strictly after the time; the interval divides a day."""
    return time_ns - F.pmod(time_ns, F.lit(interval_ns)) + F.lit(interval_ns)


def event_order(time_ns: Column, trade_id: Column) -> Column:
    """(time, id) as one decimal.

    A struct would order the same way, but its buffer forces a sort-based aggregate; a decimal
    fits the hash aggregate's fixed-width buffer (2.4 times faster on 20M rows here).
    """
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (time_ns.cast("decimal(19,0)") * shift).cast("decimal(38,0)") + trade_id


def _aggregates(prefix: str, belongs: Column | None) -> list[Column]:
    def only(value: Column) -> Column:
        return value if belongs is None else F.when(belongs, value)

    maker = F.col("is_buyer_maker")
    everywhere = F.lit(True) if belongs is None else belongs
    return [
        F.max_by(only(F.col("price")), only(F.col("_order"))).alias(f"{prefix}last_price"),
        *(F.sum(only(F.col(name))).alias(f"{prefix}{name}") for name in SUM_COLUMNS),
        F.count_if(everywhere).alias(f"{prefix}trade_count"),
        F.count_if(everywhere & ~maker).alias(f"{prefix}buyer_trade_count"),
        F.count_if(everywhere & maker).alias(f"{prefix}seller_trade_count"),
    ]


def aggregate_bars(trades: DataFrame, interval_ns: int) -> DataFrame:
    """Non-empty bars per (symbol, market, date): one map-side combined aggregation."""
    return (
        trades.withColumn("_order", event_order(F.col("event_time_ns"), F.col("aggregate_trade_id")))
        .groupBy(*BAR_KEYS, bar_label(F.col("event_time_ns"), interval_ns).alias("decision_time_ns"))
        .agg(*_aggregates("", None))
    )


def aggregate_market_bars(trades: DataFrame, interval_ns: int) -> DataFrame:
    """Non-empty bars per (symbol, date) with both markets side by side.

    Conditional aggregates place the markets in one row, so no market-to-market join follows.
    """
    aggregates = [
        column
        for market in MARKETS
        for column in _aggregates(f"{market}_", F.col("market_type") == market)
    ]
    return (
        trades.withColumn("_order", event_order(F.col("event_time_ns"), F.col("aggregate_trade_id")))
        .groupBy(*DAY_KEYS, bar_label(F.col("event_time_ns"), interval_ns).alias("decision_time_ns"))
        .agg(*aggregates)
    )


def fill_grid(
    bars: DataFrame,
    interval_ns: int,
    keys: Sequence[str],
    prefixes: Sequence[str] = ("",),
    lead_in_bars: int = 0,
) -> DataFrame:
    """Complete each day's grid: zero activity and the last known price in empty bars.

    Every bar is repeated up to the next bar of its day (the first one also backwards to the
    start of the day), which replaces a join with a generated grid. Partitions are whole days,
    so their size is bounded by the grid. ``lead_in_bars`` adds empty rows before the first
    label, for callers that read features a few bars late.
    """
    day = W.partitionBy(*keys).orderBy("decision_time_ns")
    label = F.col("decision_time_ns")
    opening = day_start_ns(label - 1)
    first = F.lag(label).over(day).isNull()
    start = F.when(first, opening + (1 - lead_in_bars) * interval_ns).otherwise(label)
    end = F.coalesce(F.lead(label).over(day) - interval_ns, opening + DAY_NS)
    # With several markets in one row, a bar may lack one market's price: carry it forward. This
    # happens before the grid is filled, on the bars that exist.
    running = day.rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = {
        f"{prefix}last_price": F.last_value(f"{prefix}last_price", True).over(running)
        for prefix in prefixes
        if len(prefixes) > 1
    }
    spread = (
        bars.withColumns({"_from": start, "_to": end, **carried})
        .withColumn("_t", F.explode(F.sequence("_from", "_to", F.lit(interval_ns))))
        .withColumn("_own", F.col("_t") == label)
    )
    columns = [F.col(key) for key in keys] + [F.col("_t").alias("decision_time_ns")]
    for prefix in prefixes:
        price = F.col(f"{prefix}last_price")
        columns.append(F.when(F.col("_t") >= label, price).alias(f"{prefix}last_price"))
        columns += [
            F.when(F.col("_own"), F.coalesce(F.col(prefix + name), F.lit(0.0))).otherwise(0.0)
            .alias(prefix + name)
            for name in SUM_COLUMNS
        ]
        columns += [
            F.when(F.col("_own"), F.col(prefix + name)).otherwise(F.lit(0)).cast("long")
            .alias(prefix + name)
            for name in COUNT_COLUMNS
        ]
    return spread.select(*columns)


def base_bars(trades: DataFrame, interval_ns: int) -> DataFrame:
    """Gap-free bars of each (symbol, market, date)."""
    return fill_grid(aggregate_bars(trades, interval_ns), interval_ns, BAR_KEYS)


def market_bars(trades: DataFrame, interval_ns: int, lead_in_bars: int = 0) -> DataFrame:
    """Gap-free bars of each (symbol, date), both markets in one row."""
    return fill_grid(
        aggregate_market_bars(trades, interval_ns),
        interval_ns,
        DAY_KEYS,
        tuple(f"{market}_" for market in MARKETS),
        lead_in_bars,
    )
