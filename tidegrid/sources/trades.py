"""Canonical trades: derived columns, strict parsing of raw text and the events view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.guards import date_to_ns
from tidegrid.params import DAY_NS
from tidegrid.session import use_utc
from tidegrid.sources.schema import CANONICAL_TRADES

VENUE = "venue"

# Decimal digits of a present-day Unix timestamp per unit, and ns per unit.
UNIT_BY_DIGITS = {13: ("ms", 1_000_000), 16: ("us", 1_000), 19: ("ns", 1)}


def timestamp_unit(value: Column) -> Column:
    """'ms', 'us' or 'ns' by the number of decimal digits, else NULL."""
    digits = F.length(F.abs(value).cast("string"))
    unit = F.lit(None).cast("string")
    for count, (name, _) in UNIT_BY_DIGITS.items():
        unit = F.when(digits == count, F.lit(name)).otherwise(unit)
    return unit


def to_nanoseconds(value: Column) -> Column:
    """Scale by the detected unit; NULL for an unknown unit."""
    digits = F.length(F.abs(value).cast("string"))
    scaled = F.lit(None).cast("long")
    for count, (_, factor) in UNIT_BY_DIGITS.items():
        scaled = F.when(digits == count, value * F.lit(factor)).otherwise(scaled)
    return scaled


def with_flow_columns(frame: DataFrame) -> DataFrame:
    """Notional, aggressor sign and the signed quantities."""
    sign = F.when(F.col("is_buyer_maker"), F.lit(-1)).otherwise(F.lit(1)).cast("byte")
    return frame.withColumns(
        {"notional": F.col("price") * F.col("quantity"), "aggressor_sign": sign}
    ).withColumns(
        {
            "signed_quantity": F.col("aggressor_sign") * F.col("quantity"),
            "signed_notional": F.col("aggressor_sign") * F.col("notional"),
        }
    )


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Parse all-text rows (``RAW_TRADES``) strictly into canonical trades plus ``date``.

    ANSI casts raise on malformed numbers; an unknown flag, an unknown timestamp scale or a
    time outside the row's UTC day raises too. The unit is taken per row; that a file has one unit
    throughout is checked where it is read, while an archive is unpacked or by ``one_unit``.
    """
    flag = F.lower("is_buyer_maker")
    time = to_nanoseconds(F.col("transact_time").cast("long"))
    opening = date_to_ns(F.col("date"))
    typed = raw.select(
        F.lit(VENUE).alias("exchange"),
        "market_type",
        "symbol",
        "date",
        F.when(time.isNull(), F.raise_error(F.lit("unsupported timestamp scale")).cast("long"))
        .when(
            (time < opening) | (time >= opening + DAY_NS),
            F.raise_error(F.lit("timestamp outside its UTC day")).cast("long"),
        )
        .otherwise(time)
        .alias("event_time_ns"),
        *(
            F.col(name).cast("long").alias(name)
            for name in ("aggregate_trade_id", "first_trade_id", "last_trade_id")
        ),
        F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("double").alias("quantity"),
        F.when(flag.isin("true", "false"), flag == "true")
        .otherwise(F.raise_error(F.lit("invalid is_buyer_maker value")).cast("boolean"))
        .alias("is_buyer_maker"),
        "source_file",
    )
    return with_flow_columns(typed).select(*CANONICAL_TRADES.fieldNames(), "date")


def timestamp_units(raw: DataFrame) -> DataFrame:
    """Per file: time range, its units and whether they agree."""
    time = F.col("transact_time").cast("long")
    return (
        raw.groupBy("source_file")
        .agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))
        .select(
            "source_file",
            timestamp_unit(F.col("min_time")).alias("min_unit"),
            timestamp_unit(F.col("max_time")).alias("max_unit"),
            to_nanoseconds(F.col("min_time")).alias("first_event_ns"),
            to_nanoseconds(F.col("max_time")).alias("last_event_ns"),
        )
        .withColumn(
            "accepted",
            F.coalesce(F.col("min_unit") == F.col("max_unit"), F.lit(False)),
        )
    )


def one_unit(raw: DataFrame) -> DataFrame:
    """``raw``, whose rows raise if their file mixes timestamp units.

    Files are counted first, map-side; the join's small side has one row per rejected file.
    """
    mixed = timestamp_units(raw).where(F.col("min_unit") != F.col("max_unit")).select("source_file", "min_unit", "max_unit")
    said = F.concat("source_file", F.lit(" mixes timestamp units "), "min_unit", F.lit(" and "), "max_unit")
    checked = F.when(F.col("min_unit").isNull(), F.col("transact_time")).otherwise(F.raise_error(said).cast("string"))
    return raw.join(mixed, "source_file", "left").withColumn("transact_time", checked).select(*raw.columns)


def day_bounds_violations(trades: DataFrame) -> DataFrame:
    """Per (symbol, market, date): rows and rows outside [day, next day)."""
    opening = date_to_ns(F.col("date"))
    outside = (F.col("event_time_ns") < opening) | (F.col("event_time_ns") >= opening + DAY_NS)
    return trades.groupBy("symbol", "market_type", "date").agg(
        F.count("*").alias("rows"), F.count_if(outside).alias("outside_day")
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _event_identity() -> dict[str, Column]:
    instant = F.col("ts").cast("timestamp")
    return {
        "symbol": F.when(F.col("user_id") % 2 == 0, "AAA").otherwise("BBB"),
        "market_type": F.when(
            F.col("event_type").isin("click", "view", "error"), "spot"
        ).otherwise("perpetual"),
        "date": F.col("ts").cast("date").cast("string"),
        "micros": F.unix_micros(instant),
        "quantity": (F.get_json_object("props", "$.k").cast("int") + 1) / F.lit(10.0),
    }


def trades_from_events(events: DataFrame) -> DataFrame:
    """The events table seen as canonical trades, with its ``date`` column."""
    identity = _event_identity()
    base = events.select(
        F.lit(VENUE).alias("exchange"),
        identity["market_type"].alias("market_type"),
        identity["symbol"].alias("symbol"),
        identity["date"].alias("date"),
        (identity["micros"] * 1000).alias("event_time_ns"),
        F.col("event_id").alias("aggregate_trade_id"),
        F.col("event_id").alias("first_trade_id"),
        F.col("event_id").alias("last_trade_id"),
        F.col("value").alias("price"),
        identity["quantity"].alias("quantity"),
        (F.col("event_id") % 3 == 0).alias("is_buyer_maker"),
        F.lit("events").alias("source_file"),
    )
    return with_flow_columns(base).select(*CANONICAL_TRADES.fieldNames(), "date")


def raw_text_from_events(events: DataFrame) -> DataFrame:
    """The events table as all-text raw rows: microseconds for spot, milliseconds for perpetual."""
    identity = _event_identity()
    spot = identity["market_type"] == "spot"
    source = F.concat_ws("-", identity["symbol"], identity["market_type"], identity["date"])
    return events.select(
        identity["market_type"].alias("market_type"),
        identity["symbol"].alias("symbol"),
        identity["date"].alias("date"),
        source.alias("source_file"),
        F.col("event_id").cast("string").alias("aggregate_trade_id"),
        F.col("value").cast("string").alias("price"),
        identity["quantity"].cast("string").alias("quantity"),
        F.col("event_id").cast("string").alias("first_trade_id"),
        F.col("event_id").cast("string").alias("last_trade_id"),
        F.when(spot, identity["micros"])
        .otherwise(F.floor(identity["micros"] / 1000))
        .cast("string")
        .alias("transact_time"),
        F.when(F.col("event_id") % 3 == 0, F.when(spot, "True").otherwise("true"))
        .otherwise(F.when(spot, "False").otherwise("false"))
        .alias("is_buyer_maker"),
    )


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(read_events(spark, sf_dir))
