"""Forward as-of join: the first event at or after a target time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators.bars import event_order
from tidegrid.params import NS_PER_SECOND
from tidegrid.session import stored

HIT = ("event_time_ns", "aggregate_trade_id", "price")


@dataclass(frozen=True)
class EventIndex:
    """Events with the keys they match on, cut into time buckets."""

    events: DataFrame
    keys: tuple[str, ...]
    bucket_ns: int


def bucket_of(time, bucket_ns: int):
    return time - F.pmod(time, F.lit(bucket_ns))


def index_events(events: DataFrame, keys: Sequence[str], bucket_ns: int = 60 * NS_PER_SECOND) -> EventIndex:
    """Prepare events for any number of as-of lookups; nothing is read or written yet.

    A bucket should hold few distinct targets: every event of a requested bucket is compared with them.
    """
    bucket = bucket_of(F.col("event_time_ns"), bucket_ns).alias("_bucket")
    return EventIndex(events.select(*keys, *HIT, bucket), tuple(keys), bucket_ns)


def earliest_events(index: EventIndex, targets: DataFrame) -> DataFrame:
    """(keys, _bucket, _slot, _hit): the earliest event of each bucket and, inside requested buckets, of each slot.

    ``targets`` has the ascending distinct targets of each requested bucket. A slot begins at a target and
    ends at the next one; NULL is the part of a bucket before its first target. The first event at or after
    any target is the earliest of its own slot: no other target lies between the two. So this aggregation,
    combined before the shuffle, keeps every event that can answer a request, and no event is shuffled
    or sorted as a row, however crowded its bucket is.
    """
    slot = F.array_max(F.filter("_targets", lambda at: at <= F.col("event_time_ns")))
    bucket = [*index.keys, "_bucket"]
    order = event_order(F.col("event_time_ns"), F.col("aggregate_trade_id"))
    placed = index.events.join(targets, bucket, "left").select(
        *index.events.columns, slot.alias("_slot"), order.alias("_order")
    )
    return placed.groupBy(*bucket, "_slot").agg(
        F.min("event_time_ns").alias("event_time_ns"),
        *(F.min_by(c, "_order").alias(c) for c in ("aggregate_trade_id", "price")),
    ).select(*bucket, "_slot", F.struct(*HIT).alias("_hit"))


def first_at_or_after(requests: DataFrame, index: EventIndex, target: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_time_ns`` and ``{prefix}_price`` of the first event with time >= target.

    Equal times resolve to the lowest id. Only events with the same keys match, so nothing
    crosses a day when the date is a key; a NULL key or target matches nothing. Requests are read twice.
    Their distinct targets are a stored table, whose true size lets the planner broadcast it to the events
    or not. What is ordered afterwards are non-empty buckets and distinct targets, per key. Equal requests are
    looked up once and all of them are answered.
    """
    keys, bucket = list(index.keys), [*index.keys, "_bucket"]
    asked = requests.where(F.col(target).isNotNull()).select(
        *keys, bucket_of(F.col(target), index.bucket_ns).alias("_bucket"), F.col(target).alias("_slot")
    )
    targets = stored(
        asked.groupBy(*bucket).agg(F.sort_array(F.collect_set("_slot")).alias("_targets")), "targets"
    )
    wanted = targets.select(*bucket, F.explode("_targets").alias("_slot"), F.lit(True).alias("_wanted"))
    both = earliest_events(index, targets).unionByName(wanted, allowMissingColumns=True)
    slots = both.groupBy(*bucket, "_slot").agg(F.first("_hit", True).alias("_hit"), F.max("_wanted").alias("_wanted"))
    # From late to early; the part before a bucket's first target comes last in its bucket.
    backward = W.partitionBy(*keys).orderBy(
        F.col("_bucket").desc(), F.col("_slot").desc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    answers = slots.withColumn("_hit", F.last_value("_hit", True).over(backward)).where("_wanted").select(
        *keys,
        F.col("_slot").alias(target),
        F.col("_hit.event_time_ns").alias(f"{prefix}_time_ns"),
        F.col("_hit.price").alias(f"{prefix}_price"),
    )
    added = (f"{prefix}_time_ns", f"{prefix}_price")
    return requests.join(answers, [*keys, target], "left").select(*requests.columns, *added)
