"""Sums of small matrices that tasks emit as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def array_sums(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, m): the element-wise sum of the array column ``m`` of each key."""
    summed = frame.select(*keys, F.posexplode("m")).groupBy(*keys, "pos").agg(F.sum("col").alias("v"))
    packed = F.sort_array(F.collect_list(F.struct("pos", "v")))
    return summed.groupBy(*keys).agg(packed["v"].alias("m"))
