"""Ordered lookups along a time axis that stay parallel for a hot key.

A window over a whole key would put a hot key into one task. Here time is cut into slots
of a minute: the fine step looks inside one (key, slot), the coarse step runs over one row
per (key, slot), at most 1440 a day. Keys must not be NULL; ``at`` is in microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MINUTE_MICROS = 60_000_000


def _with_slot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slot", F.floor(F.col("at") / F.lit(MINUTE_MICROS)))


def _both(probes: DataFrame, events: DataFrame) -> DataFrame:
    """Probes and events on one timeline, told apart by ``is_probe``."""
    marked = probes.withColumn("is_probe", F.lit(True)).unionByName(
        events.withColumn("is_probe", F.lit(False)), allowMissingColumns=True
    )
    return _with_slot(marked)


def first_at_or_after(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Probes (keys, at and any further columns) with the first event at that instant or later.

    ``hit`` is a struct of the event's ``at`` and payload, or NULL. Among events of one
    instant the smallest payload is taken.
    """
    found = events.groupBy(*keys, "at").agg(F.min(F.struct("at", *payload)).alias("event"))
    marks = _both(probes, found)
    rest_of_slot = (
        W.partitionBy(*keys, "slot").orderBy(F.col("at").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    near = marks.withColumn("near", F.min("event").over(rest_of_slot)).filter("is_probe")
    later_slots = W.partitionBy(*keys).orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    far = (
        marks.groupBy(*keys, "slot")
        .agg(F.min("event").alias("first_event"))
        .select(*keys, "slot", F.min("first_event").over(later_slots).alias("far"))
    )
    return near.join(far, [*keys, "slot"]).select(*probes.columns, F.coalesce("near", "far").alias("hit"))


def count_before(probes: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes with ``n_before``, the sum of ``n`` over the points strictly before them."""
    marks = _both(probes, points.groupBy(*keys, "at").agg(F.sum("n").alias("n")))
    # A probe comes before the points of its own instant.
    earlier_in_slot = (
        W.partitionBy(*keys, "slot")
        .orderBy("at", F.col("is_probe").desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    near = marks.withColumn("near", F.sum("n").over(earlier_in_slot)).filter("is_probe")
    earlier_slots = W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    far = (
        marks.groupBy(*keys, "slot")
        .agg(F.sum("n").alias("in_slot"))
        .select(*keys, "slot", F.sum("in_slot").over(earlier_slots).alias("far"))
    )
    none = F.lit(0).cast("bigint")
    before = F.coalesce("near", none) + F.coalesce("far", none)
    return near.join(far, [*keys, "slot"]).select(*probes.columns, before.alias("n_before"))
