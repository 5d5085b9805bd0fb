"""Joins of points with intervals of the same key, in slots of time that follow the data.

Fixed slots are too wide for a hot key and needless for all others. Here the points of a key
are numbered in time order, and a slot is a run of ``most`` of them: a key with fewer points
has one slot and its intervals are not copied at all, while an interval of a crowded key
visits only the slots its ends enclose, at most two more than its points would fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adlytics.operators.skew import spread_join
from adlytics.operators.timeline import MINUTE_MICROS
from adlytics.workspace import Workspace

#: Points of one key that one slot holds.
MOST_POINTS = 50_000
_SLOT = "_slot"


def _minute(at: str) -> Column:
    return F.floor(F.col(at) / F.lit(MINUTE_MICROS))


def _minutes(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, ends: Sequence[str]) -> DataFrame:
    """Minutes of each key with the number of its points before and in each.

    A minute is listed when a point or an end of an interval falls into it, so a key has at
    most 1440 rows a day.
    """
    of_points = points.select(*keys, _minute(at).alias("_minute"), F.lit(1).cast("long").alias("_n"))
    of_ends = intervals.select(
        *keys, F.explode(F.array(*[_minute(e) for e in ends])).alias("_minute"), F.lit(0).cast("long").alias("_n")
    )
    listed = of_points.unionByName(of_ends).groupBy(*keys, "_minute").agg(F.sum("_n").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_minute").rowsBetween(W.unboundedPreceding, -1)
    return listed.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))


def _looked_up(rows: DataFrame, minutes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows with ``_before`` and ``_n`` of their minute, NULL for keys that are not crowded."""
    return spread_join(rows.withColumn("_minute", _minute(at)), minutes, [*keys, "_minute"], "left").drop("_minute")


def slotted(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    until: str,
    most: int = MOST_POINTS,
    space: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Points with their ``_slot``, and intervals once per slot that may hold a point of theirs.

    The points of a minute with more than ``most`` of them are dealt over its slots by a hash
    of their columns, so no slot is larger than others but by chance.
    """
    complete = points.dropna(subset=[*keys, at])
    spans = intervals.dropna(subset=[*keys, since, until]).filter(F.col(since) <= F.col(until))
    whole = F.lit(0).cast("long").alias(_SLOT)
    sizes = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    crowded = sizes.filter(F.col("_all") > most).select(*keys)
    if crowded.isEmpty():
        return complete.select("*", whole), spans.select("*", whole)
    crowded = crowded if space is None else space.save(crowded, "crowded")
    counted, ending = (rows.join(crowded, list(keys), "left_semi") for rows in (complete, spans))
    found = _minutes(counted, ending, keys, at, (since, until))
    found = found if space is None else space.save(found, "minutes")

    def slot(number: Column) -> Column:
        return F.coalesce(F.floor(number / F.lit(most)), F.lit(0).cast("long"))

    within = F.pmod(F.xxhash64(*points.columns), F.col("_n"))
    placed = _looked_up(complete, found, keys, at).select(*points.columns, slot(F.col("_before") + within).alias(_SLOT))
    first = _looked_up(spans, found, keys, since).select(*intervals.columns, slot(F.col("_before")).alias("_first"))
    # The last point of the last minute; a minute without points may end in the slot before.
    end = slot(F.col("_before") + F.greatest(F.col("_n") - 1, F.lit(0)))
    both = _looked_up(first, found, keys, until).select(*intervals.columns, "_first", end.alias("_last"))
    return placed, both.withColumn(_SLOT, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    until: str,
    most: int = MOST_POINTS,
    space: Workspace | None = None,
) -> DataFrame:
    """Every pair of a point and an interval of equal keys with ``since <= at <= until``.

    ``at``, ``since`` and ``until`` are microseconds; a row that lacks one of them or a key
    pairs with nothing, nor does an interval that ends before it begins. The result has the
    columns of both sides, which share none but the keys. Equal rows stay together, so count
    them first. Both sides are read several times: give stored tables. The intervals of a slot
    that hold a share of all of them are dealt over several tasks (``spread_join``).
    """
    shared = set(points.columns) & set(intervals.columns) - set(keys)
    if shared:
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    if most < 1:
        raise ValueError("a slot holds at least one point")
    placed, spread = slotted(points, intervals, keys, at, since, until, most, space)
    pairs = spread_join(spread, placed, [*keys, _SLOT])
    others = [c for c in (*points.columns, *intervals.columns) if c not in keys]
    return pairs.filter(F.col(at).between(F.col(since), F.col(until))).select(*keys, *others)
