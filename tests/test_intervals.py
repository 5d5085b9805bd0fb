"""Interval joins against all pairs, and the sizes of their slots when one key holds almost everything."""

import random

import pytest
from pyspark.sql import functions as F

from adlytics.operators.intervals import interval_join, slotted
from adlytics.workspace import Workspace

MINUTE = 60_000_000
POINTS = "k string, g int, at long, p int"
INTERVALS = "k string, g int, since long, until long, i int"


def frames(spark, points, intervals):
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)


def joined(spark, points, intervals, most, space=None):
    found = interval_join(*frames(spark, points, intervals), ["k", "g"], "at", "since", "until", most, space)
    assert found.columns == ["k", "g", "at", "p", "since", "until", "i"]
    return sorted((r["p"], r["i"]) for r in found.collect())


def all_pairs(points, intervals):
    return sorted(
        (p, i)
        for k, g, at, p in points
        for l, h, since, until, i in intervals
        if None not in (k, g, at, since, until) and (k, g) == (l, h) and since <= at <= until
    )


@pytest.mark.parametrize("most", [1, 3, 40, 50_000])
def test_every_pair_is_found_once(spark, tmp_path, most):
    draw = random.Random(most)

    def key():
        return draw.choice(["hot"] * 6 + ["a", "b", "c", None]), draw.choice([1, 1, 1, 2, None])

    def instant():
        # Also before 1970, on the edges of minutes, and often the same.
        return draw.choice([draw.randrange(-40, 40) * MINUTE + draw.choice([-1, 0, 1]), 5, draw.randrange(9 * MINUTE)])

    points = [(*key(), instant(), n) for n in range(400)]
    intervals = []
    for n in range(200):
        since = instant()
        intervals.append((*key(), since, since + draw.choice([0, 1, MINUTE, 30 * MINUTE, -1]), n))
    points += [("hot", 1, None, 900), ("hot", 1, 7, 901), ("hot", 1, 7, 901)]
    intervals += [("hot", 1, None, 7, 900), ("hot", 1, 0, None, 901), ("hot", 1, -(10**15), 10**15, 902)]
    with Workspace(spark, str(tmp_path)) as space:
        assert joined(spark, points, intervals, most, space) == all_pairs(points, intervals)


def test_empty_tables(spark):
    points, intervals = [("a", 1, 5, 1)], [("a", 1, 0, 9, 1)]
    for some in ((points, []), ([], intervals), ([], [])):
        assert joined(spark, *some, 1) == []


def test_columns_of_both_sides_are_refused(spark):
    points, intervals = frames(spark, [], [])
    with pytest.raises(ValueError, match="both sides"):
        interval_join(points, intervals.withColumnRenamed("i", "p"), ["k", "g"], "at", "since", "until")
    with pytest.raises(ValueError, match="at least one"):
        interval_join(points, intervals, ["k", "g"], "at", "since", "until", 0)


def test_a_hot_key_fills_even_slots(spark, tmp_path):
    """One person holds all but a few points; a third of them fall into one minute."""
    n, most = 60_000, 500
    at = F.when(F.col("id") % 3 == 0, F.lit(7 * MINUTE) + F.col("id")).otherwise(F.col("id") * 1_000_000)
    points = spark.range(n).select(F.lit("hot").alias("k"), F.lit(1).alias("g"), at.alias("at"), F.col("id").cast("int").alias("p"))
    cold = [(f"k{i}", 1, i * MINUTE, n + i) for i in range(200)]
    points = points.unionByName(spark.createDataFrame(cold, POINTS))
    wide = [("hot", 1, i * MINUTE, (i + 60) * MINUTE, i) for i in range(300)] + [(f"k{i}", 1, 0, 10**12, 300 + i) for i in range(200)]
    intervals = spark.createDataFrame(wide, INTERVALS)
    with Workspace(spark, str(tmp_path)) as space:
        placed, spread = slotted(points, intervals, ["k", "g"], "at", "since", "until", most, space)
        sizes = [r["count"] for r in placed.groupBy("k", "g", "_slot").count().collect()]
        assert sum(sizes) == n + 200
        assert max(sizes) < 1.3 * most
        # A cold interval is never copied; a hot one visits the slots of its hour and two more at most.
        copies = {r["i"]: r["count"] for r in spread.groupBy("i").count().collect()}
        assert all(copies[300 + i] == 1 for i in range(200))
        times = [r["at"] for r in points.filter("k = 'hot'").select("at").collect()]
        for i in range(0, 300, 17):
            touched = sum(i * MINUTE <= t < (i + 61) * MINUTE for t in times)
            assert copies[i] <= touched / most + 2
        found = interval_join(points, intervals, ["k", "g"], "at", "since", "until", most, space)
        counted = {r["i"]: r["count"] for r in found.groupBy("i").count().collect()}
    for i in range(0, 300, 17):
        assert counted[i] == sum(i * MINUTE <= t <= (i + 60) * MINUTE for t in times)
    assert all(counted[300 + i] == 1 for i in range(200))
