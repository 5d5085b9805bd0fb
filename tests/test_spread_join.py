"""Joins that deal heavy keys: the same rows, in tasks of about one size."""

import statistics

import pytest
from pyspark.sql import functions as F

from adlytics.operators.skew import heavy_keys, spread_join
from helpers import rows_of


@pytest.fixture
def many_tasks(spark):
    """Plain shuffles into 64 tasks: nothing is broadcast, split or put together by the engine."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def sides(spark):
    """A third of the left rows have one key, a tenth another, some none."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 10 == 1, F.lit("warm")).when(n % 101 == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), n % 997))
    left = spark.range(60_000).select(key.alias("key"), (n % 2).alias("half"), n.alias("value"))
    names = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 2).alias("half"), F.col("id").alias("name"))
    hot = spark.sql("SELECT * FROM VALUES ('hot', 0L, 1000L), ('hot', 1L, 1001L), ('hot', 1L, 1002L), ('warm', 1L, 1003L), (NULL, 0L, 1004L)")
    return left, names.unionByName(hot.toDF("key", "half", "name"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["key"], ["key", "half"]])
def test_rows(spark, how, on):
    left, right = sides(spark)
    other = right if len(on) == 2 else right.drop("half")
    found = spread_join(left, other, on, how)
    assert sorted(found.columns) == sorted(left.join(other, on, how).columns)
    expected = left.join(other, on, how)
    assert rows_of(found, *sorted(found.columns)) == rows_of(expected, *sorted(expected.columns))


def test_tasks_are_even(spark, many_tasks):
    left, right = sides(spark)

    def largest(joined):
        by_task = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max("name"))
        sizes = [r["n"] for r in by_task.collect()]
        return max(sizes) / statistics.median(sizes)

    known = left.filter("key is not null")
    plain = right.filter("half = 1").dropDuplicates(["key"]).drop("half")
    assert largest(known.join(plain, "key", "left")) > 10
    assert largest(spread_join(known, plain, ["key"], "left")) < 4


def test_heavy_keys_are_bounded(spark):
    left, _ = sides(spark)
    found = heavy_keys(left, ["key"], share=20)
    assert len(found.parts) == 2 and sorted(n for _, n in found.parts) == [2, 7]
    assert heavy_keys(left.filter("value < 0"), ["key"]).parts == ()
    even = spark.range(50_000).select((F.col("id") % 5_000).alias("key"))
    assert heavy_keys(even, ["key"]).parts == ()


def test_other_joins_are_refused(spark):
    left, right = sides(spark)
    with pytest.raises(ValueError, match="full"):
        spread_join(left, right, ["key"], "full")
