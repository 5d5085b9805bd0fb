"""Distinct counts from day sets against count(distinct)."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from adlytics.operators import distinct_sets
from adlytics.params import Period
from adlytics.workspace import Workspace
from helpers import rows_of

SPANS = {
    "first": Period(date(2024, 1, 1), date(2024, 1, 1)),
    "week": Period(date(2024, 1, 1), date(2024, 1, 7)),
    "later": Period(date(2024, 1, 4), date(2024, 1, 9)),
    "none": Period(date(2025, 1, 1), date(2025, 1, 9)),
}


def facts(spark, rows):
    """Ids of two keys over nine days, some NULL; key a is dense, key b sparse."""
    n = F.col("id")
    return spark.range(rows).select(
        F.date_add(F.lit(date(2024, 1, 1)), (n % 9).cast("int")).alias("date"),
        F.when(n % 50 == 0, F.lit(None)).when(n % 40 == 1, F.lit("b")).otherwise(F.lit("a")).alias("key"),
        F.when(n % 11 != 0, F.concat(F.lit("user"), (n * 7919) % 4_001)).alias("person"),
    )


def plain(rows, spans):
    found = [
        rows.filter(p.covers_date(F.col("date"))).groupBy("key").agg(F.countDistinct("person").alias("n")).filter("n > 0").select(F.lit(s), "key", "n")
        for s, p in spans.items()
    ]
    return sorted((tuple(r) for f in found for r in f.collect()), key=repr)


@pytest.mark.parametrize("dense", [1, 64, 100_000])
def test_spans(spark, monkeypatch, dense):
    monkeypatch.setattr(distinct_sets, "DENSE", dense)
    rows = facts(spark, 30_000)
    with Workspace(spark) as space:
        numbers = distinct_sets.number_ids(space, rows, "person")
        sets = space.save(distinct_sets.day_sets(rows, numbers, "person", ["key"]), "sets")
        assert sets.filter("(bitmap is null) = (positions is null)").isEmpty()
        assert rows_of(distinct_sets.count_over(sets, SPANS, ["key"])) == plain(rows, SPANS)


def test_days_that_come_later_keep_numbers(spark):
    rows = facts(spark, 20_000)
    early, late = rows.filter("date <= '2024-01-04'"), rows.filter("date > '2024-01-04'")
    with Workspace(spark) as space:
        numbers = distinct_sets.number_ids(space, early.filter("key = 'a'"), "person")
        more = distinct_sets.number_ids(space, rows, "person", numbers)
        assert more.join(numbers.withColumnRenamed("number", "before"), "id").filter("number <> before").isEmpty()
        assert more.count() == more.select("number").distinct().count() == more.select("id").distinct().count()
        parts = [distinct_sets.day_sets(p, more, "person", ["key"]) for p in (early, late)]
        sets = space.save(parts[0].unionByName(parts[1]), "sets")
        assert rows_of(distinct_sets.count_over(sets, SPANS, ["key"])) == plain(rows, SPANS)


def test_nothing(spark):
    rows = facts(spark, 0)
    with Workspace(spark) as space:
        numbers = distinct_sets.number_ids(space, rows, "person")
        again = distinct_sets.number_ids(space, facts(spark, 9), "person", numbers)
        assert again.count() == 8
        assert rows_of(distinct_sets.count_over(distinct_sets.day_sets(rows, numbers, "person", ["key"]), SPANS, ["key"])) == []
