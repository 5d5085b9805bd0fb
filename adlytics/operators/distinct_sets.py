"""Exact distinct counts over any span of days, from sets kept per day.

Ids are numbered once. A day's set of a key is stored in buckets of BUCKET numbers: as a bitmap where
it is dense, else as single numbers. Sets of days are joined by OR, so a count over a span reads
sets only, never the events again, and equals ``count(distinct id)`` over the span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.params import Period
from adlytics.workspace import Workspace

#: Numbers in a bucket, as the engine's bitmaps have them.
BUCKET = 32_768
#: Members from which a bucket of a set is stored as a bitmap of 4 KB instead of one row each.
DENSE = 512


def number_ids(space: Workspace, ids: DataFrame, id_column: str, known: DataFrame | None = None) -> DataFrame:
    """Saved rows (id, number): every distinct non-NULL id once.

    ``known`` is an earlier result: its numbers stay, and only new ids get new ones, so sets of
    earlier days stay valid.
    """
    wanted = ids.select(F.col(id_column).alias("id")).filter(F.col("id").isNotNull()).distinct()
    first = 0
    if known is not None:
        wanted = wanted.join(known, "id", "left_anti")
        last = known.agg(F.max("number")).first()[0]
        first = 0 if last is None else (last // BUCKET + 1) * BUCKET
    # Numbers of one task follow each other, so ids share buckets.
    new = space.save(wanted.withColumn("number", F.monotonically_increasing_id() + F.lit(first)), "numbers")
    return new if known is None else known.unionByName(new)


def day_sets(facts: DataFrame, numbers: DataFrame, id_column: str, keys: Sequence[str], day: str = "date") -> DataFrame:
    """Rows (day, keys, bucket, bitmap, positions): the distinct ids of every day and key.

    A bucket has either a bitmap or an array of fewer than DENSE positions. NULL ids are in no set;
    a NULL key is a key of its own.
    """
    each = facts.select(day, *keys, F.col(id_column).alias("id")).distinct()
    numbered = each.join(numbers, "id").select(
        day,
        *keys,
        F.expr("bitmap_bucket_number(number)").alias("bucket"),
        F.expr("bitmap_bit_position(number)").alias("position"),
    )
    sets = numbered.groupBy(day, *keys, "bucket").agg(
        F.expr("bitmap_construct_agg(position)").alias("bitmap"),
        F.collect_list(F.col("position").cast("short")).alias("positions"),
    )
    few = F.size("positions") < DENSE
    return sets.withColumns({"bitmap": F.when(~few, F.col("bitmap")), "positions": F.when(few, F.col("positions"))})


def count_over(sets: DataFrame, spans: Mapping[str, Period], keys: Sequence[str], day: str = "date") -> DataFrame:
    """Rows (span, keys, distinct_ids) of named periods, which may overlap.

    Keys without any id in a span have no row.
    """
    covers = [F.when(period.covers_date(F.col(day)), F.lit(name)) for name, period in spans.items()]
    spread = sets.withColumn("span", F.explode(F.array_compact(F.array(*covers))))
    by = ["span", *keys, "bucket"]
    dense = spread.filter(F.col("bitmap").isNotNull()).select(*by, "bitmap")
    sparse = spread.filter(F.col("bitmap").isNull()).select(*by, F.explode(F.col("positions").cast("array<bigint>")).alias("position"))
    sparse = sparse.groupBy(*by).agg(F.expr("bitmap_construct_agg(position)").alias("bitmap"))
    joined = dense.unionByName(sparse).groupBy(*by).agg(F.expr("bitmap_count(bitmap_or_agg(bitmap))").alias("ids"))
    return joined.groupBy("span", *keys).agg(F.sum("ids").alias("distinct_ids"))
