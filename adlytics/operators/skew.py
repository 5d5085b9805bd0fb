"""Equi-joins in which heavy keys are dealt over several tasks.

Adaptive execution splits a partition only beyond hundreds of megabytes. Here a mergeable
frequent-items sketch names the keys that hold more than a share of all rows, whatever their
size; only those are dealt over parts, and the other side gives them a copy per part. The
sketch has a fixed size and at most ``share`` keys are heavy, so what reaches the driver and
what is broadcast has a bound that does not depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one in SHARE of all rows.
SHARE = 256
#: Counters of the sketch per heavy key it may have to name.
_COUNTERS = 16


@dataclass(frozen=True)
class HeavyKeys:
    """Hashes of heavy keys with the parts each is dealt over; at most ``share`` of them."""

    parts: tuple[tuple[int, int], ...]

    def table(self, spark: SparkSession) -> DataFrame:
        each = [F.struct(F.lit(h).alias("_heavy"), F.lit(n).alias("_parts")) for h, n in self.parts]
        return spark.range(1).select(F.inline(F.array(*each)))


def heavy_keys(rows: DataFrame, on: Sequence[str], share: int = SHARE, weight: int = 1) -> HeavyKeys:
    """Keys of ``rows`` that hold more than one in ``share`` of them.

    ``rows`` is read once: give a stored table. ``weight`` asks for that many times more parts.
    """
    hashed = rows.select(F.xxhash64(*on).alias("key"))
    counters = 1 << math.ceil(math.log2(share * _COUNTERS))
    row = hashed.agg(F.expr(f"approx_top_k(key, {share}, {counters})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    found = [(t["item"], t["count"]) for t in row["top"] or () if t["count"] * share > row["n"]]
    return HeavyKeys(tuple((h, math.ceil(n * share / row["n"]) * weight) for h, n in found))


def _dealt(rows: DataFrame, on: Sequence[str], heavy: HeavyKeys, by: Sequence[Column]) -> DataFrame:
    """Rows with ``_part``: hash of the values in ``by`` for a heavy key, else 0."""
    marked = rows.withColumn("_heavy", F.xxhash64(*on)).join(F.broadcast(heavy.table(rows.sparkSession)), "_heavy", "left")
    part = F.pmod(F.xxhash64(*by), F.col("_parts").cast("long"))
    return marked.withColumn("_part", F.coalesce(part, F.lit(0).cast("long"))).drop("_heavy", "_parts")


def _copied(rows: DataFrame, on: Sequence[str], heavy: HeavyKeys) -> DataFrame:
    """Rows with ``_part``: one copy per part of a heavy key, else one with 0."""
    marked = rows.withColumn("_heavy", F.xxhash64(*on)).join(F.broadcast(heavy.table(rows.sparkSession)), "_heavy", "left")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1)
    return marked.withColumn("_part", F.explode(parts)).drop("_heavy", "_parts")


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", heavy: HeavyKeys | None = None
) -> DataFrame:
    """Equi-join in which the left rows of a heavy key are dealt over several tasks.

    Gives the rows of ``left.join(right, on, how)`` for inner, left, left_semi and left_anti joins.
    ``heavy`` are the heavy keys of the left side; without them they are looked for, which reads
    the left side once more. Rows are dealt by a hash of their other columns, so equal rows stay
    together (count them first), and a task that is repeated deals them as before.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat rows of the copied side")
    heavy = heavy_keys(left, on) if heavy is None else heavy
    if not heavy.parts:
        return left.join(right, list(on), how)
    others = [F.col(c) for c in left.columns if c not in on] or [F.col(c) for c in on]
    joined = _dealt(left, on, heavy, others).join(_copied(right, on, heavy), [*on, "_part"], how)
    return joined.drop("_part")
