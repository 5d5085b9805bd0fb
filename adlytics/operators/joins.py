"""Join shapes shared by the operators.

No join carries a broadcast hint: Spark broadcasts a side only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NULL_SPREAD = 1024


def spread_null_key(key: Column, by: Sequence[Column]) -> Column:
    """Replace NULL keys by values that match nothing, spread over many partitions.

    NULL never matches in an outer join, yet all NULL keys would meet in one task.
    """
    salt = F.pmod(F.xxhash64(*by), F.lit(_NULL_SPREAD)).cast("string")
    return F.coalesce(key, F.concat(F.lit("\x00"), salt))


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on one nullable string key; the right key column is dropped."""
    keyed = left.withColumn("_key", spread_null_key(F.col(left_key), [F.col(c) for c in left.columns]))
    other = right.filter(F.col(right_key).isNotNull()).withColumnRenamed(right_key, "_key")
    return keyed.join(other, "_key", "left").drop("_key")


def keep_known(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is in a list; a NULL key never is."""
    listed = known.filter(F.col(known_key).isNotNull()).select(F.col(known_key).alias("_key")).distinct()
    return rows.join(listed, F.col(key) == F.col("_key"), "left_semi")


def drop_known(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is not in a list; a NULL key stays."""
    listed = known.filter(F.col(known_key).isNotNull()).select(F.col(known_key).alias("_key")).distinct()
    salted = spread_null_key(F.col(key), [F.col(c) for c in rows.columns])
    return rows.join(listed, salted == F.col("_key"), "left_anti")


def not_in(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """SQL ``NOT IN``: like ``drop_known``, but NULL decides as SQL says.

    An empty list keeps every row; otherwise a NULL key is dropped, and a NULL inside the
    list drops everything. Spark's own plan for NOT IN broadcasts the list whatever its
    size, so the two NULL rules are read from a one-row aggregate instead.
    """
    facts = known.agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(F.col(known_key).isNull()).alias("missing"),
    )
    empty = facts.select(F.col("listed") == 0).scalar()
    no_null = facts.select(F.col("missing") == 0).scalar()
    return drop_known(rows, key, known, known_key).filter(empty | (F.col(key).isNotNull() & no_null))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL equals NULL, as grouping does."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    test = F.lit(True)
    for key in keys:
        test = test & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])
