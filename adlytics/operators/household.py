"""Household IP prefixes and the household flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.params import HOUSEHOLD_TIER_CAP, Period
from adlytics.operators.joins import left_join


def _eligible(mapping: DataFrame, days: Period, region: str, tier_cap: int | None) -> DataFrame:
    cap = HOUSEHOLD_TIER_CAP[region] if tier_cap is None else tier_cap
    return mapping.filter(
        days.covers_date(F.col("date")) & (F.col("app_region") == region) & (F.col("order_tier") <= cap)
    )


def household_prefixes(
    mapping: DataFrame, days: Period, region: str = "eu", tier_cap: int | None = None
) -> DataFrame:
    """Distinct (date_h, ip_address_prefix) of one region up to its tier cap.

    The platform ids of a prefix play no part in the result, so they are not unnested.
    """
    rows = _eligible(mapping, days, region, tier_cap)
    return rows.select(F.col("date").alias("date_h"), "ip_address_prefix").distinct()


def household_prefix_rows(
    mapping: DataFrame, days: Period, region: str = "eu", tier_cap: int | None = None
) -> DataFrame:
    """Like ``household_prefixes`` with the number of rows unnesting the ids would give."""
    rows = _eligible(mapping, days, region, tier_cap)
    unnested = F.greatest(F.coalesce(F.array_size("user_ad_platform_ids"), F.lit(0)), F.lit(1))
    return rows.groupBy(F.col("date").alias("date_h"), "ip_address_prefix").agg(
        F.sum(unnested).alias("prefix_rows")
    )


def flag_household(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``is_household``: the row's address is a household prefix on the row's day."""
    key = F.concat(F.col("date_h").cast("string"), F.lit(" "), F.col("ip_address_prefix"))
    listed = prefixes.select(key.alias("prefix_key"), F.lit(True).alias("listed"))
    keyed = rows.withColumn(
        "address_key", F.concat(F.col("date_ts").cast("string"), F.lit(" "), F.col("ip_address"))
    )
    joined = left_join(keyed, listed, "address_key", "prefix_key")
    return joined.withColumn("is_household", F.coalesce("listed", F.lit(False))).drop("listed", "address_key")
