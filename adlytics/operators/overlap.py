"""Whole delivery against one advertiser's conversions: mapped by user, then by household."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.operators.conversions import HOUSEHOLD_SOURCE, USER_SOURCE
from adlytics.operators.joins import drop_known, keep_known, left_join
from adlytics.params import ConversionPixels

_PIXEL_COLUMNS = ("visits", "started", "completed")
_UTM = ("utm_medium", "utm_source")


def _pixel_sums(pixels: ConversionPixels) -> list[Column]:
    ids = dict(zip(_PIXEL_COLUMNS, (pixels.visit, pixels.started, pixels.completed)))
    return [F.count_if(F.col("pixel_id") == pixel).alias(name) for name, pixel in ids.items()]


def delivery_sums(ads: DataFrame) -> DataFrame:
    """Ad-level delivery with ``is_household`` summed per day, user and address."""
    return ads.groupBy("date_ts", "site_user_id", "ip_address", "is_household").agg(
        F.count("request_id").alias("requests"),
        F.count_if("is_impression").alias("impressions"),
        F.sum(F.try_divide("max_bid_net_usd", F.lit(1000))).alias("revenue"),
    )


def delivery_overlap(
    delivered: DataFrame,
    prefixes: DataFrame,
    conversions: DataFrame,
    pixels: ConversionPixels,
    strict: bool = False,
) -> DataFrame:
    """Requests, impressions, revenue and conversions by household, mapping source and UTM.

    ``delivered`` comes from ``delivery_sums``. Delivery of users with a conversion
    is mapped by user id and repeats for each conversion day and UTM pair. The remaining
    delivery is mapped by address to the remaining household conversions; its requests are
    counted once per matching conversion group, as the reported figures are. ``strict``
    counts them once.
    """
    converting = (
        conversions.filter(F.col("site_user_id").isNotNull())
        .groupBy("date_ts", F.col("site_user_id").alias("conv_user"), *_UTM)
        .agg(*_pixel_sums(pixels))
        .drop("date_ts")
    )
    by_user = delivered.filter(F.col("site_user_id").isNotNull()).groupBy("date_ts", "site_user_id").agg(
        F.sum("requests").alias("requests"),
        F.sum("impressions").alias("impressions"),
        F.round(F.sum("revenue"), 2).alias("revenue"),
    )
    mapped_by_user = (
        by_user.join(converting, F.col("site_user_id") == F.col("conv_user"))
        .withColumns({"is_household": F.lit(False), "conversion_mapping_source": F.lit(USER_SOURCE)})
    )

    # Users on both sides; each side drops the other's known users from the address step.
    homes = prefixes.select(F.col("ip_address_prefix").alias("home")).distinct()
    left_over = keep_known(drop_known(conversions, "site_user_id", delivered, "site_user_id"), "ip_address", homes, "home")
    by_address = (
        left_over.groupBy("date_ts", F.col("ip_address").alias("conv_address"), *_UTM)
        .agg(*_pixel_sums(pixels))
        .drop("date_ts")
    )
    groups = by_address.groupBy("conv_address").agg(F.count(F.lit(1)).alias("groups"))
    unmapped = drop_known(delivered, "site_user_id", conversions, "site_user_id")
    addresses = unmapped.groupBy("date_ts", "ip_address", "is_household").agg(
        F.sum("requests").alias("requests"),
        F.sum("impressions").alias("impressions"),
        F.sum("revenue").alias("revenue"),
    )
    counted = left_join(addresses, groups, "ip_address", "conv_address")
    times = F.lit(1) if strict else F.coalesce(F.col("groups"), F.lit(1))
    counted = counted.withColumns(
        {
            "requests": F.col("requests") * times,
            "impressions": F.col("impressions") * times,
            "revenue": F.round(F.col("revenue") * times, 2),
        }
    )
    mapped_by_address = left_join(counted, by_address, "ip_address", "conv_address").withColumn(
        "conversion_mapping_source", F.when(F.col("visits").isNotNull(), F.lit(HOUSEHOLD_SOURCE))
    )

    by = ["date_ts", "is_household", "conversion_mapping_source", *_UTM]
    measures = ["requests", "impressions", "revenue", *_PIXEL_COLUMNS]
    both = mapped_by_user.select(*by, *measures).unionByName(mapped_by_address.select(*by, *measures))
    return both.groupBy(*by).agg(
        F.sum("requests").alias("total_requests"),
        F.sum("impressions").alias("total_impressions"),
        # Parts are rounded already; rounding the sum only removes binary noise.
        F.round(F.sum("revenue"), 2).alias("total_revenue"),
        *[F.sum(c).alias(c) for c in _PIXEL_COLUMNS],
    )


def addressable_totals(conversions: DataFrame, pixels: ConversionPixels) -> DataFrame:
    """Pixel totals per UTM pair over users with more than one conversion."""
    known = conversions.filter(F.col("site_user_id").isNotNull())
    per_user = known.groupBy("site_user_id", *_UTM).agg(F.count(F.lit(1)).alias("n"), *_pixel_sums(pixels))
    repeated = per_user.groupBy("site_user_id").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    addressable = keep_known(per_user, "site_user_id", repeated.withColumnRenamed("site_user_id", "listed"), "listed")
    return addressable.groupBy(*_UTM).agg(*[F.sum(c).alias(f"total_{c}") for c in _PIXEL_COLUMNS])


def delivery_overlap_with_totals(
    delivered: DataFrame,
    prefixes: DataFrame,
    conversions: DataFrame,
    pixels: ConversionPixels,
    totals_day: date,
    strict: bool = False,
) -> DataFrame:
    """``delivery_overlap`` plus rows holding the addressable conversion totals."""
    zero = F.lit(0).cast("bigint")
    overlap = delivery_overlap(delivered, prefixes, conversions, pixels, strict).withColumns(
        {f"total_{c}": zero for c in _PIXEL_COLUMNS}
    )
    totals = addressable_totals(conversions, pixels).withColumns(
        {
            "date_ts": F.lit(totals_day),
            "is_household": F.lit(None).cast("boolean"),
            "conversion_mapping_source": F.lit(None).cast("string"),
            "total_requests": zero,
            "total_impressions": zero,
            "total_revenue": F.lit(0.0),
            **{c: zero for c in _PIXEL_COLUMNS},
        }
    )
    return overlap.unionByName(totals)
