"""Matching conversion pixels to the line items of their advertiser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.operators.joins import left_join
from adlytics.params import Period
from adlytics.sources.tables import sample_rows

_LINE_ITEM_FIELDS = (
    "io_number",
    "product",
    "record_type",
    "metric",
    "opportunity_name",
    "account_id",
    "account_name",
    "industry",
    "agency",
    "customer_group",
)
_WIN_FIELDS = ("line_item_alt_id", "campaign_alt_id", "campaign_id")


def match_pixels_to_line_items(
    sessions: DataFrame,
    win_log: DataFrame,
    line_items: DataFrame,
    days: Period,
    sample_fraction: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Conversion pixels with the campaigns and line items of the same advertiser.

    ``number_pixel_events`` counts pixel, win and line-item combinations. Each side is
    counted per distinct row first and the counts are multiplied, so an advertiser's
    pixels and wins never meet row by row. A ``sample_fraction`` below 1 takes that share
    of the won auctions, chosen by a hash of their id.
    """
    pixels = (
        sessions.filter(days.covers_date(F.col("date")))
        .select(F.explode("site_pages").alias("page"))
        .filter(F.col("page.pixel_type") == "conversion")
        .groupBy("page.internal_advertiser_id", "page.pixel_id", "page.pixel_name")
        .agg(F.count(F.lit(1)).alias("pixel_rows"))
        .withColumn("advertiser_key", F.expr("try_cast(internal_advertiser_id AS BIGINT)").cast("string"))
    )
    wins = (
        sample_rows(win_log.filter(days.covers_ts(F.col("bid_time_utc"))), sample_fraction, "exchange_auction_id", seed)
        .groupBy("advertiser_id", *_WIN_FIELDS)
        .agg(F.count(F.lit(1)).alias("win_rows"))
        .withColumn("win_key", F.col("advertiser_id").cast("string"))
    )
    items = (
        line_items.groupBy("line_item_id", *_LINE_ITEM_FIELDS)
        .agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count(F.lit(1)).alias("item_rows"))
        .withColumn("item_key", F.col("line_item_id"))
    )
    joined = left_join(left_join(pixels, wins, "advertiser_key", "win_key"), items, "line_item_alt_id", "item_key")
    events = F.col("pixel_rows") * F.coalesce("win_rows", F.lit(1)) * F.coalesce("item_rows", F.lit(1))
    return joined.select(
        "internal_advertiser_id",
        "pixel_id",
        "pixel_name",
        "advertiser_id",
        *_WIN_FIELDS,
        "line_item_id",
        *_LINE_ITEM_FIELDS,
        "start_date",
        "end_date",
        events.alias("number_pixel_events"),
    )
