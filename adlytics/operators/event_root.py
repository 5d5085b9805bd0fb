"""The attribution event root: delivery and conversions per day, person and device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics import params
from adlytics.functions.text import bare_domain, browser_family, part, strip_leading
from adlytics.operators.joins import join_null_safe, left_join
from adlytics.params import Period

ROOT_KEYS = (
    "date",
    "user_pwid_raw",
    "browser_name",
    "device_type",
    "os_name",
    "ip_address",
    "is_household",
    "site_user_id",
)
DELIVERY_FIELDS = (
    "ts",
    "request_id",
    "advertiser_domain",
    "ad_id",
    "line_item_id",
    "advertiser_id",
    "campaign_id",
    "creative_id",
    "io_number",
    "opportunity_name",
    "bid_net_usd",
    "bid_gross_usd",
    "beeswax_clicks",
    "beeswax_in_view_time",
    "tracker_advertiser_domain",
    "tracker_click",
    "tracker_hovers",
    "dv_net_80_viewable_imp",
    "dv_net_100_viewable_imp",
    "dv_net_iab_viewable_imp",
    "dv_ad_mouse_hover_imp",
)
CONVERSION_FIELDS = ("ts", "advertiser_domain", "pixel_id", "pixel_name", "conversion")


def page_impressions(
    pages: DataFrame, ip_prefix: DataFrame, days: Period, household_day: Period, creative_characters: str
) -> DataFrame:
    """Platform impressions on pages, with the household flag of the address and region.

    The flag comes from one day's prefix table whatever the day of the page.
    ``creative_characters`` is the set of characters stripped in front of creative ids.
    """
    lookup = ip_prefix.filter(household_day.covers_date(F.col("date"))).select(
        F.concat("app_region", F.lit(" "), "ip_address_prefix").alias("prefix_key"), "is_household"
    )
    kept = pages.filter(
        days.covers_ts(F.col("ts"))
        & F.col("advertiser_domain").isNotNull()
        & F.col("seat_name").like(params.PAGE_SEAT_PATTERN)
    ).withColumn("address_key", F.concat("app_region", F.lit(" "), "ip_address"))
    flagged = left_join(kept, lookup, "address_key", "prefix_key")
    return flagged.withColumn("impression", F.explode_outer("impression")).select(
        F.to_date("ts").alias("date"),
        "ad_id",
        strip_leading(F.col("impression.bid_creative_id"), creative_characters).alias("creative_id"),
        F.col("site_user.user_pwid_raw").alias("user_pwid_raw"),
        "browser_name",
        "device_type",
        "os_name",
        "ip_address",
        "is_household",
        F.col("site_user.user_id").alias("site_user_id"),
        "advertiser_domain",
        "bid_net_usd",
        "bid_gross_usd",
    )


def won_impressions(win_log: DataFrame, line_items: DataFrame, days: Period) -> DataFrame:
    """Wins with the line item they belong to."""
    wins = win_log.filter(days.covers_ts(F.col("bid_time_utc"))).select(
        F.to_date("bid_time_utc").alias("date"),
        F.col("exchange_imp_id").alias("ad_id"),
        "creative_id",
        F.col("bid_time_utc").alias("ts"),
        F.col("exchange_auction_id").alias("request_id"),
        "advertiser_id",
        "campaign_id",
        "line_item_alt_id",
        F.nullif("clicks", F.lit(0)).alias("beeswax_clicks"),
        F.when(F.col("in_view_time_millis") > 0, F.col("in_view_time_millis")).alias("beeswax_in_view_time"),
    )
    items = line_items.select(
        F.col("line_item_id").alias("item_key"), "line_item_id", "io_number", "opportunity_name"
    )
    return left_join(wins, items, "line_item_alt_id", "item_key").drop("line_item_alt_id")


def tracker_clicks(sessions: DataFrame, days: Period, creative_characters: str) -> DataFrame:
    """Clicks and hovers seen by the click tracker per request, ad, domain and creative."""
    pages = sessions.filter(days.covers_date(F.col("date"))).select(F.explode("site_pages").alias("page"))
    counted = (
        pages.filter(F.col("page.pixel_type") == "tracker")
        .groupBy(
            F.to_date("page.ts").alias("date"),
            part(F.col("page.var1"), 0).alias("tracker_request_id"),
            part(F.col("page.var1"), 1).alias("ad_id"),
            bare_domain(F.col("page.advertiser_domain")).alias("tracker_advertiser_domain"),
            strip_leading(part(F.col("page.var2"), 3), creative_characters).alias("creative_id"),
        )
        .agg(
            F.count_if(F.col("page.pixel_name") == params.TRACKER_CLICK_PIXEL).alias("tracker_click"),
            F.count_if(F.col("page.pixel_name") == params.TRACKER_HOVER_PIXEL).alias("tracker_hovers"),
        )
    )
    return counted.filter("tracker_click > 0 OR tracker_hovers > 0").drop("tracker_request_id")


def delivery_events(
    impressions: DataFrame, wins: DataFrame, trackers: DataFrame, attention: DataFrame, days: Period
) -> DataFrame:
    """One row per page impression and win, with tracker and viewability measures."""
    seen = attention.filter(days.covers_date(F.col("date"))).withColumnRenamed("imp_id", "ad_id")
    joined = (
        impressions.join(wins, ["date", "ad_id", "creative_id"])
        .join(trackers, ["date", "ad_id", "creative_id"], "left")
        .join(seen, ["date", "ad_id"], "left")
    )
    return joined.select(*ROOT_KEYS, F.struct(*DELIVERY_FIELDS).alias("delivery"))


def conversion_events(sessions: DataFrame, days: Period) -> DataFrame:
    """One row per conversion pixel fired in a site session."""
    pages = sessions.filter(days.covers_date(F.col("date"))).withColumn("page", F.explode("site_pages"))
    fired = pages.filter(F.col("page.pixel_type") == "conversion")
    return fired.select(
        F.to_date("page.ts").alias("date"),
        "user_pwid_raw",
        browser_family(F.col("browser_name")).alias("browser_name"),
        "device_type",
        "os_name",
        "ip_address",
        "is_household",
        "site_user_id",
        F.struct(
            F.col("page.ts").alias("ts"),
            bare_domain(F.col("page.advertiser_domain")).alias("advertiser_domain"),
            F.col("page.pixel_id").alias("pixel_id"),
            F.col("page.pixel_name").alias("pixel_name"),
            F.lit(1).cast("bigint").alias("conversion"),
        ).alias("conversion"),
    )


def event_rows(delivery: DataFrame, conversions: DataFrame) -> DataFrame:
    """The root before nesting: one event a row, as a delivery or a conversion struct.

    Attribution reads this form directly: nesting and unnesting again would shuffle every
    event for nothing.
    """
    return delivery.withColumn(
        "conversion", F.lit(None).cast(conversions.schema["conversion"].dataType)
    ).unionByName(conversions.withColumn("delivery", F.lit(None).cast(delivery.schema["delivery"].dataType)))


def nest_events(rows: DataFrame, keys: Sequence[str], event: str, into: str) -> DataFrame:
    """Distinct events with their number of copies, nested per key and hour.

    The grain is the same at any size: the hour bounds a row in time, and equal events are counted
    before anything is collected, so a mass of copies is one entry.
    """
    counted = rows.groupBy(*keys, event).agg(F.count(F.lit(1)).alias("copies"))
    hour = F.date_trunc("hour", F.col(event)["ts"]).alias("hour")
    entry = F.col(event).withField("copies", F.col("copies"))
    return counted.groupBy(*keys, hour).agg(F.array_sort(F.collect_list(entry)).alias(into))


def build_event_root(delivery: DataFrame, conversions: DataFrame) -> DataFrame:
    """Nested root: ``delivery`` or ``conversions`` array per day, person, device and hour."""
    nested_delivery = nest_events(delivery, ROOT_KEYS, "delivery", "delivery")
    nested_conversions = nest_events(conversions, ROOT_KEYS, "conversion", "conversions")
    no_conversions = F.lit(None).cast(nested_conversions.schema["conversions"].dataType)
    no_delivery = F.lit(None).cast(nested_delivery.schema["delivery"].dataType)
    columns: list[str | Column] = [*ROOT_KEYS, "hour", "conversions", "delivery"]
    return (
        nested_delivery.withColumn("conversions", no_conversions)
        .select(*columns)
        .unionByName(nested_conversions.withColumn("delivery", no_delivery).select(*columns))
    )


def flatten_event_root(root: DataFrame) -> DataFrame:
    """Back from the nested root to ``event_rows``, every copy a row of its own.

    Each side is unfolded from its own array, so what reads one side opens no column of the other.
    """

    def unfolded(array: str, event: str) -> DataFrame:
        entries = root.select(*ROOT_KEYS, F.explode(array).alias("entry"))
        copies = F.greatest(F.col("entry.copies"), F.lit(1).cast("bigint"))
        repeated = entries.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
        return repeated.select(*ROOT_KEYS, F.col("entry").dropFields("copies").alias(event))

    return event_rows(unfolded("delivery", "delivery"), unfolded("conversions", "conversion"))
