"""One query per operator, over the derived advertising tables of a data folder."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlytics import configure
from adlytics.functions import ip, text, times
from adlytics.operators import attribution, conversions, delivery, distinct_sets, event_root, household, identity, metadata
from adlytics.params import Period, Window
from adlytics.plans import reports
from adlytics.schemas import BID_FIELDS
from adlytics.sources import export
from adlytics.sources.derived import (
    AS_OF,
    COUNTRY,
    CREATIVE,
    CREATIVE_CHARACTERS,
    LOOKUP_DAY,
    MONTH,
    PIXELS,
    Derived,
)
from adlytics.sources.tables import ParquetTables, partition_days, sample_blocks, save_table, scan
from adlytics.workspace import Workspace
from datetime import time

EXPORT_PREFIX = "audience"
EXPORT_PART_ROWS = 150
INACTIVE_CAMPAIGN = "c3"


@dataclass(frozen=True)
class Checked(Derived):
    """The derived tables, and the workspace of one call over them."""

    space: Workspace


_REGISTERED: dict[str, Callable[[Checked], DataFrame]] = {}
def query(build: Callable[[Checked], DataFrame]) -> Callable[[Checked], DataFrame]:
    _REGISTERED[build.__name__] = build
    return build


def workspace(spark: SparkSession) -> Workspace:
    """A workspace of one call; results read its tables, so it goes when the driver ends."""
    space = Workspace(spark)

    def close() -> None:
        with suppress(Exception):  # the session may have ended before
            space.close()

    atexit.register(close)
    return space


def plain(rows: DataFrame) -> DataFrame:
    """Days, timestamps, flags and arrays as text, so both engines print them alike."""
    shown = []
    for name, kind in rows.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("date", "boolean"):
            column = column.cast("string")
        elif kind == "timestamp":
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        shown.append(column.alias(name))
    return rows.select(*shown)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Checked], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain(build(Checked(configure(spark), folder, workspace(spark))))

    return {name: bind(build) for name, build in _REGISTERED.items()}


# --- scans -----------------------------------------------------------------------------


@query
def partition_listing(t: Checked) -> DataFrame:
    return partition_days(t.audience())


#: Date columns by which the stored tables are partitioned.
STORED_BY = {
    "bidstream": "day",
    "site_events": "day",
    "pages": "day",
    "win_log": "day",
    "site_sessions": "date",
    "attention": "date",
    "ip_prefix": "date",
    "ip_prefix_mapping": "date",
}


def stored_by_day(tables: Derived, folder: str, names: tuple[str, ...] = tuple(STORED_BY)) -> ParquetTables:
    """Tables written by day below a folder, and read from there; a large day is written by several tasks."""
    for name in names:
        rows = getattr(tables, name)()
        if STORED_BY[name] == "day":
            rows = rows.withColumn("day", F.to_date("bid_time_utc" if name == "win_log" else "ts"))
        save_table(rows.hint("rebalance", STORED_BY[name]), f"{folder}/{name}", [STORED_BY[name]])
    return ParquetTables(tables.spark, folder, partitions={n: STORED_BY[n] for n in names})


@query
def partition_listing_stored(t: Checked) -> DataFrame:
    """Days of the stored site events with their rows, from folder names and file footers."""
    return stored_by_day(t, t.space.path("tables"), ("site_events",)).days("site_events")


@query
def block_sample_counts(t: Checked) -> DataFrame:
    """Requests per country of a sample of the folders of the bid log, stored by a hash of the request."""
    folder = f"{t.space.path('tables')}/bidstream"
    bids = t.bidstream().withColumn("bucket", F.concat(F.lit("b"), F.substring(F.md5("request_id"), 1, 2)))
    stored = save_table(bids.repartition("bucket"), folder, ["bucket"])
    chosen = sample_blocks(stored, folder, 0.25, seed=5, whole_folders=True)
    return chosen.groupBy("bucket", "user_country").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce(F.size("ad"), F.lit(0))).alias("ads"))


@query
def day_scan_counts(t: Checked) -> DataFrame:
    """Rows of each supported scan window of the whole bid log."""
    bids = t.bidstream().select("ts", "user_country")
    hours = Window(AS_OF.replace(day=30), time(6), time(14, 10))
    return bids.agg(
        F.count_if(Period.day(AS_OF).covers_ts(F.col("ts"))).alias("yesterday"),
        F.count_if(Period.rolling(AS_OF, 7).covers_ts(F.col("ts"))).alias("last_7_days"),
        F.count_if(hours.covers_ts(F.col("ts"))).alias("clock_window"),
        F.count_if(MONTH.covers_ts(F.col("ts"))).alias("month"),
    )


# --- column functions ------------------------------------------------------------------


@query
def utm_fields(t: Checked) -> DataFrame:
    url = F.col("page_url")
    return t.site_events().select(
        "page_url", text.utm_medium(url).alias("utm_medium"), text.utm_source(url).alias("utm_source")
    )


@query
def text_functions(t: Checked) -> DataFrame:
    pages = t.site_sessions().select("date", "browser_name", F.explode("site_pages").alias("page"))
    return pages.select(
        F.col("page.var1").alias("var1"),
        text.bare_domain(F.col("page.advertiser_domain")).alias("domain"),
        text.part(F.col("page.var1"), 1).alias("second_part"),
        text.strip_leading(text.part(F.col("page.var2"), 3), CREATIVE_CHARACTERS).alias("creative_id"),
        text.browser_family(F.col("browser_name")).alias("browser"),
    )


@query
def elapsed_time(t: Checked) -> DataFrame:
    """Hours and days from the start of the month to each event."""
    start = F.to_timestamp(F.lit("2024-01-01 00:30:00"))
    hours = times.hours_at_least_one(F.col("ts"), start)
    return t.site_events().select(
        "ts",
        times.hours_crossed(F.col("ts"), start).alias("hours_crossed"),
        hours.alias("hours"),
        times.days_rounded_up(hours).cast("bigint").alias("days"),
    )


@query
def household_addresses(t: Checked) -> DataFrame:
    return t.bidstream().select(
        "request_id", "ip_address", ip.household_address(F.col("ip_address")).alias("household_address")
    )


# --- delivery --------------------------------------------------------------------------

_SEAT_COLUMNS = (
    "date_ts",
    "request_id",
    "ad_id",
    "ip_address",
    "browser_name",
    "device_type",
    "os_name",
    "os_version",
    "site_user_id",
    "seat_name",
    "is_bid_request_sent",
    "is_test_arm",
    "is_control_arm",
    "creative_id",
    "bid_user_id",
    "br_is_impression",
    "br_max_bid_net_usd",
)


@query
def seat_level(t: Checked) -> DataFrame:
    return delivery.seat_level(t.bidstream()).select(*_SEAT_COLUMNS)


@query
def seat_level_creative_impressions(t: Checked) -> DataFrame:
    seats = delivery.seat_level(t.bidstream(), impressions_only=True, creative_id=CREATIVE)
    return seats.select(*_SEAT_COLUMNS)


_FLAG_COLUMNS = (
    "date_ts",
    "request_id",
    "ad_id",
    "seat_name",
    "is_bid_request_sent",
    "br_is_impression",
    "is_test_arm",
    "is_control_arm",
    "id_source_anonymous_id",
    "id_source_hhip",
    "id_source_login_id",
    "id_source_maid",
    "id_source_pubcid",
    "id_source_cookie",
    "max_bid_net_usd",
    "br_max_bid_net_usd",
)
_MONEY = ("br_max_bid_net_usd", "max_bid_net_usd")


def _digests(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the rows, the filled values of every column, sums of money, and a digest of all whole rows.

    The digest sums 32 bits of the md5 of each row, so any value that is changed, lost or moved shows.
    """
    others = [c for c in rows.columns if c not in keys]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in others if c not in _MONEY])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    money = [F.sum(c).alias(f"sum_{c}") for c in others if c in _MONEY]
    filled = [F.count(c).alias(f"n_{c}") for c in others]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).alias("digest"), *filled, *money)


@query
def seat_level_counts(t: Checked) -> DataFrame:
    return _digests(delivery.seat_level(t.bidstream()).select(*_SEAT_COLUMNS), "seat_name")


@query
def seat_level_creative_counts(t: Checked) -> DataFrame:
    seats = delivery.seat_level(t.bidstream(), impressions_only=True, creative_id=CREATIVE)
    return _digests(seats.select(*_SEAT_COLUMNS), "seat_name")


@query
def ad_level(t: Checked) -> DataFrame:
    return delivery.ad_level(t.bidstream()).select(
        "date_ts", "request_id", "ad_id", "ip_address", "site_user_id", "is_impression", "max_bid_net_usd"
    )


@query
def seat_delivery_report(t: Checked) -> DataFrame:
    return delivery.seat_delivery_report(scan(t.bidstream(), MONTH))


@query
def seat_delivery_report_true_only(t: Checked) -> DataFrame:
    return delivery.seat_delivery_report(scan(t.bidstream(), MONTH), count_mode="true_only")


@query
def seat_delivery_report_from_tables(t: Checked) -> DataFrame:
    """The bid log stored by day and read back with only the fields and days that the report needs."""
    folder = t.space.path("tables")
    save_table(t.bidstream().withColumn("day", F.to_date("ts")), f"{folder}/bidstream", ["day"])
    tables = ParquetTables(t.spark, folder, {"bidstream": BID_FIELDS["seat_delivery_report"]}, {"bidstream": "day"})
    return delivery.seat_delivery_report(tables.scan("bidstream", MONTH))


@query
def cascade_sampled(t: Checked) -> DataFrame:
    """Person ids of a sample of requests, chosen by a hash of their id."""
    people = reports.cascade_people(t.space, t, MONTH, MONTH, LOOKUP_DAY, COUNTRY, sample_fraction=0.2, seed=3)
    return _as_bag(people)


@query
def id_source_flags(t: Checked) -> DataFrame:
    return delivery.id_source_flags(t.bidstream())


@query
def id_source_flag_counts(t: Checked) -> DataFrame:
    return _digests(delivery.id_source_flags(t.bidstream()).select(*_FLAG_COLUMNS), "seat_name")


@query
def id_source_report(t: Checked) -> DataFrame:
    return delivery.id_source_report(t.bidstream())


@query
def bid_creative_reach(t: Checked) -> DataFrame:
    return delivery.bid_creative_reach(scan(t.bidstream(), MONTH, country=COUNTRY), CREATIVE)


# --- households and conversions --------------------------------------------------------


def _conversions(t: Checked) -> DataFrame:
    return conversions.site_conversions(t.site_events(), PIXELS, MONTH)


def _mapped(t: Checked) -> DataFrame:
    return reports.mapped_impressions(t, PIXELS, MONTH, MONTH, MONTH, COUNTRY)


def _to_map(t: Checked) -> tuple[DataFrame, DataFrame]:
    return reports.impressions_and_conversions(t, PIXELS, MONTH, MONTH, MONTH, COUNTRY)


@query
def household_prefixes(t: Checked) -> DataFrame:
    return household.household_prefixes(t.ip_prefix_mapping(), MONTH)


@query
def household_prefixes_us(t: Checked) -> DataFrame:
    return household.household_prefixes(t.ip_prefix_mapping(), MONTH, region="us")


@query
def flag_household(t: Checked) -> DataFrame:
    homes = household.household_prefixes(t.ip_prefix_mapping(), MONTH)
    return household.flag_household(delivery.ad_level(t.bidstream()), homes).select(
        "date_ts", "request_id", "ad_id", "ip_address", "is_household"
    )


@query
def conversion_id_counts(t: Checked) -> DataFrame:
    return conversions.conversion_id_counts(_conversions(t))


@query
def device_match_report(t: Checked) -> DataFrame:
    return reports.device_match(t.space, t, PIXELS, MONTH)


@query
def device_match_report_strict(t: Checked) -> DataFrame:
    return reports.device_match(t.space, t, PIXELS, MONTH, strict=True)


@query
def map_conversions(t: Checked) -> DataFrame:
    return _mapped(t)


@query
def consolidate_conversions(t: Checked) -> DataFrame:
    return conversions.consolidate_conversions(_mapped(t), PIXELS)


@query
def conversion_report(t: Checked) -> DataFrame:
    return conversions.conversion_report(conversions.consolidate_conversions(_mapped(t), PIXELS))


@query
def conversion_report_stored(t: Checked) -> DataFrame:
    """From the stored table, in which missing arrays have become empty ones."""
    stored = conversions.consolidate_conversions(_mapped(t), PIXELS, empty_arrays="empty")
    return conversions.conversion_report(t.space.save(stored, "conversions"))


@query
def utm_conversion_report(t: Checked) -> DataFrame:
    """As from the stored table, in which missing arrays have become empty ones."""
    return conversions.utm_conversion_report(*_to_map(t), PIXELS, "empty", t.space)


@query
def utm_conversion_report_in_query(t: Checked) -> DataFrame:
    return conversions.utm_conversion_report(*_to_map(t), PIXELS, space=t.space)


@query
def site_conversion_utm_report(t: Checked) -> DataFrame:
    return conversions.site_conversion_utm_report(_conversions(t), PIXELS)


@query
def delivery_overlap(t: Checked) -> DataFrame:
    return reports.overlap_report(t.space, t, PIXELS, MONTH, MONTH, COUNTRY)


@query
def delivery_overlap_strict(t: Checked) -> DataFrame:
    return reports.overlap_report(t.space, t, PIXELS, MONTH, MONTH, COUNTRY, strict=True)


@query
def delivery_overlap_with_totals(t: Checked) -> DataFrame:
    return reports.overlap_report(t.space, t, PIXELS, MONTH, MONTH, COUNTRY, with_totals=True)


# --- identity --------------------------------------------------------------------------


def _placed(t: Checked) -> tuple[DataFrame, DataFrame]:
    return reports.placed_seats(t.space, t, MONTH, MONTH, LOOKUP_DAY, COUNTRY)


def _as_bag(people: DataFrame) -> DataFrame:
    keys = [c for c in people.columns if c != "match_rows"]
    return people.groupBy(*keys).agg(F.sum("match_rows").alias("match_rows"))


@query
def cached_households(t: Checked) -> DataFrame:
    return identity.cached_households(t.id_mapping(), LOOKUP_DAY)


@query
def resolve_person_exclusive(t: Checked) -> DataFrame:
    return _as_bag(identity.resolve_person(*_placed(t)))


@query
def resolve_person_distinct_fallback(t: Checked) -> DataFrame:
    return _as_bag(identity.resolve_person(*_placed(t), mode="distinct_fallback"))


@query
def resolve_person_cascade(t: Checked) -> DataFrame:
    return _as_bag(reports.cascade_people(t.space, t, MONTH, MONTH, LOOKUP_DAY, COUNTRY))


@query
def reach_of_people(t: Checked) -> DataFrame:
    """Reach from the resolved rows."""
    return identity.reach(identity.resolve_person(*_placed(t)))


@query
def reach_exclusive(t: Checked) -> DataFrame:
    return identity.reach_report(*_placed(t))


#: Periods over which distinct users are counted from the same day sets.
SPANS = {
    "day": Period.day(AS_OF),
    "week": Period.rolling(AS_OF, 7),
    "month": MONTH,
    "middle": Period(MONTH.start.replace(day=5), MONTH.start.replace(day=17)),
}


@query
def users_over_spans(t: Checked) -> DataFrame:
    """Distinct users per country and span of days, from one set of ids a day."""
    facts = t.bidstream().select(F.to_date("ts").alias("date"), "user_country", F.col("site_user.user_id").alias("person"))
    facts = t.space.save(facts.distinct(), "facts")
    numbers = distinct_sets.number_ids(t.space, facts, "person")
    sets = t.space.save(distinct_sets.day_sets(facts, numbers, "person", ["user_country"]), "sets")
    return distinct_sets.count_over(sets, SPANS, ["user_country"])


@query
def reach_distinct_fallback(t: Checked) -> DataFrame:
    return identity.reach_report(*_placed(t), mode="distinct_fallback")


# --- attribution -----------------------------------------------------------------------

#: Impressions of a person in one slot of time, where the check is on the slots.
SLOT_POINTS = 8


def _root(t: Checked) -> DataFrame:
    return reports.root_events(t, MONTH, LOOKUP_DAY, CREATIVE_CHARACTERS)


def _saved_root(t: Checked) -> DataFrame:
    """The root, written once for all that a query reads from it."""
    return t.space.share("root", lambda: _root(t))


def _events(t: Checked) -> DataFrame:
    """Events of the root as it is built: impressions and conversions read one side of it each."""
    return attribution.attribution_events(_root(t))


def _nested_root(t: Checked) -> DataFrame:
    return reports.nested_root(t.space, t, MONTH, LOOKUP_DAY, CREATIVE_CHARACTERS)


@query
def root_delivery(t: Checked) -> DataFrame:
    rows = reports.delivery_side(t, MONTH, LOOKUP_DAY, CREATIVE_CHARACTERS)
    return rows.select(*event_root.ROOT_KEYS, "delivery.*")


@query
def root_conversions(t: Checked) -> DataFrame:
    rows = event_root.conversion_events(t.site_sessions(), MONTH)
    return rows.select(*event_root.ROOT_KEYS, "conversion.*")


@query
def event_root_nested(t: Checked) -> DataFrame:
    """Entries of the stored nested root, with their copies and the hour of their row."""
    entries = _nested_root(t).select(
        *event_root.ROOT_KEYS,
        "hour",
        F.array_size("delivery").cast("bigint").alias("delivered"),
        F.explode_outer("delivery").alias("d"),
        "conversions",
    )
    entries = entries.select("*", F.explode_outer("conversions").alias("c"))
    return entries.select(
        *event_root.ROOT_KEYS,
        "hour",
        "delivered",
        F.coalesce("d.ts", "c.ts").alias("ts"),
        "d.request_id",
        F.coalesce("d.advertiser_domain", "c.advertiser_domain").alias("advertiser_domain"),
        *[f"d.{f}" for f in event_root.DELIVERY_FIELDS if f not in ("ts", "request_id", "advertiser_domain")],
        "c.pixel_id",
        "c.pixel_name",
        F.coalesce("d.copies", "c.copies").alias("copies"),
    )


@query
def campaign_report_from_nested(t: Checked) -> DataFrame:
    """Campaign figures from the stored nested root, unnested again."""
    return reports.campaign_attribution(event_root.flatten_event_root(_nested_root(t)))


@query
def campaign_report_from_days(t: Checked) -> DataFrame:
    """Campaign figures from a root kept by day: ten days are built first, then only the rest of the month."""
    tables = stored_by_day(t, t.space.path("tables"), ("pages", "win_log", "attention", "site_sessions", "ip_prefix"))
    save_table(t.line_items(), f"{tables.folder}/line_items")
    root = reports.daily_root(tables, t.space.path("daily-root"), LOOKUP_DAY, CREATIVE_CHARACTERS)
    root.refresh(Period(MONTH.start, MONTH.start.replace(day=10)))
    return reports.campaign_attribution(root.fresh(MONTH))


@query
def active_events(t: Checked) -> DataFrame:
    """Events kept and dropped, of a root in which many delivery events lack an impression time.

    Such an event is kept only beside an impression of its device or a conversion of its person.
    """
    rows = _saved_root(t).withColumn(
        "delivery",
        F.when(F.col("delivery.campaign_id") == INACTIVE_CAMPAIGN, F.col("delivery").withField("ts", F.lit(None).cast("timestamp")))
        .otherwise(F.col("delivery")),
    )
    events = attribution.attribution_events(rows)
    kept = attribution.keep_active(events)
    by = F.coalesce("campaign_id", F.lit("none")).alias("campaign_id")
    counts = [F.count("impression").alias("impressions"), F.count("conversion").alias("conversions"), F.count(F.lit(1)).alias("events")]
    return kept.groupBy(by).agg(*counts).withColumn("state", F.lit("kept")).unionByName(
        events.groupBy(by).agg(*counts).withColumn("state", F.lit("all"))
    )


@query
def attribute_conversions(t: Checked) -> DataFrame:
    mapping = attribution.attribute_conversions(_events(t), space=t.space)
    return mapping.drop("impression_primary_key", "conversion_primary_key")


@query
def attributed_rows(t: Checked) -> DataFrame:
    """The mapping spelled out: one row per impression row and conversion, with distinct keys counted."""
    mapping = attribution.attribute_conversions(_events(t), space=t.space)
    rows = attribution.expand_copies(mapping)
    by = ["date", "campaign_id", "user_pwid_raw"]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mapped_rows"),
        F.count_distinct("impression_primary_key").alias("impression_keys"),
        F.count_distinct("conversion_primary_key").alias("conversion_keys"),
        F.count_if("is_first_row").alias("first_rows"),
    )


@query
def attributed_rows_in_slots(t: Checked) -> DataFrame:
    """The mapping with slots so small that most persons have several; no row may change."""
    rows = attribution.expand_copies(attribution.attribute_conversions(_events(t), space=t.space, most=SLOT_POINTS))
    return rows.groupBy("date", "advertiser_domain", "pixel_name").agg(
        F.count(F.lit(1)).alias("mapped_rows"),
        F.count_distinct("conversion_primary_key").alias("conversion_keys"),
        F.sum("hrs_since_impression").alias("hours"),
    )


@query
def conversion_lags(t: Checked) -> DataFrame:
    return attribution.conversion_lags(_events(t), space=t.space)


@query
def campaign_rollup(t: Checked) -> DataFrame:
    """Campaign figures from the row-level mapping."""
    mapping = attribution.attribute_conversions(_events(t), space=t.space)
    return attribution.campaign_rollup(mapping)


@query
def campaign_report(t: Checked) -> DataFrame:
    """The same figures without the row-level mapping."""
    return reports.campaign_attribution(_saved_root(t))


@query
def first_touch_report(t: Checked) -> DataFrame:
    return reports.first_touch_attribution(_saved_root(t))


# --- line items and exports ------------------------------------------------------------


@query
def match_pixels_to_line_items(t: Checked) -> DataFrame:
    return metadata.match_pixels_to_line_items(
        t.site_sessions(), t.win_log(), t.line_items(), MONTH
    )


@query
def match_pixels_to_line_items_sampled(t: Checked) -> DataFrame:
    return metadata.match_pixels_to_line_items(
        t.site_sessions(), t.win_log(), t.line_items(), MONTH, sample_fraction=0.05, seed=7
    )


@query
def export_manifest(t: Checked) -> DataFrame:
    return export.export_manifest(t.audience(), EXPORT_PREFIX, EXPORT_PART_ROWS)


def _export_folder(t: Checked) -> str:
    return t.space.path("export")


@query
def export_daily_csv(t: Checked) -> DataFrame:
    """Rows and distinct rows per written file, as read back."""
    folder = _export_folder(t)
    export.export_daily_csv(t.audience(), folder, EXPORT_PREFIX, EXPORT_PART_ROWS)
    written = t.spark.read.csv(
        f"{folder}/parts", header=True, schema="ts string, id_type string, partner_id string, filename string"
    )
    return written.groupBy("filename").agg(F.count(F.lit(1)).alias("row_count"))


@query
def export_ordered_csv(t: Checked) -> DataFrame:
    folder = _export_folder(t)
    export.export_ordered_csv(t.audience(), folder, ["ts"])
    return t.spark.read.csv(folder, header=False, schema="ts string, id_type string, partner_id string")


@query
def export_single_header_csv(t: Checked) -> DataFrame:
    folder = _export_folder(t)
    export.export_single_header_csv(t.audience(), folder, ["ts"])
    return t.spark.read.text(folder).withColumnRenamed("value", "line")
