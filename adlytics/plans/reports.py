"""Reports over a set of tables, each from scan to result.

``tables`` is any object with the methods below: ``adlytics.sources.tables.ParquetTables`` for
tables kept as parquet. Every table with days is read through ``scan`` or ``scan_days``, so of a
table partitioned by day only the files of the days asked for are opened; tables partitioned by
their own ``date`` are cut by the operators' filters. ``space`` holds the tables a report saves;
close it after using the report.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlytics.operators import attribution, conversions, delivery, event_root, household, identity, metadata, overlap
from adlytics.params import ConversionPixels, Period, Window
from adlytics.sources.daily import DailyTable
from adlytics.sources.tables import ParquetTables, sample_rows
from adlytics.workspace import Workspace


class Tables(Protocol):
    def scan(self, table: str, when: Period | Window, ts: str = "ts", country: str | None = None) -> DataFrame: ...
    def scan_days(self, table: str, when: Period | Window, column: str = "date") -> DataFrame: ...
    def bidstream(self) -> DataFrame: ...
    def site_events(self) -> DataFrame: ...
    def site_sessions(self) -> DataFrame: ...
    def pages(self) -> DataFrame: ...
    def win_log(self) -> DataFrame: ...
    def attention(self) -> DataFrame: ...
    def line_items(self) -> DataFrame: ...
    def ip_prefix(self) -> DataFrame: ...
    def ip_prefix_mapping(self) -> DataFrame: ...
    def id_mapping(self) -> Mapping[str, DataFrame]: ...


def impressions_and_conversions(
    tables: Tables,
    pixels: ConversionPixels,
    when: Period | Window,
    conversion_days: Period,
    lookup_days: Period,
    country: str | None = None,
    creative_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Distinct impressions of a scan, and the advertiser's conversions to map to them."""
    bids = tables.scan("bidstream", when, country=country)
    seats = delivery.seat_level(bids, impressions_only=True, creative_id=creative_id)
    homes = household.household_prefixes(tables.scan_days("ip_prefix_mapping", lookup_days), lookup_days)
    shown = conversions.impression_keys(household.flag_household(seats, homes))
    converted = conversions.site_conversions(tables.scan("site_events", conversion_days), pixels, conversion_days)
    return shown, converted


def mapped_impressions(
    tables: Tables,
    pixels: ConversionPixels,
    when: Period | Window,
    conversion_days: Period,
    lookup_days: Period,
    country: str | None = None,
    creative_id: str | None = None,
) -> DataFrame:
    """Impressions with the conversions their user or household reaches."""
    found = impressions_and_conversions(tables, pixels, when, conversion_days, lookup_days, country, creative_id)
    return conversions.map_conversions(*found, pixels)


def device_match(
    space: Workspace, tables: Tables, pixels: ConversionPixels, days: Period, strict: bool = False
) -> DataFrame:
    """Delivery against completed conversions matched by user id, then by device."""
    seats = delivery.seat_level(tables.scan("bidstream", days))
    # The bid log is read once; its sums are small and read several times.
    summed = space.save(conversions.device_match_sums(seats), "device-sums")
    converted = conversions.site_conversions(tables.scan("site_events", days), pixels, days)
    return conversions.device_match_report(summed, converted.filter(F.col("pixel_id") == pixels.completed), strict, space)


def utm_conversions(
    space: Workspace,
    tables: Tables,
    pixels: ConversionPixels,
    when: Period | Window,
    conversion_days: Period,
    lookup_days: Period,
    country: str | None = None,
    creative_id: str | None = None,
    empty_arrays: str = "null",
) -> DataFrame:
    """Conversions mapped to impressions, per UTM medium and source."""
    found = impressions_and_conversions(tables, pixels, when, conversion_days, lookup_days, country, creative_id)
    return conversions.utm_conversion_report(*found, pixels, empty_arrays, space)


def overlap_report(
    space: Workspace,
    tables: Tables,
    pixels: ConversionPixels,
    bid_days: Period,
    conversion_days: Period,
    country: str | None = None,
    with_totals: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Whole delivery of one country against an advertiser's conversions."""
    homes = household.household_prefixes(tables.scan_days("ip_prefix_mapping", bid_days), bid_days)
    ads = household.flag_household(delivery.ad_level(tables.scan("bidstream", bid_days, country=country)), homes)
    # The bid log is read once; its sums are small and read several times.
    delivered = space.save(overlap.delivery_sums(ads), "delivery-sums")
    converted = conversions.site_conversions(tables.scan("site_events", conversion_days), pixels, conversion_days)
    if with_totals:
        return overlap.delivery_overlap_with_totals(delivered, homes, converted, pixels, bid_days.start, strict)
    return overlap.delivery_overlap(delivered, homes, converted, pixels, strict)


def _person_seats(
    space: Workspace,
    tables: Tables,
    when: Period | Window,
    country: str | None,
    impressions_only: bool,
    sample_fraction: float,
    seed: int,
) -> DataFrame:
    bids = sample_rows(tables.scan("bidstream", when, country=country), sample_fraction, "request_id", seed)
    # The bid log is read once; the platform's seats are few and read several times.
    return space.save(identity.person_seats(bids, impressions_only), "seats")


def placed_seats(
    space: Workspace,
    tables: Tables,
    when: Period | Window,
    prefix_days: Period,
    lookup_days: Period,
    country: str | None = None,
    sample_fraction: float = 1.0,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Platform seats with what the lookups know about them, and the cached households, both saved."""
    seats = _person_seats(space, tables, when, country, False, sample_fraction, seed)
    cached = space.save(identity.cached_households(tables.id_mapping(), lookup_days), "cached-households")
    homes = household.household_prefixes(tables.scan_days("ip_prefix_mapping", prefix_days), prefix_days)
    return space.save(identity.place_seats(seats, cached, homes), "placed-seats"), cached


def cascade_people(
    space: Workspace,
    tables: Tables,
    when: Period | Window,
    prefix_days: Period,
    lookup_days: Period,
    country: str | None = None,
    sample_fraction: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Person id of every platform impression, resolved row by row."""
    seats = _person_seats(space, tables, when, country, True, sample_fraction, seed)
    cached = identity.cached_households(tables.id_mapping(), lookup_days)
    listed = household.household_prefix_rows(tables.scan_days("ip_prefix_mapping", prefix_days), prefix_days)
    return identity.resolve_person_cascade(seats, cached, listed)


def _widened(days: Period, margin: int) -> Period:
    return Period(days.start - timedelta(days=margin), days.end + timedelta(days=margin))


def delivery_side(
    tables: Tables, days: Period, household_day: Period, creative_characters: str, session_margin: int = 0
) -> DataFrame:
    """Delivery events of the attribution root.

    A session is stored under the day it began and may have clicks of a later one:
    ``session_margin`` is the number of days before and after in which sessions are looked for.
    """
    shown = event_root.page_impressions(
        tables.scan("pages", days), tables.scan_days("ip_prefix", household_day), days, household_day, creative_characters
    )
    wins = event_root.won_impressions(tables.scan("win_log", days, ts="bid_time_utc"), tables.line_items(), days)
    sessions = _widened(days, session_margin)
    clicks = event_root.tracker_clicks(tables.scan_days("site_sessions", sessions), sessions, creative_characters)
    return event_root.delivery_events(shown, wins, clicks, tables.scan_days("attention", days), days)


def conversion_side(tables: Tables, days: Period, session_margin: int = 0) -> DataFrame:
    """Conversion events of the attribution root; with a margin, exactly those of the days."""
    sessions = _widened(days, session_margin)
    found = event_root.conversion_events(tables.scan_days("site_sessions", sessions), sessions)
    return found.filter(days.covers_date(F.col("date"))) if session_margin else found


def root_events(
    tables: Tables, days: Period, household_day: Period, creative_characters: str, session_margin: int = 0
) -> DataFrame:
    """Delivery and conversion events of the attribution root, not nested."""
    delivered = delivery_side(tables, days, household_day, creative_characters, session_margin)
    return event_root.event_rows(delivered, conversion_side(tables, days, session_margin))


def daily_root(tables: ParquetTables, path: str, household_day: Period, creative_characters: str) -> DailyTable:
    """The attribution root kept by day below ``path``: a report on 30 days builds only the days that are new.

    A day is built again when files of its inputs change: pages, wins and attention of the day,
    sessions of the day and its neighbours, and the lookups. Its rows go to ``campaign_attribution``
    and ``first_touch_attribution``.
    """

    def build(days: Period) -> DataFrame:
        return root_events(tables, days, household_day, creative_characters, session_margin=1)

    inputs = {"pages": 0, "win_log": 0, "attention": 0, "site_sessions": 1}
    settings = f"{household_day.start}..{household_day.end} {creative_characters}"
    return DailyTable(tables, path, build, inputs, {"ip_prefix": household_day, "line_items": None}, settings)


def pixel_matches(tables: Tables, days: Period, sample_fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Conversion pixels with the campaigns and line items of the same advertiser."""
    return metadata.match_pixels_to_line_items(
        tables.scan_days("site_sessions", days), tables.scan("win_log", days, ts="bid_time_utc"), tables.line_items(), days, sample_fraction, seed
    )


def nested_root(
    space: Workspace, tables: Tables, days: Period, household_day: Period, creative_characters: str
) -> DataFrame:
    """Nested attribution root, saved; its two sides are nested as they are built, each being read once."""
    delivered = delivery_side(tables, days, household_day, creative_characters)
    return space.save(event_root.build_event_root(delivered, conversion_side(tables, days)), "nested-root")


def campaign_attribution(rows: DataFrame) -> DataFrame:
    """Campaign rollup of the 30-day attribution."""
    return attribution.campaign_report(attribution.attribution_events(rows))


def first_touch_attribution(rows: DataFrame) -> DataFrame:
    """Day and week first-touch attribution per campaign."""
    return attribution.first_touch_report(attribution.attribution_events(rows, use_tracker_domain=False))
