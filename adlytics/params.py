"""Explicit parameters: reporting periods, account identifiers and fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seat names run by the bidder platform.
PLATFORM_SEATS = (
    "beeswax",
    "ozbeeswax",
    "ozbeeswaxv",
    "ozbeeswaxiv",
    "ozbeeswaxibv",
    "ozbwomp",
    "ozbwompv",
    "ozbwompiv",
)
PLATFORM_LABEL = "beeswax"
OTHER_LABEL = "other"

# LIKE patterns selecting the platform's seats in the bid log.
PLATFORM_SEAT_PATTERNS = ("%beeswax%", "ozbwomp%")
PAGE_SEAT_PATTERN = "%beeswax%"

# The identity experiment and its arms.
EXPERIMENT_NAME = "b_id"
EXPERIMENT_TEST_TYPE = "d_ig"
EXPERIMENT_CONTROL_TYPE = "ctr"
ARM_TEST_LABEL = "disable_id_graph"
ARM_CONTROL_LABEL = "enable_id_graph"

# Identifier kinds in bid logs and lookup tables.
ID_SOURCES = ("anonymous-id", "hhip", "login-id", "maid", "pubcid")
HOUSEHOLD_PLATFORM = "hhip"

# Household tier caps per region.
HOUSEHOLD_TIER_CAP = {"eu": 55_000_000, "us": 76_000_000}

# Pixel names of the click tracker.
TRACKER_CLICK_PIXEL = "clickTrackingReporter-adClicked"
TRACKER_HOVER_PIXEL = "clickTrackingReporter-activeHover"

# Browser families kept as they are, and names folded into them.
BROWSER_FAMILIES = (
    "Chrome",
    "Safari",
    "UIWebView",
    "Chrome Webview",
    "SamsungBrowser",
    "Firefox",
    "Silk",
    "Edge",
    "Flipboard",
    "Internet Explorer",
)
BROWSER_ALIASES = {
    "Mobile Chrome": "Chrome",
    "Chrome WebView": "Chrome Webview",
    "Mobile Safari": "Safari",
    "safari": "Safari",
    "Facebook": "UIWebView",
    "GSA": "UIWebView",
    "WebKit": "UIWebView",
    "Mobile Firefox": "Firefox",
    "Samsung Internet": "SamsungBrowser",
}


@dataclass(frozen=True)
class Period:
    """Whole days from ``start`` to ``end``, both included."""

    start: date
    end: date

    @classmethod
    def day(cls, as_of: date, days_back: int = 1) -> Period:
        chosen = as_of - timedelta(days=days_back)
        return cls(chosen, chosen)

    @classmethod
    def rolling(cls, as_of: date, oldest: int, newest: int = 1) -> Period:
        return cls(as_of - timedelta(days=oldest), as_of - timedelta(days=newest))

    def covers_ts(self, ts: Column) -> Column:
        """Half-open timestamp range, so the bounds reach the file scan."""
        low = datetime.combine(self.start, time(), timezone.utc)
        high = datetime.combine(self.end + timedelta(days=1), time(), timezone.utc)
        return (ts >= F.lit(low)) & (ts < F.lit(high))

    def covers_date(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))


@dataclass(frozen=True)
class Window:
    """A clock-time window inside one day, both ends included."""

    day: date
    start: time
    end: time

    def covers_ts(self, ts: Column) -> Column:
        low = datetime.combine(self.day, self.start, timezone.utc)
        high = datetime.combine(self.day, self.end, timezone.utc)
        return ts.between(F.lit(low), F.lit(high))

    def covers_date(self, day: Column) -> Column:
        return day == F.lit(self.day)


@dataclass(frozen=True)
class ConversionPixels:
    """Pixel ids of one advertiser's funnel: visit, started and completed."""

    advertiser_id: str
    visit: str
    started: str
    completed: str
    visit_label: str = "site_visit"
    started_label: str = "conversion_started"
    completed_label: str = "conversion_completed"
