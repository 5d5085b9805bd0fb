from collections import Counter
from datetime import date

import pytest

from adlytics.operators import conversions, joins, overlap
from adlytics.params import ConversionPixels
from helpers import rows_of, table, ts

PIXELS = ConversionPixels("7", visit="1", started="2", completed="3")
DAY = date(2024, 1, 30)
IMPRESSION = """date_ts date, request_id string, seat_name string, is_bid_request_sent boolean, br_is_impression boolean,
    br_max_bid_net_usd double, site_user_id string, ip_address string, is_household boolean"""


def event(pixel, user, address, url="", name="p", **fields):
    return {
        "ts": ts("2024-01-30T10:00:00"), "pixel_id": pixel, "site_user_id": user, "ip_address": address,
        "page_url": url, "pixel_name": name, "internal_advertiser_id": "7", **fields,
    }


def impression(request, user, address, home=True):
    return (DAY, request, "beeswax", True, True, 1000.0, user, address, home)


@pytest.fixture(scope="module")
def to_map(spark):
    events = [
        event("1", "visits", "ip1", "?utm_medium=email&utm_source=a"),
        event("1", "visits", "ip1", "?utm_medium=cpc&utm_source=b"),
        event("2", "starts", "ip2"),
        event("3", "starts", "ip3", "?utm_medium=late"),
        event("1", "both", "ip4"),
        event("2", "both", "ip4"),
        event("1", None, "home", "?utm_source=h"),
        event("2", None, "home"),
        event("1", "elsewhere", "home") | {"internal_advertiser_id": "8"},
    ]
    found = conversions.site_conversions(table(spark, "site_events", events), PIXELS)
    shown = spark.createDataFrame(
        [
            impression("by user", "visits", "home"),
            impression("by user", "visits", "home"),
            impression("user without visit", "starts", "home"),
            impression("user with both", "both", "ip4"),
            impression("unknown user", "nobody", "home"),
            impression("no user", None, "home"),
            impression("not a home", None, "home", home=False),
            impression("no address", None, None),
        ],
        IMPRESSION,
    )
    return conversions.impression_keys(shown), found


@pytest.fixture(scope="module")
def mapped(to_map):
    return conversions.map_conversions(*to_map, PIXELS)


def test_user_then_household(mapped):
    found = {r["request_id"]: r for r in conversions.consolidate_conversions(mapped, PIXELS).collect()}
    shown = {
        name: (r["visit_pixels"], r["started_pixels"], r["completed_pixels"], r["conversion_sources"], r["utm_medium"], r["utm_source"])
        for name, r in found.items()
    }
    visit, started = ["site_visit"], ["conversion_started"]
    by_home = (visit, started, None, ["hhip"], None, ["h"])
    assert shown == {
        "by user": (visit, None, None, ["user_id"], ["cpc", "email"], ["a", "b"]),
        "user without visit": by_home,
        "user with both": (visit, started, None, ["hhip", "user_id"], None, None),
        "unknown user": by_home,
        "no user": by_home,
        "not a home": (None, None, None, None, None, ["h"]),
        "no address": (None, None, None, None, None, None),
    }


def test_missing_arrays_count_as_null_or_zero(mapped):
    def totals(empty):
        report = conversions.conversion_report(conversions.consolidate_conversions(mapped, PIXELS, empty))
        return {r["is_household"]: (r["total_visits"], r["total_completed"], r["conversion_source_hhip"]) for r in report.collect()}

    assert totals("null") == {True: (5, None, 4), False: (None, None, 0)}
    assert totals("empty") == {True: (5, 0, 4), False: (0, 0, 0)}


def test_utm_pairs_repeat_the_impression(to_map):
    report = conversions.utm_conversion_report(*to_map, PIXELS, "empty")
    found = {(r["is_household"], r["utm_medium"], r["utm_source"]): (r["imps"], r["total_visits"]) for r in report.collect()}
    assert found == {
        (True, "cpc", "a"): (1, 1), (True, "cpc", "b"): (1, 1), (True, "email", "a"): (1, 1), (True, "email", "b"): (1, 1),
        (True, "null", "h"): (3, 3), (True, "null", "direct"): (2, 1), (False, "null", "h"): (1, 0),
    }


def test_site_report_pairs_tags_of_a_visitor(spark):
    events = [
        event("1", "u", "i", "?utm_medium=a&utm_source=x"), event("3", "u", "i", "?utm_medium=b"),
        event("1", "u", "other"),
    ]
    report = conversions.site_conversion_utm_report(
        conversions.site_conversions(table(spark, "site_events", events), PIXELS), PIXELS
    )
    assert rows_of(report) == [
        (DAY, "a", "x", 1, None, 1), (DAY, "b", "x", 1, None, 1), (DAY, "null", "direct", 1, None, None)
    ]


def test_id_counts(spark):
    device = {"browser_name": "b", "device_type": "d", "os_name": "o", "os_version": "v"}
    events = [event("1", "u", "i", **device), event("1", "u", "i", **device), event("1", None, "i", **(device | {"os_version": None}))]
    found = conversions.conversion_id_counts(conversions.site_conversions(table(spark, "site_events", events), PIXELS))
    assert rows_of(found) == [(DAY, "p", 1, 2, 1, 2)]


SEATS = """date_ts date, request_id string, seat_name string, is_bid_request_sent boolean, br_is_impression boolean,
    br_max_bid_net_usd double, is_test_arm boolean, is_control_arm boolean, site_user_id string, ip_address string,
    browser_name string, os_name string, os_version string"""


def _seat(user, address, request="r"):
    return (DAY, request, "beeswax", True, None, 8.0, None, None, user, address, "b", "o", "v")


def _match(spark, seats, events, strict=False):
    device = {"browser_name": "b", "device_type": "d", "os_name": "o", "os_version": "v"}
    rows = [e | device for e in events]
    report = conversions.device_match_report(
        conversions.device_match_sums(spark.createDataFrame(seats, SEATS)), conversions.site_conversions(table(spark, "site_events", rows), PIXELS), strict
    )
    return {r["pixel_name"]: (r["bid_request_sent"], r["total_user_id_count"], r["total_pwid_count"]) for r in report.collect()}


def test_device_match_keeps_a_bare_row_unless_strict(spark):
    seats = [_seat("u1", "x"), _seat("u2", "y"), _seat("u3", "z"), _seat(None, "y")]
    events = [event("3", "u1", "y", name="user"), event("3", "u9", "y", name="device"), event("3", "u9", "y", name="device")]
    assert _match(spark, seats, events) == {"user": (1, 1, 1), "device": (4, 4, 4), None: (3, 0, 0)}
    assert _match(spark, seats, events, strict=True) == {"user": (1, 1, 1), "device": (4, 4, 4), None: (1, 0, 0)}


def test_unmatched_conversions_follow_not_in(spark):
    seats = [_seat("u1", "x"), _seat("u2", "y")]
    nameless = event("3", None, "y", name="nameless")
    # A user match makes the list non-empty, and NULL is then not "not in" it.
    assert _match(spark, seats, [event("3", "u1", "x", name="user"), nameless]) == {"user": (1, 1, 1), None: (1, 0, 0)}
    assert _match(spark, seats, [nameless]) == {"nameless": (1, 0, 1), None: (2, 0, 0)}


def test_not_in(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")

    def kept(known):
        return rows_of(joins.not_in(rows, "k", spark.createDataFrame(known, "x string"), "x"))

    assert kept([]) == [("a",), ("b",), (None,)]
    assert kept([("a",), ("a",)]) == [("b",)]
    assert kept([("a",), (None,)]) == []


def test_hot_and_missing_keys_lose_nothing(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(3000)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), (None, 3)], "k string, v int")
    joined = joins.left_join(left, right.withColumnRenamed("k", "rk"), "k", "rk")
    assert Counter(r["v"] for r in joined.collect()) == {1: 1000, 2: 1, None: 1999}
    assert joined.count() == 3000


def test_overlap_counts_addresses_per_conversion_group(spark):
    ads = spark.createDataFrame(
        [(DAY, "r1", "known", "i1", True, 1000.0, True), (DAY, "r2", "new", "i2", True, 1000.0, True),
         (DAY, "r3", None, "i2", None, 3000.0, True), (DAY, "r4", None, "i3", False, None, False)],
        "date_ts date, request_id string, site_user_id string, ip_address string, is_impression boolean, max_bid_net_usd double, is_household boolean",
    )
    homes = spark.createDataFrame([(DAY, "i2"), (DAY, "i1")], "date_h date, ip_address_prefix string")
    events = [
        event("1", "known", "i1", "?utm_medium=m"), event("2", "known", "i1", "?utm_medium=m"),
        event("1", "a", "i2"), event("3", "b", "i2", "?utm_source=s"), event("1", "c", "i3"), event("1", "c", "i3"),
    ]
    found = conversions.site_conversions(table(spark, "site_events", events), PIXELS)
    delivered = overlap.delivery_sums(ads)

    def report(strict):
        rows = overlap.delivery_overlap(delivered, homes, found, PIXELS, strict)
        columns = ("is_household", "conversion_mapping_source", "utm_medium", "utm_source", "total_requests",
                   "total_impressions", "total_revenue", "visits", "started", "completed")
        return rows_of(rows, *columns)

    by_user = (False, "user_id", "m", None, 1, 1, 1.0, 1, 1, 0)
    no_match = (False, None, None, None, 1, 0, None, None, None, None)
    assert report(False) == sorted([
        by_user, no_match, (True, "hhip", None, None, 4, 2, 8.0, 1, 0, 0), (True, "hhip", None, "s", 4, 2, 8.0, 0, 0, 1)], key=repr)
    assert report(True) == sorted([
        by_user, no_match, (True, "hhip", None, None, 2, 1, 4.0, 1, 0, 0), (True, "hhip", None, "s", 2, 1, 4.0, 0, 0, 1)], key=repr)
    totals = overlap.addressable_totals(found, PIXELS)
    assert rows_of(totals) == [("m", None, 1, 1, 0), (None, None, 2, 0, 0)]
