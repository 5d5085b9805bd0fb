from datetime import date

import pytest

from adlytics.operators import identity
from adlytics.params import Period
from helpers import ad, bid, request, rows_of, seat, table

DAY = date(2024, 1, 30)
DAYS = Period(DAY, DAY)
PARTS = {"device_name": "d", "os_name": "o", "browser_name": "b"}


def won(name="beeswax"):
    return [ad("a", [seat(seat_name=name, is_bid_request_sent=True, bid_request=[bid(is_impression=True, bid_net_usd=8.0)])])]


@pytest.fixture(scope="module")
def cached(spark):
    def mapping(rows):
        return table(spark, "id_mapping", [{"date": DAY, "mapping_key": k, "user_ad_platform_ids": ids} for k, ids in rows])

    tables = {
        "login": mapping([("5d41402abc4b2a76b9719d911017c592", [("hhip", "H1")])]),  # md5 of "hello"
        "maid": mapping([("same", [("hhip", "H2"), ("x", "no")]), ("same", [("hhip", "H2")])]),
        "pubcid": mapping([("same", [("hhip", "H3")]), ("empty", None), (None, [("hhip", "H4")])]),
        "old": table(spark, "id_mapping", [{"date": date(2024, 1, 29), "mapping_key": "gone", "user_ad_platform_ids": [("hhip", "H5")]}]),
    }
    return identity.cached_households(tables, DAYS)


@pytest.fixture(scope="module")
def seats(spark):
    bids = table(
        spark,
        "bidstream",
        [
            # All five keys equal: each lookup row still matches once.
            request("equal", won(), "same", ip_address="9.9.9.9", **PARTS,
                    user_ids=[("login-id", "x"), ("anonymous-id", "same"), ("maid", "same"), ("pubcid", "same")]),
            request("hashed", won(), None, ip_address="1.1.1.1", **PARTS, user_ids=[("login-id", "hello")]),
            request("home", won(), "u1", ip_address="1.1.1.1", **PARTS),
            request("home", won(), "u1", ip_address="1.1.1.1", **PARTS),
            request("away", won(), "u2", ip_address="2.2.2.2", **PARTS),
            request("away", won(), "u2", ip_address="2.2.2.2", **PARTS),
            request("half home", won(), "u3", ip_address="1.1.1.1", **PARTS),
            request("half home", won(), "u4", ip_address="2.2.2.2", **PARTS),
            request("no parts", won(), "u5", ip_address="1.1.1.1"),
            request("cached, no parts", won(), "same", ip_address="1.1.1.1"),
            request("old", won(), "gone", ip_address="not an address", **PARTS),
        ],
    )
    return identity.person_seats(bids)


@pytest.fixture(scope="module")
def homes(spark):
    return spark.createDataFrame([(DAY, "1.1.1.1")], "date_h date, ip_address_prefix string")


COLUMNS = ("request_id", "ip_source", "premium_web_id", "match_rows")
EQUAL = [("equal", "cached_hhip", "H2dob", 2), ("equal", "cached_hhip", "H3dob", 1)]
HASHED = ("hashed", "cached_hhip", "H1dob", 1)


@pytest.fixture(scope="module")
def placed(seats, cached, homes):
    return identity.place_seats(seats, cached, homes)


def expect(*rows):
    return sorted([*EQUAL, HASHED, *rows], key=repr)


def summed(people):
    return rows_of(people.groupBy(*COLUMNS[:3]).agg({"match_rows": "sum"}))


def test_cached_households(cached):
    assert rows_of(cached) == [
        ("5d41402abc4b2a76b9719d911017c592", "H1", 1), ("same", "H2", 2), ("same", "H3", 1)
    ]


def test_exclusive(placed, cached):
    assert summed(identity.resolve_person(placed, cached)) == expect(
        ("home", "request_hhip", "1.1.1.1odb", 1),
        ("away", "no_hhip_found", "u2", 2),
        ("half home", "request_hhip", "1.1.1.1odb", 1),
        ("no parts", "request_hhip", None, 1),
        ("cached, no parts", "cached_hhip", None, 3),
        ("old", "no_hhip_found", "gone", 1),
    )


def test_distinct_fallback(placed, cached):
    found = summed(identity.resolve_person(placed, cached, "distinct_fallback"))
    fallback = [r for r in found if r[1] == "no_hhip_found"]
    assert len(fallback) == 9 and all(r[3] == 1 for r in fallback)
    assert ("home", "request_hhip", "1.1.1.1odb", 2) in found


def test_cascade(spark, seats, cached):
    prefix_rows = spark.createDataFrame([(DAY, "1.1.1.1", 3)], "date_h date, ip_address_prefix string, prefix_rows bigint")
    assert summed(identity.resolve_person_cascade(seats, cached, prefix_rows)) == expect(
        ("home", "request_hhip", "1.1.1.1odb", 6),
        ("away", "request_hhip", "2.2.2.2odb", 2),
        ("half home", "request_hhip", "1.1.1.1odb", 3),
        ("half home", "request_hhip", "2.2.2.2odb", 1),
        ("no parts", "no_hhip_found", "u5", 3),
        ("cached, no parts", "no_hhip_found", "same", 9),
        ("old", "no_hhip_found", "gone", 1),
    )


def test_each_request_has_one_source(seats, placed, cached):
    people = identity.resolve_person(placed, cached)
    sources = people.select("request_id", "ip_source").distinct().groupBy("request_id").count()
    assert sources.filter("count > 1").count() == 0
    assert sources.count() == seats.select("request_id").distinct().count()


def test_reach(placed, cached):
    # 3 + 1 cached, 1 + 1 + 1 by address, 2 + 1 by user id, 3 cached without parts.
    expected = [("no_exp_bucket", 13, 13, 6)]
    for found in (identity.reach(identity.resolve_person(placed, cached)), identity.reach_report(placed, cached)):
        assert rows_of(found, "exp_type", "bid_request_sent", "imps", "unique_pwid") == expected


def test_reach_report_equals_reach_of_rows(placed, cached):
    by_rows = identity.reach(identity.resolve_person(placed, cached, "distinct_fallback"))
    assert rows_of(identity.reach_report(placed, cached, "distinct_fallback")) == rows_of(by_rows)


def test_unknown_mode(placed, cached):
    for build in (identity.resolve_person, identity.reach_report):
        with pytest.raises(ValueError):
            build(placed, cached, "other")
