from datetime import date

import pytest

from adlytics.operators import delivery, household
from adlytics.params import Period
from helpers import ad, bid, request, rows_of, seat, table

TEST = [("b_id", "d_ig")]
CONTROL = [("b_id", "ctr")]
DAY = Period(date(2024, 1, 30), date(2024, 1, 30))


@pytest.fixture(scope="module")
def bids(spark):
    return table(
        spark,
        "bidstream",
        [
            request(
                "r1",
                [
                    ad(
                        "a1",
                        [
                            seat(seat_name="beeswax", is_bid_request_sent=True, is_impression=True, max_bid_net_usd=4.0,
                                 experiment=TEST + CONTROL,
                                 bid_request=[bid(is_impression=False, bid_net_usd=9.0, bid_creative_id="c1"),
                                              bid(is_impression=True, bid_net_usd=3.0, bid_creative_id="c2", user_id="u")]),
                            seat(seat_name="rubicon", is_bid_request_sent=True, is_impression=False, max_bid_net_usd=8.0),
                        ],
                        True,
                    ),
                    ad("a2", [seat(seat_name="ozbwompx", is_bid_request_sent=False, experiment=CONTROL, bid_request=[])]),
                ],
            ),
            request("r2", [ad("a3", [seat(seat_name="testbeeswaxseat", bid_request=None, experiment=None)])]),
            request("r3", [ad("a4", []), ad("a5", None)]),
            request("r4", []),
            request("r5", None),
            request("r6", [ad("a6", [seat(seat_name=None, is_bid_request_sent=True)])]),
        ],
    )


def test_seat_level(bids):
    found = rows_of(
        delivery.seat_level(bids), "request_id", "ad_id", "seat_name", "is_test_arm", "is_control_arm",
        "creative_id", "bid_user_id", "br_is_impression", "br_max_bid_net_usd",
    )
    assert found == [
        ("r1", "a1", "beeswax", True, True, "c2", None, True, 3.0),
        ("r1", "a2", "ozbwompx", None, True, None, None, None, None),
        ("r2", "a3", "testbeeswaxseat", None, None, None, None, None, None),
    ]


def test_seat_level_without_patterns_keeps_every_request(bids):
    found = rows_of(delivery.seat_level(bids, seat_patterns=None), "request_id", "ad_id", "seat_name")
    assert [r[0] for r in found] == ["r1", "r1", "r1", "r2", "r3", "r3", "r4", "r5", "r6"]


def test_impressions_of_a_creative(bids):
    assert delivery.seat_level(bids, impressions_only=True).count() == 1
    assert delivery.seat_level(bids, impressions_only=True, creative_id="c2").count() == 1
    assert delivery.seat_level(bids, impressions_only=True, creative_id="c1").count() == 0


def test_ad_level(bids):
    found = rows_of(delivery.ad_level(bids), "request_id", "ad_id", "is_impression", "max_bid_net_usd")
    assert found == [
        ("r1", "a1", True, 4.0),
        ("r1", "a2", None, None),
        ("r2", "a3", None, None),
        ("r3", "a4", None, None),
        ("r3", "a5", None, None),
        ("r4", None, None, None),
        ("r5", None, None, None),
        ("r6", "a6", None, None),
    ]


def test_flags_are_counted_by_mode(bids):
    both = {
        mode: {r["exp_type"]: (r["bid_request_sent"], r["imps"], r["fill_rate"], r["cpm"]) for r in
               delivery.seat_delivery_report(bids, mode).filter("ad_platform = 'other'").collect()}
        for mode in ("non_null", "true_only")
    }
    assert both["non_null"] == {"enable_id_graph": (1, 0, 0.0, None), "other": (0, 0, None, None)}
    assert both["true_only"] == {"enable_id_graph": (0, 0, None, None), "other": (0, 0, None, None)}
    with pytest.raises(ValueError):
        delivery.seat_delivery_report(bids, "all")


def test_arm_labels(bids):
    labelled = delivery.label_seats(delivery.seat_level(bids), neither="normal_workflow")
    assert rows_of(labelled, "seat_name", "ad_platform", "exp_type") == [
        ("beeswax", "beeswax", "disable_id_graph"),
        ("ozbwompx", "other", "enable_id_graph"),
        ("testbeeswaxseat", "other", "normal_workflow"),
    ]


def test_id_source_flags(spark):
    bids = table(
        spark,
        "bidstream",
        [
            request(
                "r1",
                [
                    ad("a", [
                        seat(seat_name="s1", is_impression=True, max_bid_net_usd=2.0,
                             bid_request=[bid(id_source_graph="login-id"), bid(is_user_id=True)]),
                        seat(seat_name="s2", is_impression=None, max_bid_net_usd=2.0,
                             bid_request=[bid(id_source_graph="hhip", is_user_id=True), bid(is_user_id=False)]),
                    ])
                ],
            )
        ],
    )
    found = rows_of(delivery.id_source_flags(bids), "seat_name", *delivery.ID_SOURCE_COLUMNS, "max_bid_net_usd")
    assert found == [
        ("s1", None, None, True, None, None, True, 2.0),
        ("s2", None, True, None, None, None, None, 0.0),
    ]


def test_households(spark):
    day = DAY.start
    other = date(2024, 1, 29)
    ids = [("hhip", "h"), ("x", "y")]
    mapping = table(
        spark,
        "ip_prefix_mapping",
        [
            {"date": day, "ip_address_prefix": "p1", "app_region": "eu", "order_tier": 55_000_000, "user_ad_platform_ids": ids},
            {"date": day, "ip_address_prefix": "p1", "app_region": "eu", "order_tier": 1, "user_ad_platform_ids": None},
            {"date": day, "ip_address_prefix": "p2", "app_region": "eu", "order_tier": 55_000_001},
            {"date": day, "ip_address_prefix": "p3", "app_region": "us", "order_tier": 76_000_000},
            {"date": other, "ip_address_prefix": "p4", "app_region": "eu", "order_tier": 1},
        ],
    )
    homes = household.household_prefixes(mapping, DAY)
    assert rows_of(homes) == [(day, "p1")]
    assert rows_of(household.household_prefixes(mapping, DAY, region="us")) == [(day, "p3")]
    assert rows_of(household.household_prefix_rows(mapping, DAY)) == [(day, "p1", 3)]
    seats = spark.createDataFrame([(day, "p1"), (day, None), (other, "p1")], "date_ts date, ip_address string")
    assert rows_of(household.flag_household(seats, homes)) == [
        (other, "p1", False), (day, "p1", True), (day, None, False)
    ]
