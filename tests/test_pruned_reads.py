"""Each operator on a read cut down to its fields gives what it gives on the whole table."""

import pytest

from adlytics.operators import conversions, delivery, household, identity, overlap
from adlytics.schemas import BID_FIELDS
from adlytics.sources.derived import COUNTRY, CREATIVE, MONTH, Derived
from adlytics.sources.tables import read_table, save_table, scan
from helpers import rows_of

FOLDER = "/root/testdata/sf0.001"
HOMES = "date_h date, ip_address_prefix string"


def _flagged(rows):
    return household.flag_household(rows, rows.sparkSession.createDataFrame([], HOMES))


BUILDS = {
    "seat_delivery_report": lambda bids: delivery.seat_delivery_report(scan(bids, MONTH)),
    "bid_creative_reach": lambda bids: delivery.bid_creative_reach(scan(bids, MONTH, country=COUNTRY), CREATIVE),
    "id_source_report": lambda bids: delivery.id_source_report(bids),
    "device_match": lambda bids: conversions.device_match_sums(delivery.seat_level(scan(bids, MONTH))),
    "map_conversions": lambda bids: conversions.impression_keys(
        _flagged(delivery.seat_level(scan(bids, MONTH, country=COUNTRY), impressions_only=True, creative_id=CREATIVE))
    ),
    "person_seats": lambda bids: identity.person_seats(scan(bids, MONTH, country=COUNTRY)),
    "ad_level": lambda bids: overlap.delivery_sums(_flagged(delivery.ad_level(scan(bids, MONTH, country=COUNTRY)))),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bids"))
    return folder, save_table(Derived(spark, FOLDER).bidstream(), folder)


@pytest.mark.parametrize("name", sorted(BID_FIELDS))
def test_pruned_read(spark, stored, name):
    folder, whole = stored
    pruned = BUILDS[name](read_table(spark, folder, "bidstream", BID_FIELDS[name]))
    assert rows_of(pruned) == rows_of(BUILDS[name](whole))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    unread = {"max_bid_net_usd": "ad.seat.max_bid_net_usd", "id_source_graph": "ad.seat.bid_request.id_source_graph"}
    assert [f for f, path in unread.items() if path not in BID_FIELDS[name] and f"{f}:" in plan] == []
