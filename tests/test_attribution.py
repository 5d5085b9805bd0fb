import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from adlytics.operators import attribution, event_root, timeline
from adlytics.params import Period
from helpers import rows_of, table, ts

EVENT = f"""user_pwid_raw string, browser_name string, device_type string, os_name string, ip_address string,
    is_household boolean, site_user_id string, ts timestamp, advertiser_domain string, ad_id string, creative_id string,
    campaign_id string, line_item_id string, opportunity_name string, io_number string, bid_gross_usd double,
    beeswax_clicks bigint, tracker_click bigint, impression int, pixel_name string, pixel_id string, conversion bigint"""
START = ts("2024-01-01T00:00:00")


def shown(at, person="p", ad_id="a", domain="d", campaign="c", clicks=None, tracked=None, browser="b", gross=1000.0):
    return (person, browser, "dev", "os", "ip", True, "u", at, domain, ad_id, "1", campaign, "l", "o", "io", gross,
            clicks, tracked, 1, None, None, None)


def bought(at, person="p", domain="d", pixel="px"):
    return (person, "b", "dev", "os", "ip", True, "u", at, domain, None, None, None, None, None, None, None, None, None,
            None, pixel, "1", 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(
    "after, hours, days",
    [
        (timedelta(0), 1, 1),
        (timedelta(minutes=59), 1, 1),
        (timedelta(hours=24), 24, 1),
        (timedelta(hours=24, seconds=1), 24, 1),
        (timedelta(days=7), 168, 7),
        (timedelta(days=7, hours=1), 169, 8),
        (timedelta(days=30), 720, 30),
        (timedelta(days=30, microseconds=1), None, None),
        (timedelta(microseconds=-1), None, None),
    ],
)
def test_window_bounds(spark, after, hours, days):
    at = START + timedelta(hours=5)
    row = attribution.attribute_conversions(frame(spark, [shown(at), bought(at + after)])).first()
    assert (row["hrs_since_impression"], row["days_since_impression"]) == (hours, days)


def test_null_person_or_other_domain_never_matches(spark):
    rows = [shown(START, person=None), bought(START, person=None), shown(START, ad_id="b"), bought(START, domain="x")]
    mapping = attribution.attribute_conversions(frame(spark, rows))
    assert mapping.count() == 2 and mapping.filter("is_conversion_mapped").count() == 0


def test_copies_are_counted_and_spelled_out(spark):
    rows = [shown(START, tracked=2)] * 3 + [bought(START + timedelta(hours=1))] * 2
    mapping = attribution.attribute_conversions(frame(spark, rows))
    assert rows_of(mapping, "conversion_copies", "row_copies", "is_first_row") == [(2, 9, True)]
    spelled = attribution.expand_copies(mapping)
    assert spelled.count() == 18
    assert spelled.select("conversion_primary_key").distinct().count() == 2
    assert spelled.filter("is_first_row").count() == 1
    for report in (attribution.campaign_rollup(mapping), attribution.campaign_report(frame(spark, rows))):
        row = report.first()
        assert (row["impressions"], row["tracker_clicks"], row["conversions"], row["pc_conversions_7d"]) == (1, 2, 2, 2)
        assert row["bid_gross_usd"] == 1.0


def _random_events(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + timedelta(hours=rng.randrange(24 * 45), minutes=rng.choice([0, 0, 29, 59]))
        person, domain = rng.choice(["hot", "hot", "p1", "p2", None]), rng.choice(["d1", "d1", "d2"])
        if rng.random() < 0.6:
            rows.append(
                shown(at, person, f"a{rng.randrange(60)}", domain, rng.choice(["c1", "c2", None]),
                      rng.choice([None, 1]), rng.choice([None, 0, 2]), rng.choice(["b1", None]), float(rng.randrange(5) * 1000))
            )
        else:
            rows.append(bought(at, person, domain, rng.choice(["px", None])))
    return rows + rows[:40]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_without_pairs_equals_rollup_of_pairs(spark, seed):
    events = frame(spark, _random_events(seed))
    direct = rows_of(attribution.campaign_report(events))
    assert direct == rows_of(attribution.campaign_rollup(attribution.attribute_conversions(events)))
    assert sum(r[10] for r in direct) > 0
    for row in direct:
        assert row[11] <= row[12] <= row[10]  # 7 days, 30 days, all


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_brute_force(spark, seed):
    rows = _random_events(seed)
    impressions = [r for r in rows if r[18]]
    conversions = [(i, r) for i, r in enumerate(rows) if r[21]]
    expected = defaultdict(lambda: (set(), set()))
    for i in impressions:
        group = (i[7].date(), i[11], i[1])
        expected[group][0].add((i[7], i[9]))
        for m in impressions:
            if (m[7], m[9]) != (i[7], i[9]):
                continue
            for n, c in conversions:
                same = c[0] is not None and c[0] == m[0] and c[8] == m[8]
                if same and m[7] <= c[7] <= m[7] + timedelta(days=30):
                    expected[group][1].add(n)
    report = attribution.campaign_report(frame(spark, rows))
    found = {(r["date"], r["campaign_id"], r["browser_name"]): (r["impressions"], r["conversions"]) for r in report.collect()}
    assert found == {g: (len(a), len(b)) for g, (a, b) in expected.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_first_touch_equals_brute_force(spark, seed):
    rows = _random_events(seed)
    taken = defaultdict(lambda: [0, 0])
    for c in {(r[0], r[8], r[7]) for r in rows if r[21] and r[0] is not None}:
        for which, days in enumerate((1, 7)):
            reach = [r for r in rows if r[18] and (r[0], r[8]) == c[:2] and r[7] <= c[2] <= r[7] + timedelta(days=days)]
            if reach:
                first = min(reach, key=lambda r: (r[7], r[1] or "", r[11] or ""))
                taken[(first[1], first[8], first[11], first[7].date())][which] += 1
    report = attribution.first_touch_report(frame(spark, rows))
    found = {
        (r["browser_name"], r["advertiser_domain"], r["campaign_id"], r["impression_date"]): [
            r["conversions_attributed_day"] or 0, r["conversions_attributed_week"] or 0]
        for r in report.collect()
    }
    assert {g: n for g, n in found.items() if n != [0, 0]} == dict(taken)
    assert len(found) == len({(r[1], r[8], r[11], r[7].date()) for r in rows if r[18]})


def test_timeline_lookups(spark):
    rng = random.Random(5)
    hour = 60 * timeline.MINUTE_MICROS
    points = [("k" if rng.random() < 0.8 else "l", rng.choice([rng.randrange(30 * hour), 7 * hour + rng.randrange(hour // 30)]), rng.randrange(1, 4)) for _ in range(400)]
    points += [("k", 5 * hour, 1), ("k", 5 * hour, 2)]
    probes = [("k", rng.choice([rng.randrange(32 * hour), 7 * hour + rng.randrange(hour // 30)])) for _ in range(150)]
    probes += [("k", 5 * hour), ("none", 3), ("l", 40 * hour), ("l", 0)]
    asked = spark.createDataFrame(probes, "k string, at bigint").withColumn("tag", F.concat("k", "at"))
    events = spark.createDataFrame(points, "k string, at bigint, n bigint")
    before = {(r["k"], r["at"]): r["n_before"] for r in timeline.count_before(asked, events, ["k"]).collect()}
    assert before == {(k, at): sum(n for j, t, n in points if j == k and t < at) for k, at in probes}
    hits = {(r["k"], r["at"]): r["hit"] and tuple(r["hit"]) for r in timeline.first_at_or_after(asked, events, ["k"], ["n"]).collect()}
    assert hits == {(k, at): min(((t, n) for j, t, n in points if j == k and t >= at), default=None) for k, at in probes}


def test_keep_active(spark):
    lone = list(shown(START, ad_id="lone", domain="z"))
    beside_impression, beside_conversion = list(shown(START)), list(shown(START, browser="other"))
    for row in (lone, beside_impression, beside_conversion):
        row[18] = None
    beside_conversion[8] = "e"
    rows = [shown(START), bought(START, domain="e"), tuple(lone), tuple(beside_impression), tuple(beside_conversion)]
    kept = attribution.keep_active(frame(spark, rows))
    assert sorted(r["ad_id"] or "" for r in kept.collect()) == ["", "a", "a", "a"]


DAYS = Period(date(2024, 1, 1), date(2024, 1, 7))


@pytest.fixture(scope="module")
def root_sides(spark):
    at = ts("2024-01-02T10:00:00")
    page = {"ts": at, "ip_address": "i", "app_region": "eu", "ad_id": "a", "advertiser_domain": "d", "seat_name": "xbeeswax",
            "site_user": ("p", "u"), "bid_net_usd": 2.0}
    impression = [("r", "pre-5", at)]
    pages = table(spark, "pages", [
        page | {"impression": impression * 2},
        page | {"impression": None},
        page | {"impression": impression, "seat_name": "rubicon"},
        page | {"impression": impression, "advertiser_domain": None},
        page | {"impression": impression, "ts": ts("2024-01-08T00:00:00")},
    ])
    prefix = table(spark, "ip_prefix", [{"date": date(2024, 1, 7), "app_region": "eu", "ip_address_prefix": "i", "is_household": False}])
    win = {"bid_time_utc": at, "exchange_imp_id": "a", "creative_id": "5", "line_item_alt_id": "L", "clicks": 0, "in_view_time_millis": 0}
    wins = table(spark, "win_log", [win, win | {"creative_id": "6"}])
    items = table(spark, "line_items", [{"line_item_id": "L", "io_number": "io"}])

    def pixel(kind, name, var1, var2):
        return (at, kind, "1", name, "7", "https://www.d/", var1, var2)

    session = {"date": date(2024, 1, 2), "user_pwid_raw": "p", "browser_name": "GSA"}
    sessions = table(spark, "site_sessions", [
        session | {"site_pages": [
            pixel("tracker", "clickTrackingReporter-adClicked", "r|a", "x|y|z|pre-5"),
            pixel("tracker", "clickTrackingReporter-adClicked", "r|a", "x|y|z|pre-5"),
            pixel("tracker", "other", "r2|a", "x|y|z|pre-5"),
            pixel("conversion", "bought", None, None),
        ]},
        session | {"site_pages": None},
    ])
    attention = table(spark, "attention", [{"date": date(2024, 1, 2), "imp_id": "a", "dv_net_80_viewable_imp": 1}])
    delivered = event_root.delivery_events(
        event_root.page_impressions(pages, prefix, DAYS, Period(date(2024, 1, 7), date(2024, 1, 7)), "pre-"),
        event_root.won_impressions(wins, items, DAYS),
        event_root.tracker_clicks(sessions, DAYS, "pre-"), attention, DAYS,
    )
    return delivered, event_root.conversion_events(sessions, DAYS)


def test_root_sides(root_sides):
    delivered, converted = root_sides
    columns = ("date", "is_household", "delivery.creative_id", "delivery.io_number", "delivery.beeswax_clicks",
               "delivery.beeswax_in_view_time", "delivery.tracker_click", "delivery.tracker_advertiser_domain",
               "delivery.dv_net_80_viewable_imp")
    assert rows_of(delivered, *columns) == [(date(2024, 1, 2), False, "5", "io", None, None, 2, "d", 1)] * 2
    assert rows_of(converted, "browser_name", "conversion.advertiser_domain", "conversion.conversion") == [("UIWebView", "d", 1)]


def test_nested_root_holds_the_same_events(spark, root_sides):
    delivered, converted = root_sides
    delivered = delivered.unionByName(delivered).unionByName(delivered.withColumn("user_pwid_raw", F.lit(None).cast("string")))
    root = event_root.build_event_root(delivered, converted)
    flat = event_root.flatten_event_root(root)
    same = event_root.event_rows(delivered, converted)
    assert rows_of(flat.select(same.columns)) == rows_of(same)
    # Three groups of one hour each, whatever the number of copies.
    assert root.count() == 3


def test_a_side_of_the_nested_root_opens_its_own_array(spark, root_sides, tmp_path):
    path = str(tmp_path / "root")
    event_root.build_event_root(*root_sides).write.parquet(path)
    flat = event_root.flatten_event_root(spark.read.parquet(path))
    opened = {"delivery": "conversions", "conversion": "delivery"}
    for event, other in opened.items():
        side = flat.filter(F.col(event)["ts"].isNotNull()).select("date", f"{event}.ts")
        leaves = side._jdf.queryExecution().optimizedPlan().collectLeaves()
        assert leaves.size() == 1
        read = side._jdf.queryExecution().executedPlan().toString()
        assert f"{other}:array" not in read[read.index("ReadSchema") :]
        assert side.count() == len(rows_of(flat.filter(F.col(event).isNotNull())))
