"""One key holding almost every row: results stay whole and no pairs are formed."""

from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from adlytics.operators import attribution, conversions, event_root, identity, overlap
from adlytics.params import ConversionPixels
from checks import compare

N = 40_000
PIXELS = ConversionPixels("7", visit="1", started="2", completed="3")
FOLDER = "/root/testdata/sf0.001"


def hot_events(spark):
    """N impressions and N conversions of one person, a minute apart, conversions 30 s later."""
    minute = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    person = [F.lit(v).alias(n) for n, v in (("user_pwid_raw", "p"), ("browser_name", "b"), ("device_type", "d"),
              ("os_name", "o"), ("ip_address", "i"), ("is_household", True), ("site_user_id", "u"))]
    none = [F.lit(None).cast("string").alias(n) for n in ("line_item_id", "opportunity_name", "io_number")]
    shown = spark.range(N).select(
        *person, minute.alias("ts"), F.lit("x").alias("advertiser_domain"), F.concat(F.lit("a"), "id").alias("ad_id"),
        F.lit("1").alias("creative_id"), F.lit("c").alias("campaign_id"), *none, F.lit(1000.0).alias("bid_gross_usd"),
        F.lit(None).cast("bigint").alias("beeswax_clicks"), F.lit(1).cast("bigint").alias("tracker_click"),
        F.lit(1).alias("impression"),
    )
    bought = spark.range(N).select(
        *person, (minute + F.expr("INTERVAL 30 SECONDS")).alias("ts"), F.lit("x").alias("advertiser_domain"),
        F.concat(F.lit("px"), "id").alias("pixel_name"), F.lit("1").alias("pixel_id"), F.lit(1).cast("bigint").alias("conversion"),
    )
    return shown.unionByName(bought, allowMissingColumns=True)


def test_campaign_report(spark):
    found = {r["date"]: r for r in attribution.campaign_report(hot_events(spark)).collect()}
    assert sum(r["impressions"] for r in found.values()) == N
    start = date(2024, 1, 1)
    for day, row in found.items():
        first = (day - start).days * 1440
        last = min(first + 1439, N - 1)
        # Every conversion from the day's first impression on, N minutes being under 30 days.
        assert row["conversions"] == row["pc_conversions_30d"] == N - first
        assert row["pv_conversions_7d"] == min(N, (last // 60 + 169) * 60) - first


def test_first_touch_report(spark):
    rows = attribution.first_touch_report(hot_events(spark)).collect()
    # The earliest impression within a day before each conversion is its own day's or the day before's.
    assert sum(r["conversions_attributed_day"] or 0 for r in rows) == N
    assert sum(r["conversions_attributed_week"] or 0 for r in rows) == N
    first_week = next(r for r in rows if r["impression_date"] == date(2024, 1, 1))
    assert first_week["conversions_attributed_week"] == 7 * 1440 + 1440 - 1


def site_events(spark):
    rows = spark.range(N).select(
        F.lit("hot").alias("site_user_id"), F.lit("home").alias("ip_address"), F.lit("b").alias("browser_name"),
        F.lit("d").alias("device_type"), F.lit("o").alias("os_name"), F.lit("v").alias("os_version"),
        F.lit("7").alias("internal_advertiser_id"), F.lit("px").alias("pixel_name"), F.lit("?utm_medium=m").alias("page_url"),
        F.lit("1").alias("pixel_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
    )
    return conversions.site_conversions(rows, PIXELS)


def hot_seats(spark):
    return spark.range(N).select(
        F.lit(date(2024, 1, 1)).alias("date_ts"), F.concat(F.lit("r"), "id").alias("request_id"),
        F.lit("beeswax").alias("seat_name"), F.lit(True).alias("is_bid_request_sent"), F.lit(True).alias("br_is_impression"),
        F.lit(1000.0).alias("br_max_bid_net_usd"), F.lit("hot").alias("site_user_id"), F.lit("home").alias("ip_address"),
        F.lit(True).alias("is_household"), F.lit(None).cast("boolean").alias("is_test_arm"),
        F.lit(None).cast("boolean").alias("is_control_arm"), F.lit("b").alias("browser_name"), F.lit("o").alias("os_name"),
        F.lit("v").alias("os_version"),
    )


def test_conversion_mapping(spark):
    shown = conversions.impression_keys(hot_seats(spark))
    mapped = conversions.map_conversions(shown, site_events(spark), PIXELS)
    row = conversions.conversion_report(conversions.consolidate_conversions(mapped, PIXELS)).first()
    assert (row["imps"], row["total_visits"], row["conversion_source_user_id"], row["br_revenue"]) == (N, N, N, float(N))


def test_device_match(spark):
    summed = conversions.device_match_sums(hot_seats(spark))
    row = conversions.device_match_report(summed, site_events(spark)).first()
    assert (row["bid_request_sent"], row["total_user_id_count"], row["distinct_user_id_count"]) == (N * N, N * N, 1)


def test_overlap(spark):
    ads = hot_seats(spark).withColumnsRenamed({"br_is_impression": "is_impression", "br_max_bid_net_usd": "max_bid_net_usd"})
    homes = spark.createDataFrame([(date(2024, 1, 1), "home")], "date_h date, ip_address_prefix string")
    row = overlap.delivery_overlap(overlap.delivery_sums(ads), homes, site_events(spark), PIXELS).first()
    assert (row["total_requests"], row["visits"], row["conversion_mapping_source"]) == (N, N, "user_id")


def test_copies_are_one_entry_and_hours_split_a_group(spark):
    at = F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")))
    rows = spark.range(N).select(F.lit("k").alias("k"), F.struct(at.alias("ts"), (F.col("id") % 2 * F.col("id")).alias("x")).alias("e"))
    nested = event_root.nest_events(rows, ["k"], "e", "es")
    entries = nested.select("hour", F.explode("es").alias("e")).select("hour", "e.x", "e.copies")
    back = {r["x"]: r["copies"] for r in entries.collect()}
    assert back[0] == N // 2 and len(back) == 1 + N // 2 and all(n == 1 for x, n in back.items() if x)
    assert max(r[0] for r in nested.select(F.array_size("es")).collect()) <= 1801
    assert nested.count() == -(-N // 3600)


def test_device_match_of_different_devices_and_fingerprints(spark):
    """One user on N device keys and with N fingerprints: N results of each, no N * N rows."""
    seats = hot_seats(spark).withColumn("ip_address", F.concat(F.lit("seat"), "request_id"))
    events = site_events(spark).withColumn("ip_address", F.concat(F.lit("conv"), F.monotonically_increasing_id().cast("string")))
    row = conversions.device_match_report(conversions.device_match_sums(seats), events).first()
    assert (row["bid_request_sent"], row["total_user_id_count"], row["total_pwid_count"]) == (N * N, N * N, N * N)
    assert (row["distinct_user_id_count"], row["distinct_pwid_count"]) == (1, N)


def test_one_address_with_many_sources(spark):
    """N impressions at an address with N different sources: a result row per source."""
    seats = hot_seats(spark).withColumn("site_user_id", F.concat(F.lit("other"), "request_id"))
    events = site_events(spark).withColumn("utm_source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    report = conversions.utm_conversion_report(conversions.impression_keys(seats), events, PIXELS)
    totals = report.agg(F.count(F.lit(1)).alias("n"), F.min("imps").alias("low"), F.max("imps").alias("high"), F.sum("total_visits").alias("v"))
    assert tuple(totals.first()) == (N, N, N, N * N)


def test_shared_lookup_key(spark):
    seats = hot_seats(spark).withColumns(
        {"ad_id": F.lit("a"), "device_name": F.lit("d"), "lookup_set": F.array(F.lit("shared"))}
    )
    # N seats and N households under one identifier: N persons, N * N matches.
    cached = spark.range(N).select(
        F.lit("shared").alias("mapping_key"), F.concat(F.lit("H"), "id").alias("household_id"),
        F.lit(3).cast("bigint").alias("cached_rows"),
    )
    homes = spark.createDataFrame([], "date_h date, ip_address_prefix string")
    row = identity.reach_report(identity.place_seats(seats, cached, homes), cached).first()
    assert (row["bid_request_sent"], row["unique_pwid"]) == (3 * N * N, N)


@pytest.mark.parametrize(
    "name",
    ["device_match_report", "consolidate_conversions", "delivery_overlap_with_totals", "reach_exclusive",
     "attribute_conversions", "campaign_report", "first_touch_report", "match_pixels_to_line_items"],
)
def test_same_result_when_nothing_is_small_enough_to_broadcast(spark, name):
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        assert compare.compare(spark, compare.connect(FOLDER), FOLDER, name) == ""
    finally:
        for limit in limits:
            spark.conf.unset(limit)
