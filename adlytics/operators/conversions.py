"""Mapping site conversions to impressions by user id, household address or device.

Conversions are summed up per join key before they meet the impressions, and reports sum both sides
before they join them, so no impression-by-conversion pairs are produced, however hot a key is. Only
``match_user_then_device`` gives pairs, as its result is the matches; no report reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.functions.arrays import count_equal, distinct_values, merge_distinct
from adlytics.functions.text import fingerprint, utm_medium, utm_source
from adlytics.operators.delivery import ad_platform, label_seats, rates, seat_totals
from adlytics.operators.joins import drop_known, join_null_safe, keep_known, left_join, not_in
from adlytics.params import HOUSEHOLD_PLATFORM, ConversionPixels, Period, Window
from adlytics.workspace import Workspace

USER_SOURCE = "user_id"
HOUSEHOLD_SOURCE = HOUSEHOLD_PLATFORM

_DEVICE_FIELDS = ("ip_address", "browser_name", "device_type", "os_name", "os_version")


def site_conversions(
    events: DataFrame, pixels: ConversionPixels, when: Period | Window | None = None
) -> DataFrame:
    """One advertiser's pixel events with day and UTM tags."""
    kept = events.filter(F.col("internal_advertiser_id") == pixels.advertiser_id)
    if when is not None:
        kept = kept.filter(when.covers_ts(F.col("ts")))
    return kept.select(
        F.to_date("ts").alias("date_ts"),
        "ip_address",
        "site_user_id",
        "pixel_id",
        "pixel_name",
        *[c for c in _DEVICE_FIELDS[1:] if c in events.columns],
        utm_medium(F.col("page_url")).alias("utm_medium"),
        utm_source(F.col("page_url")).alias("utm_source"),
    )


def conversion_id_counts(conversions: DataFrame) -> DataFrame:
    """Distinct and total user ids and device fingerprints per day and pixel."""
    device = fingerprint(*[F.col(c) for c in _DEVICE_FIELDS])
    rows = conversions.select("date_ts", "pixel_name", "site_user_id", device.alias("device"))
    by = ["date_ts", "pixel_name"]

    def counts(what: str, name: str) -> DataFrame:
        each = rows.groupBy(*by, what).agg(F.count(what).alias("n"))
        return each.groupBy(*by).agg(
            F.count(what).alias(f"distinct_{name}_count"), F.sum("n").alias(f"total_{name}_count")
        )

    return join_null_safe(counts("site_user_id", "user_id"), counts("device", "pwid"), by, "inner")


def _kept(space: Workspace | None, table: DataFrame, name: str) -> DataFrame:
    return table if space is None else space.save(table, name)


# --- by user id, then by household address -----------------------------------------


def impression_keys(seats: DataFrame) -> DataFrame:
    """The columns that identify an impression in the mapping, without copies."""
    return seats.select(
        "date_ts",
        "request_id",
        "seat_name",
        "is_bid_request_sent",
        "br_is_impression",
        "br_max_bid_net_usd",
        "site_user_id",
        "ip_address",
        "is_household",
    ).distinct()


def map_conversions(impressions: DataFrame, conversions: DataFrame, pixels: ConversionPixels) -> DataFrame:
    """Per impression, which conversions its user id or household address reaches.

    A site visit by the same user maps by user id. The household address is tried for an
    impression whose user has no conversion, and for one whose user has a conversion other
    than a visit; it counts only for households, while UTM tags of its conversions are
    collected for every address.
    """
    is_visit = F.coalesce(F.col("pixel_id") == pixels.visit, F.lit(False))
    by_user = conversions.groupBy(F.col("site_user_id").alias("conversion_user")).agg(
        F.max(is_visit).alias("user_visit"),
        F.max(~is_visit).alias("user_other"),
        distinct_values(F.when(is_visit, F.col("utm_medium"))).alias("user_medium"),
        distinct_values(F.when(is_visit, F.col("utm_source"))).alias("user_source"),
    )
    by_address = conversions.groupBy(F.col("ip_address").alias("conversion_address")).agg(
        F.max(is_visit).alias("address_visit"),
        F.max(F.col("pixel_id") == pixels.started).alias("address_started"),
        F.max(F.col("pixel_id") == pixels.completed).alias("address_completed"),
        distinct_values(F.col("utm_medium")).alias("address_medium"),
        distinct_values(F.col("utm_source")).alias("address_source"),
    )
    joined = left_join(impressions, by_user, "site_user_id", "conversion_user")
    joined = left_join(joined, by_address, "ip_address", "conversion_address")
    mapped_by_user = F.coalesce(F.col("user_visit"), F.lit(False))
    tries_address = F.coalesce(F.col("user_other"), F.lit(True))

    def by_household(flag: str) -> Column:
        return tries_address & F.col("is_household") & F.coalesce(F.col(flag), F.lit(False))

    return joined.select(
        *impressions.columns,
        mapped_by_user.alias("by_user"),
        by_household("address_visit").alias("by_household"),
        (mapped_by_user | by_household("address_visit")).alias("has_visit"),
        by_household("address_started").alias("has_started"),
        by_household("address_completed").alias("has_completed"),
        merge_distinct(
            F.when(mapped_by_user, F.col("user_medium")), F.when(tries_address, F.col("address_medium"))
        ).alias("utm_medium"),
        merge_distinct(
            F.when(mapped_by_user, F.col("user_source")), F.when(tries_address, F.col("address_source"))
        ).alias("utm_source"),
    )


def consolidate_conversions(mapped: DataFrame, pixels: ConversionPixels, empty_arrays: str = "null") -> DataFrame:
    """One row per impression with arrays of its distinct pixels, sources and UTM tags."""
    flags = ("by_user", "by_household", "has_visit", "has_started", "has_completed")
    none = F.lit(None).cast("array<string>")
    missing = none if empty_arrays == "null" else F.array().cast("array<string>")

    def labels(**tests: str) -> Column:
        present = F.array_compact(F.array(*[F.when(F.col(t), F.lit(name)) for name, t in tests.items()]))
        return F.when(F.array_size(present) > 0, present).otherwise(missing)

    return mapped.select(
        *[c for c in mapped.columns if c not in (*flags, "utm_medium", "utm_source")],
        labels(**{pixels.visit_label: "has_visit"}).alias("visit_pixels"),
        labels(**{pixels.started_label: "has_started"}).alias("started_pixels"),
        labels(**{pixels.completed_label: "has_completed"}).alias("completed_pixels"),
        labels(**{HOUSEHOLD_SOURCE: "by_household", USER_SOURCE: "by_user"}).alias("conversion_sources"),
        F.coalesce("utm_medium", missing).alias("utm_medium"),
        F.coalesce("utm_source", missing).alias("utm_source"),
    )


def _conversion_totals() -> list[Column]:
    return [
        F.sum(F.array_size("visit_pixels")).alias("total_visits"),
        F.sum(F.array_size("started_pixels")).alias("total_started"),
        F.sum(F.array_size("completed_pixels")).alias("total_completed"),
        F.sum(count_equal(F.col("conversion_sources"), USER_SOURCE)).alias("conversion_source_user_id"),
        F.sum(count_equal(F.col("conversion_sources"), HOUSEHOLD_SOURCE)).alias("conversion_source_hhip"),
    ]


_TOTALS = (
    "total_visits",
    "total_started",
    "total_completed",
    "conversion_source_user_id",
    "conversion_source_hhip",
)


def conversion_report(consolidated: DataFrame) -> DataFrame:
    """Delivery metrics and conversion totals per day, platform and household flag."""
    by = ["date_ts", "ad_platform", "is_household"]
    labelled = consolidated.withColumn("ad_platform", ad_platform(F.col("seat_name")))
    totals = labelled.groupBy(*by).agg(*seat_totals("true_only"), *_conversion_totals())
    return totals.select(*by, "bid_request_sent", "imps", *rates(("br_revenue", "cpm")), *_TOTALS)


def _mapping_flags(impressions: DataFrame, conversions: DataFrame, pixels: ConversionPixels) -> DataFrame:
    """The flags of ``map_conversions`` per impression, without tags."""
    mapped = map_conversions(impressions, conversions, pixels).drop("utm_medium", "utm_source")
    other = conversions.groupBy(F.col("site_user_id").alias("other_user")).agg(
        F.max(F.coalesce(F.col("pixel_id") != pixels.visit, F.lit(True))).alias("user_other")
    )
    tried = left_join(mapped, other, "site_user_id", "other_user")
    return tried.withColumn("tries_address", F.coalesce("user_other", F.lit(True))).drop("user_other")


def _tags(groups: DataFrame, by_user: DataFrame, by_address: DataFrame, tag: str, missing: str) -> DataFrame:
    """Distinct (tag_user, tag_address, tag) of the groups, `missing` where there is none."""
    of_user = by_user.filter(F.col(tag).isNotNull()).select(F.col("site_user_id").alias("user_key"), tag).distinct()
    of_address = by_address.filter(F.col(tag).isNotNull()).select(F.col("ip_address").alias("address_key"), tag).distinct()
    keys = ["tag_user", "tag_address"]
    found = (
        groups.join(of_user, F.col("tag_user") == F.col("user_key"))
        .select(*keys, tag)
        .unionByName(groups.join(of_address, F.col("tag_address") == F.col("address_key")).select(*keys, tag))
        .distinct()
    )
    return join_null_safe(groups, found, keys).withColumn(tag, F.coalesce(tag, F.lit(missing)))


def utm_conversion_report(
    impressions: DataFrame,
    conversions: DataFrame,
    pixels: ConversionPixels,
    empty_arrays: str = "null",
    space: Workspace | None = None,
) -> DataFrame:
    """``conversion_report`` per UTM medium and source; an impression counts in each pair.

    Impressions are summed per day, platform, household flag and the user and address whose tags
    they take, before any tag is joined: a tag meets sums, never single impressions. With a
    workspace the conversions and these sums are saved, so that both inputs are read once at any
    size, whatever the plan reuses.
    """
    conversions = _kept(space, conversions, "conversions")
    by = ["date_ts", "ad_platform", "is_household"]
    keys = ["tag_user", "tag_address"]
    none = F.lit(None).cast("int") if empty_arrays == "null" else F.lit(0)
    one = lambda flag: F.when(F.col(flag), 1).otherwise(none)
    rows = _mapping_flags(impressions, conversions, pixels).select(
        "date_ts",
        ad_platform(F.col("seat_name")).alias("ad_platform"),
        "is_household",
        F.when(F.col("by_user"), F.col("site_user_id")).alias("tag_user"),
        F.when(F.col("tries_address"), F.col("ip_address")).alias("tag_address"),
        F.when(F.col("br_is_impression"), 1).otherwise(0).cast("bigint").alias("imps"),
        F.try_divide("br_max_bid_net_usd", F.lit(1000)).alias("spend"),
        one("has_visit").alias("total_visits"),
        one("has_started").alias("total_started"),
        one("has_completed").alias("total_completed"),
        F.when(F.col("by_user"), 1).otherwise(0).alias("conversion_source_user_id"),
        F.when(F.col("by_household"), 1).otherwise(0).alias("conversion_source_hhip"),
    )
    measures = ["imps", "spend", *_TOTALS]
    summed = _kept(space, rows.groupBy(*by, *keys).agg(*[F.sum(m).alias(m) for m in measures]), "utm-sums")
    groups = _kept(space, summed.select(*keys).distinct(), "utm-groups")
    visits = conversions.filter(F.col("pixel_id") == pixels.visit)
    tagged = join_null_safe(summed, _tags(groups, visits, conversions, "utm_medium", "null"), keys, "inner")
    tagged = tagged.groupBy(*by, *keys, "utm_medium").agg(*[F.sum(m).alias(m) for m in measures])
    tagged = join_null_safe(tagged, _tags(groups, visits, conversions, "utm_source", "direct"), keys, "inner")
    report = tagged.groupBy(*by, "utm_medium", "utm_source").agg(*[F.sum(m).alias(m) for m in measures])
    chosen = report.select(*by, "utm_medium", "utm_source", "imps", *rates(("br_revenue", "cpm")), *_TOTALS)
    return chosen.orderBy("date_ts")


def site_conversion_utm_report(
    conversions: DataFrame, pixels: ConversionPixels, empty_arrays: str = "null"
) -> DataFrame:
    """Users converting per day and UTM pair, from the site's own events alone."""
    keys = ["date_ts", "ip_address", "site_user_id"]

    def reached(pixel_id: str) -> Column:
        hit = F.max(F.when(F.col("pixel_id") == pixel_id, F.lit(1)))
        return hit if empty_arrays == "null" else F.coalesce(hit, F.lit(0))

    visitors = conversions.groupBy(*keys).agg(
        reached(pixels.visit).alias("total_visits"),
        reached(pixels.started).alias("total_started"),
        reached(pixels.completed).alias("total_completed"),
    )
    for tag, missing in (("utm_medium", "null"), ("utm_source", "direct")):
        found = conversions.filter(F.col(tag).isNotNull()).select(*keys, tag).distinct()
        visitors = join_null_safe(visitors, found, keys).withColumn(tag, F.coalesce(tag, F.lit(missing)))
    measures = ["total_visits", "total_started", "total_completed"]
    report = visitors.groupBy("date_ts", "utm_medium", "utm_source").agg(*[F.sum(m).alias(m) for m in measures])
    return report.select("date_ts", "utm_medium", "utm_source", *measures).orderBy(F.col("date_ts").desc())


# --- by user id, then by device ------------------------------------------------------


def _device_key(prefix: str = "") -> Column:
    names = ("ip_address", "browser_name", "os_name", "os_version")
    return fingerprint(*[F.col(prefix + c) for c in names])


def match_user_then_device(seats: DataFrame, conversions: DataFrame, strict: bool = False) -> DataFrame:
    """Match by user id; what stays unmatched on both sides is matched by device.

    Returns the seat columns (``device_key`` and ``site_user_id`` among them) with the
    matched conversion and ``match_rows``, the number of equal matches the row stands for.
    Every seat without a user match also keeps one row without conversion; ``strict``
    keeps it only when the device match failed too.
    """
    conv = conversions.select(
        F.col("site_user_id").alias("conv_user_id"),
        "pixel_name",
        *[F.col(c).alias(f"conv_{c}") for c in _DEVICE_FIELDS],
    )
    details = ["pixel_name", *[f"conv_{c}" for c in _DEVICE_FIELDS]]
    by_user = conv.groupBy("conv_user_id", *details).agg(F.count(F.lit(1)).alias("user_rows"))
    by_user = by_user.withColumn("user_key", F.col("conv_user_id"))
    joined = left_join(seats, by_user, "site_user_id", "user_key")

    seen = keep_known(conv, "conv_user_id", seats, "site_user_id").select("conv_user_id").distinct()
    left_over = not_in(conv, "conv_user_id", seen, "conv_user_id").filter(F.col("pixel_name").isNotNull())
    by_device = (
        left_over.withColumn("conv_key", _device_key("conv_"))
        .filter(F.col("conv_key").isNotNull())
        .groupBy("conv_key", "conv_user_id", *details)
        .agg(F.count(F.lit(1)).alias("device_rows"))
        .select("conv_key", "device_rows", *[F.col(c).alias(f"dev_{c}") for c in ("conv_user_id", *details)])
    )

    # A seat with a user match is done; any other becomes a device attempt and a bare row.
    steps = F.when(F.col("pixel_name").isNotNull(), F.array(F.lit("user"))).otherwise(
        F.array(F.lit("device"), F.lit("bare"))
    )
    attempts = ("device", "bare") if strict else ("device",)
    stepped = joined.withColumn("step", F.explode(steps)).withColumn(
        "attempt_key", F.when(F.col("step").isin(*attempts), F.col("device_key"))
    )
    tried = left_join(stepped, by_device, "attempt_key", "conv_key")
    hit = F.col("device_rows").isNotNull()
    is_device = F.col("step") == "device"
    is_bare = F.col("step") == "bare"
    kept = tried.filter((is_device & hit) | (F.col("step") == "user") | (is_bare & (~hit if strict else F.lit(True))))
    by_device_or_user = {
        name: F.when(is_device, F.coalesce(F.col(f"dev_{name}"), F.col(name))).when(~is_bare, F.col(name))
        for name in ("conv_user_id", *details)
    }
    rows = F.coalesce(F.col("user_rows"), F.lit(1)) * F.when(is_device, F.col("device_rows")).otherwise(F.lit(1))
    return kept.select(
        *seats.columns, *[c.alias(name) for name, c in by_device_or_user.items()], rows.alias("match_rows")
    )


def device_match_sums(seats: DataFrame) -> DataFrame:
    """Seats summed per day, platform, arm, user and device."""
    labelled = label_seats(seats, neither="normal_workflow").withColumn("device_key", _device_key())
    return labelled.groupBy("date_ts", "ad_platform", "exp_type", "site_user_id", "device_key").agg(
        F.count_if("is_bid_request_sent").alias("sent"),
        F.count_if("br_is_impression").alias("won"),
        F.sum(F.try_divide("br_max_bid_net_usd", F.lit(1000))).alias("spent"),
        F.count(F.lit(1)).alias("seat_rows"),
    )


def device_match_report(
    summed: DataFrame, conversions: DataFrame, strict: bool = False, space: Workspace | None = None
) -> DataFrame:
    """Delivery and matched ids per day, platform, arm and pixel, best bid CPM first.

    ``summed`` comes from ``device_match_sums``; save it first, as it is read twice. Gives the sums
    that ``match_user_then_device`` would give, without its rows: seats are summed per user or device
    before they meet conversions counted per user, device and pixel, and a join gives weights and
    ids at once. With a workspace these sums are saved, and conversions are read once.
    """
    arm = ["date_ts", "ad_platform", "exp_type"]
    by = [*arm, "pixel_name"]
    five = fingerprint(*[F.col(c) for c in _DEVICE_FIELDS])
    conv = conversions.select(F.col("site_user_id").alias("user"), "pixel_name", five.alias("five"), _device_key().alias("key"))
    conv = conv.groupBy(*conv.columns).agg(F.count(F.lit(1)).alias("n"))
    conv = _kept(space, conv, "device-conversions")
    named = conv.filter(F.col("pixel_name").isNotNull())

    # A conversion without a pixel name matches its user but counts as no match.
    unnamed = conv.groupBy("user").agg(F.sum(F.when(F.col("pixel_name").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    seats = left_join(summed, unnamed, "site_user_id", "user").withColumn("lone", F.coalesce("unnamed", F.lit(1)))
    sums = ("sent", "won", "spent", "seat_rows")
    of_user = _kept(space, summed.groupBy(*arm, "site_user_id").agg(*[F.sum(c).alias(c) for c in sums]), "user-sums")
    alone = seats.filter("lone > 0").groupBy(*arm, "device_key")
    alone = _kept(space, alone.agg(*[F.sum(F.col(c) * F.col("lone")).alias(c) for c in sums]), "lone-device-sums")

    seen = keep_known(conv, "user", of_user, "site_user_id").select("user").distinct()
    left_over = not_in(named, "user", seen, "user").filter(F.col("key").isNotNull())
    left_over = _kept(space, left_over, "left-over-conversions")

    def matched(seat_sums: DataFrame, key: str, found: DataFrame, at: str) -> DataFrame:
        """Seat sums with each group of conversions they meet."""
        met = found.select(F.col(at).alias("at"), "pixel_name", "user", "five", "n")
        return seat_sums.join(met, F.col(key) == F.col("at")).select(*by, *sums, "user", "five", "n")

    every = matched(of_user, "site_user_id", named, "user").unionByName(matched(alone, "device_key", left_over, "key"))
    weight = lambda c: (F.col(c) * F.col("n")).alias(c)
    id_rows = lambda c: F.when(F.col(c).isNotNull(), F.col("seat_rows") * F.col("n"))
    weights = every.select(
        *by,
        weight("sent"),
        weight("won"),
        weight("spent"),
        id_rows("user").alias("total_user_id_count"),
        id_rows("five").alias("total_pwid_count"),
        "user",
        "five",
    )
    # Distinct ids are grouped first, so that no task holds the ids of a whole arm.
    distinct = weights.groupBy(*by, "user", "five").agg(
        *[F.sum(c).alias(c) for c in ("sent", "won", "spent", "total_user_id_count", "total_pwid_count")]
    )
    distinct = _kept(space, distinct, "device-matches")

    def ids(what: str, into: str) -> DataFrame:
        return distinct.select(*by, what).distinct().groupBy(*by).agg(F.count(what).alias(into))

    on_device = left_over.select(F.col("key").alias("at")).distinct()
    bare = drop_known(alone, "device_key", on_device, "at") if strict else alone
    bare = bare.select(
        *arm,
        F.lit(None).cast("string").alias("pixel_name"),
        F.col("sent").alias("bid_request_sent"),
        F.col("won").alias("imps"),
        F.col("spent").alias("spend"),
    )
    met = distinct.select(
        *by,
        F.col("sent").alias("bid_request_sent"),
        F.col("won").alias("imps"),
        F.col("spent").alias("spend"),
        "total_user_id_count",
        "total_pwid_count",
    )
    parts = [met, bare, ids("user", "distinct_user_id_count"), ids("five", "distinct_pwid_count")]
    every = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    counts = ("distinct_user_id_count", "total_user_id_count", "distinct_pwid_count", "total_pwid_count")
    totals = every.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("bid_request_sent", "imps", "spend")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
    )
    return totals.select(*by, "bid_request_sent", "imps", *rates(), *counts).orderBy(F.col("bcpmm").desc())
