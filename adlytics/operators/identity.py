"""Resolving a person id (PWID) for each seat: cached household, request household, user id."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlytics import params
from adlytics.functions.arrays import first_field
from adlytics.functions.ip import household_address
from adlytics.operators.delivery import label_seats, rates, seat_level, seat_totals
from adlytics.operators.household import flag_household
from adlytics.operators.joins import join_null_safe, left_join, spread_null_key
from adlytics.params import Period

CACHED = "cached_hhip"
REQUEST = "request_hhip"
NONE_FOUND = "no_hhip_found"

# Identifier kinds taken from the request's id list, login ids being looked up hashed.
REQUEST_ID_TYPES = ("login-id", "anonymous-id", "maid", "pubcid")

SEAT_OUTPUT = (
    "date_ts",
    "request_id",
    "ad_id",
    "seat_name",
    "is_bid_request_sent",
    "is_test_arm",
    "is_control_arm",
    "br_is_impression",
    "br_max_bid_net_usd",
)


def cached_households(tables: Mapping[str, DataFrame], days: Period) -> DataFrame:
    """Household ids cached under any identifier: (mapping_key, household_id, cached_rows).

    Equal rows of the lookup tables are summed into ``cached_rows``.
    """

    def entries(table: DataFrame) -> DataFrame:
        return (
            table.filter(days.covers_date(F.col("date")))
            .select("mapping_key", F.explode("user_ad_platform_ids").alias("entry"))
            .filter(F.col("entry.ad_platform") == params.HOUSEHOLD_PLATFORM)
            .select("mapping_key", F.col("entry.user_ad_platform_id").alias("household_id"))
        )

    union = reduce(DataFrame.unionByName, [entries(t) for t in tables.values()])
    return (
        union.filter(F.col("mapping_key").isNotNull())
        .groupBy("mapping_key", "household_id")
        .agg(F.count(F.lit(1)).alias("cached_rows"))
    )


def lookup_keys() -> Column:
    """The distinct identifiers a request can be looked up by; NULL when it has none."""

    def of_type(id_type: str) -> Column:
        return first_field(F.col("user_ids"), "user_id", lambda e: e["id_type"] == id_type)

    found = {t: of_type(t) for t in REQUEST_ID_TYPES}
    found["login-id"] = F.md5(found["login-id"])
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array(*found.values(), F.col("site_user.user_id")))))
    return F.when(F.array_size(keys) > 0, keys)


def _key_sets(rows: DataFrame, lookup_key: str) -> DataFrame:
    """The distinct key sets with one row per key."""
    sets = rows.filter(F.col("lookup_set").isNotNull()).select("lookup_set").distinct()
    return sets.select(F.col("lookup_set").alias("known_set"), F.explode("lookup_set").alias(lookup_key))


def _join_sets(rows: DataFrame, per_set: DataFrame) -> DataFrame:
    """Left join on the key set itself; the many rows without one do not meet in one task."""
    lone = spread_null_key(F.lit(None).cast("string"), [F.col(c) for c in rows.columns])
    keyed = rows.withColumn("_set", F.coalesce("lookup_set", F.array(lone)))
    test = (F.col("_set") == F.col("known_set")) & F.col("lookup_set").isNotNull()
    return keyed.join(per_set, test, "left").drop("_set", "known_set")


def match_any_key(rows: DataFrame, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Left join in which a lookup row matches when its key is any of ``lookup_set``.

    The OR of key equalities becomes one equi-join: a lookup row has one key and a row's
    keys are distinct, so each pair is found once. Only the distinct key sets are
    unfolded, not the rows, and the rows are shuffled once.
    """
    found = _key_sets(rows, lookup_key).join(lookup, lookup_key).drop(lookup_key)
    return _join_sets(rows, found)


def count_any_key(rows: DataFrame, lookup: DataFrame, lookup_key: str, weight: str, into: str) -> DataFrame:
    """Rows with the summed weight of the lookup rows ``match_any_key`` would give, or NULL."""
    per_key = lookup.groupBy(lookup_key).agg(F.sum(weight).alias(into))
    per_set = _key_sets(rows, lookup_key).join(per_key, lookup_key).groupBy("known_set").agg(F.sum(into).alias(into))
    return _join_sets(rows, per_set)


def person_seats(bids: DataFrame, impressions_only: bool = False) -> DataFrame:
    """Platform seats with household-form addresses and the keys to look them up by.

    Both are worked out per request, before its seats are unnested.
    """
    requests = bids.withColumns(
        {"lookup_set": lookup_keys(), "ip_address": household_address(F.col("ip_address"))}
    )
    return seat_level(requests, impressions_only=impressions_only).select(
        *SEAT_OUTPUT, "site_user_id", "ip_address", "device_name", "os_name", "browser_name", "lookup_set"
    )


def place_seats(seats: DataFrame, cached: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Seats with what is known about them and their request, one row each.

    Adds ``matches``, the cached rows found (NULL for none), ``is_household``, and the
    same for the whole request: ``request_cached`` and ``request_listed``. ``seats`` comes
    from ``person_seats``; save it first, as it is read more than once.

    All four are facts about the narrow distinct rows of request, key set, day and address:
    they are looked up there, summed up per request, and joined to the seats once.
    """
    facts = ("request_id", "lookup_set", "date_ts", "ip_address")
    narrow = seats.select(*facts).distinct()
    tried = flag_household(count_any_key(narrow, cached, "mapping_key", "cached_rows", "matches"), prefixes)
    within = Window.partitionBy(spread_null_key(F.col("request_id"), [F.col(c) for c in facts]))
    whole = tried.withColumns(
        {
            "request_cached": F.max(F.col("matches").isNotNull()).over(within),
            "request_listed": F.max("is_household").over(within),
        }
    )
    known = F.col("request_id").isNotNull()
    whole = whole.withColumns({c: F.when(known, F.col(c)) for c in ("request_cached", "request_listed")})
    return join_null_safe(seats.drop(*[c for c in whole.columns if c not in facts]), whole, facts)


def _person(first: str, *rest: str) -> Column:
    return F.concat(F.col(first), *[F.col(c) for c in rest])


_CACHED_PERSON = ("household_id", "device_name", "os_name", "browser_name")
_ADDRESS_PERSON = ("ip_address", "os_name", "device_name", "browser_name")


def _own_people(placed: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Seats resolved without the cache: by address, and by user id."""

    def output(rows: DataFrame, source: str, person: Column) -> DataFrame:
        return rows.select(F.lit(source).alias("ip_source"), person.alias("premium_web_id"), *SEAT_OUTPUT)

    # A missing request id passes no NOT IN, but has no match in an outer join either.
    missing = {"exclusive": False, "distinct_fallback": True}
    if mode not in missing:
        raise ValueError("mode must be 'exclusive' or 'distinct_fallback'")
    free = placed.filter(F.col("matches").isNull() & F.coalesce(~F.col("request_cached"), F.lit(missing[mode])))
    by_address = output(free.filter("is_household"), REQUEST, _person(*_ADDRESS_PERSON))
    if mode == "exclusive":
        by_user = output(free.filter(~F.col("request_listed")), NONE_FOUND, F.col("site_user_id"))
        return by_address.distinct(), by_user
    return by_address, output(placed, NONE_FOUND, F.col("site_user_id")).distinct()


def resolve_person(placed: DataFrame, cached: DataFrame, mode: str = "exclusive") -> DataFrame:
    """Person id per seat with its source and ``match_rows``, the equal rows it stands for.

    ``placed`` comes from ``place_seats``; save it first. Modes:

    ``exclusive``
        A request found in the cache is not tried by address, and one found by either is
        not given its user id. Rows found by address are distinct.
    ``distinct_fallback``
        As above, but every distinct seat also gets a user-id row, found or not.

    A seat is repeated for each household cached under its keys; ``reach_report`` does
    without these rows.
    """
    by_address, by_user = _own_people(placed, mode)
    found = match_any_key(placed.filter(F.col("matches").isNotNull()), cached, "mapping_key")
    from_cache = found.select(
        F.lit(CACHED).alias("ip_source"),
        _person(*_CACHED_PERSON).alias("premium_web_id"),
        *SEAT_OUTPUT,
        F.col("cached_rows").alias("match_rows"),
    )
    own = by_address.unionByName(by_user).withColumn("match_rows", F.lit(1).cast("bigint"))
    return from_cache.unionByName(own)


def resolve_person_cascade(seats: DataFrame, cached: DataFrame, prefix_rows: DataFrame) -> DataFrame:
    """Person id row by row: cached household, else the address, else the user id.

    The address is taken whenever all its parts are known, listed or not; rows of a listed
    address are repeated by its ``prefix_rows`` (from ``household_prefix_rows``).
    """
    tried = match_any_key(seats, cached, "mapping_key")
    listed = prefix_rows.select(
        F.concat(F.col("date_h").cast("string"), F.lit(" "), F.col("ip_address_prefix")).alias("prefix_key"),
        "prefix_rows",
    )
    keyed = tried.withColumn(
        "address_key", F.concat(F.col("date_ts").cast("string"), F.lit(" "), F.col("ip_address"))
    )
    rows = left_join(keyed, listed, "address_key", "prefix_key")
    cached_person, address_person = _person(*_CACHED_PERSON), _person(*_ADDRESS_PERSON)
    found_cached = cached_person.isNotNull()
    matches = F.coalesce(F.col("cached_rows"), F.lit(1))
    return rows.select(
        F.when(found_cached, CACHED).when(address_person.isNotNull(), REQUEST).otherwise(NONE_FOUND).alias("ip_source"),
        F.coalesce(cached_person, address_person, F.col("site_user_id")).alias("premium_web_id"),
        *SEAT_OUTPUT,
        F.when(found_cached, matches)
        .otherwise(matches * F.coalesce(F.col("prefix_rows"), F.lit(1)))
        .alias("match_rows"),
    )


_REACH = ("date_ts", "ad_platform", "exp_type")
_REACH_SUMS = ("bid_request_sent", "imps", "spend")


def reach(people: DataFrame) -> DataFrame:
    """Delivery metrics and distinct persons per day, platform and arm."""
    totals = (
        label_seats(people, neither="no_exp_bucket")
        .groupBy(*_REACH)
        .agg(
            *seat_totals("non_null", F.col("match_rows")), F.count_distinct("premium_web_id").alias("unique_pwid")
        )
    )
    return totals.select(*_REACH, "bid_request_sent", "imps", *rates(), "unique_pwid")


def reach_report(placed: DataFrame, cached: DataFrame, mode: str = "exclusive") -> DataFrame:
    """``reach`` of the resolved persons without a row per seat and cached household.

    Metrics of cached seats are multiplied by their number of matches. Households are
    looked up for distinct groups, devices and keys only, which an identifier shared by
    many seats does not multiply.
    """
    by_address, by_user = _own_people(placed, mode)
    in_cache = label_seats(placed.filter(F.col("matches").isNotNull()), neither="no_exp_bucket")
    own = [label_seats(rows, neither="no_exp_bucket") for rows in (by_address, by_user)]
    sums = [in_cache.groupBy(*_REACH).agg(*seat_totals("non_null", F.col("matches")))]
    sums += [rows.groupBy(*_REACH).agg(*seat_totals("non_null")) for rows in own]

    devices = in_cache.select(*_REACH, *_CACHED_PERSON[1:], F.explode("lookup_set").alias("mapping_key")).distinct()
    persons = [devices.join(cached, "mapping_key").select(*_REACH, _person(*_CACHED_PERSON).alias("premium_web_id"))]
    persons += [rows.select(*_REACH, "premium_web_id") for rows in own]
    distinct = reduce(DataFrame.unionByName, persons).groupBy(*_REACH).agg(
        F.count_distinct("premium_web_id").alias("unique_pwid")
    )
    parts = [*sums, distinct]
    every = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    totals = every.groupBy(*_REACH).agg(*[F.sum(c).alias(c) for c in (*_REACH_SUMS, "unique_pwid")])
    return totals.select(*_REACH, "bid_request_sent", "imps", *rates(), "unique_pwid")
