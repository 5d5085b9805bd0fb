"""Bid log to seat and ad level, labels and delivery metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics import params
from adlytics.functions.arrays import first_field, max_field, true_if_any
from adlytics.functions.text import like_any
from adlytics.schemas import has_field

_REQUEST_FIELDS = (
    "request_id",
    "ip_address",
    "browser_name",
    "device_type",
    "device_name",
    "os_name",
    "os_version",
    "lookup_set",
)


def _request_columns(bids: DataFrame) -> list[Column]:
    """Request-level columns present in the input, so a pruned read works too."""
    found = [F.to_date("ts").alias("date_ts")]
    found += [F.col(c) for c in _REQUEST_FIELDS if c in bids.columns]
    if "site_user" in bids.columns:
        found.append(F.col("site_user.user_id").alias("site_user_id"))
    return found


def _ad_columns(ads: DataFrame) -> list[Column]:
    """Everything but the unnested ad, with the ad's id if it was read."""
    return [F.col(c) for c in ads.columns if c != "ad"] + _present(ads, ad_id=("ad.ad_id", lambda: F.col("ad.ad_id")))


def _present(rows: DataFrame, **columns: tuple[str, Callable[[], Column]]) -> list[Column]:
    """The columns whose field was read, so a pruned read needs no unused fields."""
    return [make().alias(name) for name, (path, make) in columns.items() if has_field(rows.schema, path)]


def in_experiment_arm(seat: Column, arm_type: str) -> Column:
    return true_if_any(
        seat["experiment"],
        lambda e: (e["name"] == params.EXPERIMENT_NAME) & (e["type"] == arm_type),
    )


def _max_impression_bid(bids: Column) -> Column:
    return max_field(bids, "bid_net_usd", lambda b: b["is_impression"])


def seat_level(
    bids: DataFrame,
    *,
    seat_patterns: tuple[str, ...] | None = params.PLATFORM_SEAT_PATTERNS,
    impressions_only: bool = False,
    creative_id: str | None = None,
) -> DataFrame:
    """One row per request, ad and matching seat.

    The seat tests run inside the arrays, before they are unnested, so a request without a
    matching seat never becomes a row. Without ``seat_patterns`` every seat is kept, and a
    request without ads or seats keeps one row.
    """

    def wanted(seat: Column) -> Column:
        test = like_any(seat["seat_name"], seat_patterns) if seat_patterns else F.lit(True)
        if impressions_only:
            test = test & max_field(seat["bid_request"], "is_impression").eqNullSafe(F.lit(True))
        if creative_id is not None:
            test = test & (max_field(seat["bid_request"], "bid_creative_id") == creative_id)
        return test

    filtered = seat_patterns is not None or impressions_only or creative_id is not None
    ads = bids.select(*_request_columns(bids), F.explode_outer("ad").alias("ad"))
    seats = F.filter("ad.seat", wanted) if filtered else F.col("ad.seat")
    # The outer form, with the empty rows dropped after it: before an inner explode Spark
    # would evaluate the whole array filter a second time just to test its size.
    rows = ads.select(*_ad_columns(ads), F.explode_outer(seats).alias("seat"))
    if filtered:
        rows = rows.filter(F.col("seat").isNotNull())
    made = F.col("seat.bid_request")
    return rows.select(
        *[c for c in rows.columns if c != "seat"],
        *_present(
            rows,
            seat_name=("seat.seat_name", lambda: F.col("seat.seat_name")),
            is_bid_request_sent=("seat.is_bid_request_sent", lambda: F.col("seat.is_bid_request_sent")),
            is_test_arm=("seat.experiment", lambda: in_experiment_arm(F.col("seat"), params.EXPERIMENT_TEST_TYPE)),
            is_control_arm=("seat.experiment", lambda: in_experiment_arm(F.col("seat"), params.EXPERIMENT_CONTROL_TYPE)),
            creative_id=("seat.bid_request.bid_creative_id", lambda: max_field(made, "bid_creative_id")),
            bid_user_id=("seat.bid_request.user_id", lambda: first_field(made, "user_id")),
            br_is_impression=("seat.bid_request.is_impression", lambda: max_field(made, "is_impression")),
            br_max_bid_net_usd=("seat.bid_request.bid_net_usd", lambda: _max_impression_bid(made)),
        ),
    )


def ad_level(bids: DataFrame) -> DataFrame:
    """One row per request and ad with its highest winning seat bid."""
    ads = bids.select(*_request_columns(bids), F.explode_outer("ad").alias("ad"))
    return ads.select(
        *_ad_columns(ads),
        F.col("ad.is_impression").alias("is_impression"),
        max_field(F.col("ad.seat"), "max_bid_net_usd", lambda s: s["is_impression"]).alias("max_bid_net_usd"),
    )


def ad_platform(seat_name: Column) -> Column:
    return F.when(seat_name.isin(*params.PLATFORM_SEATS), params.PLATFORM_LABEL).otherwise(params.OTHER_LABEL)


def experiment_arm(is_test: Column, is_control: Column, neither: str = "other") -> Column:
    """Arm label; ``neither`` is ``other``, ``normal_workflow`` or ``no_exp_bucket``."""
    return (
        F.when(is_test, params.ARM_TEST_LABEL).when(is_control, params.ARM_CONTROL_LABEL).otherwise(neither)
    )


def label_seats(seats: DataFrame, neither: str = "other") -> DataFrame:
    return seats.withColumns(
        {
            "ad_platform": ad_platform(F.col("seat_name")),
            "exp_type": experiment_arm(F.col("is_test_arm"), F.col("is_control_arm"), neither),
        }
    )


def count_flag(flag: Column, count_mode: str, weight: Column | None = None) -> Column:
    """Aggregate a flag: ``non_null`` counts TRUE and FALSE, ``true_only`` counts TRUE."""
    if count_mode == "non_null":
        counted = flag.isNotNull()
    elif count_mode == "true_only":
        counted = flag.eqNullSafe(F.lit(True))
    else:
        raise ValueError("count_mode must be 'non_null' or 'true_only'")
    if weight is None:
        return F.count_if(counted)
    return F.sum(F.when(counted, weight).otherwise(F.lit(0)))


def seat_totals(count_mode: str, weight: Column | None = None) -> list[Column]:
    """Partial sums from which ``rates`` computes every metric."""
    bid = F.try_divide(F.col("br_max_bid_net_usd"), F.lit(1000))
    return [
        count_flag(F.col("is_bid_request_sent"), count_mode, weight).alias("bid_request_sent"),
        count_flag(F.col("br_is_impression"), count_mode, weight).alias("imps"),
        F.sum(bid if weight is None else bid * weight).alias("spend"),
    ]


def rates(columns: Sequence[str] = ("br_revenue", "bcpmm", "fill_rate", "cpm")) -> list[Column]:
    """Rounded revenue and ratios over ``bid_request_sent``, ``imps`` and ``spend``."""
    spend = F.col("spend")
    sent = F.nullif(F.col("bid_request_sent"), F.lit(0)) if "bcpmm" in columns or "fill_rate" in columns else None
    imps = F.nullif(F.col("imps"), F.lit(0))
    built = {"br_revenue": lambda: F.round(spend, 0)}
    built["bcpmm"] = lambda: F.round(spend / sent * 1000000, 2)
    built["fill_rate"] = lambda: F.round(F.col("imps") / sent * 100, 2)
    built["cpm"] = lambda: F.round(spend / imps * 1000, 2)
    return [built[c]().alias(c) for c in columns]


def delivery_metrics(
    seats: DataFrame,
    by: Sequence[str],
    count_mode: str = "non_null",
    extra: Sequence[Column] = (),
    extra_names: Sequence[str] = (),
) -> DataFrame:
    """Requests sent, impressions, revenue, bid CPM, fill rate and CPM per group."""
    totals = seats.groupBy(*by).agg(*seat_totals(count_mode), *extra)
    return totals.select(*by, "bid_request_sent", "imps", *rates(), *extra_names)


def seat_delivery_report(bids: DataFrame, count_mode: str = "non_null") -> DataFrame:
    """Delivery metrics per day, platform and experiment arm, best bid CPM first."""
    labelled = label_seats(seat_level(bids))
    report = delivery_metrics(labelled, ["date_ts", "ad_platform", "exp_type"], count_mode)
    return report.orderBy(F.col("bcpmm").desc())


def _source_column(source: str) -> str:
    return f"id_source_{source.replace('-', '_')}"


def _bid_with_source(made: Column, source: str) -> Column:
    return true_if_any(made, lambda b: b["id_source_graph"] == source)


def id_source_flags(bids: DataFrame) -> DataFrame:
    """Per seat, which identifier sources its bids used; TRUE or NULL for each source."""
    request = _present(bids, request_id=("request_id", lambda: F.col("request_id")))
    ads = bids.select(F.to_date("ts").alias("date_ts"), *request, F.explode_outer("ad").alias("ad"))
    rows = ads.select(*_ad_columns(ads), F.explode_outer("ad.seat").alias("seat"))
    made = F.col("seat.bid_request")
    sources = {_source_column(source): _bid_with_source(made, source) for source in params.ID_SOURCES}
    sources["id_source_cookie"] = true_if_any(
        made, lambda b: b["id_source_graph"].isNull() & b["is_user_id"].eqNullSafe(F.lit(True))
    )
    won = F.col("seat.max_bid_net_usd").isNotNull() & F.col("seat.is_impression").eqNullSafe(F.lit(True))
    return rows.select(
        *[c for c in rows.columns if c != "seat"],
        F.col("seat.seat_name").alias("seat_name"),
        F.col("seat.is_bid_request_sent").alias("is_bid_request_sent"),
        max_field(made, "is_impression").alias("br_is_impression"),
        in_experiment_arm(F.col("seat"), params.EXPERIMENT_TEST_TYPE).alias("is_test_arm"),
        in_experiment_arm(F.col("seat"), params.EXPERIMENT_CONTROL_TYPE).alias("is_control_arm"),
        *[c.alias(name) for name, c in sources.items()],
        F.when(won, F.col("seat.max_bid_net_usd")).otherwise(F.lit(0.0)).alias("max_bid_net_usd"),
        _max_impression_bid(made).alias("br_max_bid_net_usd"),
    )


ID_SOURCE_COLUMNS = (*map(_source_column, params.ID_SOURCES), "id_source_cookie")


def id_source_report(bids: DataFrame) -> DataFrame:
    """Delivery per day, platform, arm and combination of identifier sources."""
    labelled = label_seats(id_source_flags(bids))
    by = ["date_ts", "ad_platform", "exp_type", *ID_SOURCE_COLUMNS]
    return delivery_metrics(
        labelled,
        by,
        extra=[F.round(F.sum(F.try_divide(F.col("max_bid_net_usd"), F.lit(1000))), 2).alias("seat_revenue")],
        extra_names=["seat_revenue"],
    )


def bid_creative_reach(bids: DataFrame, creative_id: str) -> DataFrame:
    """Delivery of one creative's impressions with the distinct ids bid on."""
    seats = seat_level(bids, impressions_only=True, creative_id=creative_id)
    return delivery_metrics(
        label_seats(seats, neither="no_exp_bucket"),
        ["date_ts", "creative_id", "ad_platform", "exp_type"],
        extra=[F.count_distinct("bid_user_id").alias("unique_bid_user_id")],
        extra_names=["unique_bid_user_id"],
    )
