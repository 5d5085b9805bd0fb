"""Explicit schemas of the input tables.

Reading with a schema cut down by ``prune`` keeps unused nested fields out of the scan
even where they sit inside arrays handled by higher-order functions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T


_PLATFORM_IDS = "array<struct<ad_platform: string, user_ad_platform_id: string>>"

DDL = {
    "bidstream": """
        ts timestamp, request_id string, ip_address string, user_country string,
        browser_name string, device_type string, device_name string, os_name string,
        os_version string, site_user struct<user_id: string>,
        user_ids array<struct<id_type: string, user_id: string>>,
        ad array<struct<ad_id: string, is_impression: boolean,
          seat: array<struct<seat_name: string, is_bid_request_sent: boolean,
            is_impression: boolean, max_bid_net_usd: double,
            experiment: array<struct<name: string, type: string>>,
            bid_request: array<struct<is_impression: boolean, bid_net_usd: double,
              bid_creative_id: string, user_id: string, id_source_graph: string,
              is_user_id: boolean>>>>>>""",
    "site_events": """
        ts timestamp, ip_address string, site_user_id string, page_url string,
        pixel_id string, pixel_name string, internal_advertiser_id string,
        browser_name string, device_type string, os_name string, os_version string""",
    "site_sessions": """
        date date, user_pwid_raw string, ip_address string, is_household boolean,
        site_user_id string, browser_name string, device_type string, os_name string,
        site_pages array<struct<ts: timestamp, pixel_type: string, pixel_id: string,
          pixel_name: string, internal_advertiser_id: string, advertiser_domain: string,
          var1: string, var2: string>>""",
    "pages": """
        pages_primary_key string, ts timestamp, ip_address string, app_region string,
        ad_id string, advertiser_domain string,
        site_user struct<user_pwid_raw: string, user_id: string>, browser_name string,
        device_type string, os_name string, bid_net_usd double, bid_gross_usd double,
        seat_name string,
        impression array<struct<request_id: string, bid_creative_id: string, ts: timestamp>>""",
    "win_log": """
        bid_time_utc timestamp, exchange_imp_id string, exchange_auction_id string,
        advertiser_id bigint, campaign_id string, campaign_alt_id string,
        creative_id string, line_item_alt_id string, clicks bigint,
        in_view_time_millis bigint""",
    "line_items": """
        line_item_id string, io_number string, product string, record_type string,
        start_date date, end_date date, metric string, opportunity_name string,
        account_id string, account_name string, industry string, agency string,
        customer_group string""",
    "attention": """
        date date, imp_id string, dv_net_80_viewable_imp bigint,
        dv_net_100_viewable_imp bigint, dv_net_iab_viewable_imp bigint,
        dv_ad_mouse_hover_imp bigint""",
    "ip_prefix": "date date, app_region string, ip_address_prefix string, is_household boolean",
    "ip_prefix_mapping": f"""
        date date, ip_address_prefix string, app_region string, order_tier bigint,
        user_ad_platform_ids {_PLATFORM_IDS}""",
    "id_mapping": f"date date, mapping_key string, user_ad_platform_ids {_PLATFORM_IDS}",
    "audience": "ts timestamp, id_type string, partner_id string",
}


# Nested fields of the bid log each operator reads, for ``read_table``.
_SEAT = "ad.seat."
_ARMS = (_SEAT + "experiment.name", _SEAT + "experiment.type")
_METRICS = (
    _SEAT + "seat_name",
    _SEAT + "is_bid_request_sent",
    _SEAT + "bid_request.is_impression",
    _SEAT + "bid_request.bid_net_usd",
)
_CREATIVE = (_SEAT + "bid_request.bid_creative_id",)
_DEVICE = ("ip_address", "browser_name", "device_type", "os_name", "os_version")
_IDS = ("site_user.user_id", "user_ids.id_type", "user_ids.user_id")
BID_FIELDS = {
    "seat_delivery_report": ("ts", *_METRICS, *_ARMS),
    "bid_creative_reach": ("ts", "user_country", *_METRICS, *_ARMS, *_CREATIVE, _SEAT + "bid_request.user_id"),
    "id_source_report": (
        "ts",
        *_METRICS,
        *_ARMS,
        _SEAT + "is_impression",
        _SEAT + "max_bid_net_usd",
        _SEAT + "bid_request.id_source_graph",
        _SEAT + "bid_request.is_user_id",
    ),
    "device_match": ("ts", "site_user.user_id", *_DEVICE, *_METRICS, *_ARMS),
    "map_conversions": ("ts", "request_id", "user_country", "ip_address", "site_user.user_id", *_METRICS, *_CREATIVE),
    "person_seats": (
        "ts",
        "request_id",
        "user_country",
        "ip_address",
        "browser_name",
        "device_name",
        "os_name",
        *_IDS,
        "ad.ad_id",
        *_METRICS,
        *_ARMS,
    ),
    "ad_level": (
        "ts",
        "request_id",
        "user_country",
        "ip_address",
        "site_user.user_id",
        "ad.ad_id",
        "ad.is_impression",
        _SEAT + "is_impression",
        _SEAT + "max_bid_net_usd",
    ),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def has_field(full: T.StructType, path: str) -> bool:
    """Whether a dotted path exists, looking through array levels."""
    at: T.DataType = full
    for name in path.split("."):
        while isinstance(at, T.ArrayType):
            at = at.elementType
        if not isinstance(at, T.StructType) or name not in at.names:
            return False
        at = at[name].dataType
    return True


def prune(full: T.StructType, paths: Iterable[str]) -> T.StructType:
    """Keep only the dotted field paths; array levels need no mark of their own."""
    wanted: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        wanted.setdefault(head, [])
        if rest:
            wanted[head].append(rest)
    unknown = set(wanted) - set(full.names)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return T.StructType(
        [
            T.StructField(f.name, _prune_type(f.dataType, wanted[f.name]), f.nullable)
            for f in full.fields
            if f.name in wanted
        ]
    )


def _prune_type(data_type: T.DataType, paths: list[str]) -> T.DataType:
    if not paths:
        return data_type
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_prune_type(data_type.elementType, paths), data_type.containsNull)
    assert isinstance(data_type, T.StructType)
    return prune(data_type, paths)
