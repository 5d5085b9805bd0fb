"""Advertising tables derived from general order, event, customer and part tables.

Used to run the operators on the supplied star-schema data: every row of the source table
gives its rows by plain column arithmetic. Days run over January 2024.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adlytics.params import ConversionPixels, Period, Window
from adlytics.sources.tables import scan, scan_days

AS_OF = date(2024, 1, 31)
MONTH = Period(date(2024, 1, 1), date(2024, 1, 30))
LOOKUP_DAY = Period(date(2024, 1, 30), date(2024, 1, 30))
PIXELS = ConversionPixels(advertiser_id="77", visit="501", started="502", completed="503")
CREATIVE = "cr-15003"
CREATIVE_CHARACTERS = "cr-"
COUNTRY = "United Kingdom"

# 1.953125 is 1000/512: a thousandth of any sum of bids is exact in binary.
BID_UNIT = 1.953125


def _person(n: str) -> dict[str, str]:
    """Address and device of person number ``n``."""
    return {
        "ip_address": f"""CASE WHEN {n} % 97 < 90 THEN concat('10.0.', {n} % 97, '.0')
            WHEN {n} % 97 < 96 THEN concat('2001:db8:0:', lower(hex({n} % 97)), ':1:2:3:', lower(hex({n} % 256)))
            ELSE 'unknown' END""",
        "browser_name": f"""CASE WHEN {n} % 19 = 7 THEN NULL
            ELSE element_at(array('Chrome', 'Mobile Safari', 'Samsung Internet', 'Opera'), 1 + CAST({n} % 4 AS INT)) END""",
        "device_type": f"element_at(array('mobile', 'desktop', 'tablet'), 1 + CAST({n} % 3 AS INT))",
        "device_name": f"CASE WHEN {n} % 23 <> 5 THEN concat('dev', {n} % 8) END",
        "os_name": f"element_at(array('iOS', 'Android'), 1 + CAST({n} % 2 AS INT))",
        "os_version": f"CASE WHEN {n} % 17 <> 3 THEN concat('v', {n} % 7) END",
    }


# Orders are spread over the 30 days.
_ORDER_TS = "timestamp_seconds(1704067200 + (o_orderkey * 7919) % 2592000)"


@dataclass(frozen=True)
class Derived:
    """The derived tables of one data folder."""

    spark: SparkSession
    folder: str

    def _source(self, name: str) -> DataFrame:
        """A source table, its few plain columns dealt over the session's shuffle partitions.

        Whole nested logs are derived from each narrow row, so the work is spread before, whatever
        the size of the file.
        """
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet").repartition(spread)

    def scan(self, table: str, when: Period | Window, ts: str = "ts", country: str | None = None) -> DataFrame:
        return scan(getattr(self, table)(), when, ts, country)

    def scan_days(self, table: str, when: Period | Window, column: str = "date") -> DataFrame:
        return scan_days(getattr(self, table)(), when, column)

    def bidstream(self) -> DataFrame:
        """One request per order with up to two ads, three seats each, two bids each."""
        person = _person("o_custkey")
        bid = f"""named_struct(
            'is_impression', CASE WHEN (k + j + b) % 5 = 4 THEN NULL ELSE (k + i + j + b) % 3 = 0 END,
            'bid_net_usd', CASE WHEN (k + b) % 9 = 8 THEN NULL ELSE (1 + (k * 13 + i * 7 + j * 5 + b) % 480) * {BID_UNIT}D END,
            'bid_creative_id', concat('cr-', 15000 + k % 5),
            'user_id', CASE WHEN k % 8 <> 5 THEN concat('b', c % 50 + b) END,
            'id_source_graph', element_at(array('anonymous-id', 'hhip', 'login-id', 'maid', 'pubcid', CAST(NULL AS STRING)), 1 + CAST((k + j + b) % 6 AS INT)),
            'is_user_id', CASE WHEN (k + b) % 4 = 0 THEN NULL ELSE (k + j) % 2 = 0 END)"""
        seat = f"""named_struct(
            'seat_name', element_at(array('beeswax', 'ozbeeswax', 'ozbwompv', 'beeswaxtest', 'rubicon', 'ozbwomp'), 1 + CAST((k + 2 * i + j) % 6 AS INT)),
            'is_bid_request_sent', CASE (k + j) % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END,
            'is_impression', CASE WHEN (k + i) % 8 = 7 THEN NULL ELSE (k + i + j) % 4 = 0 END,
            'max_bid_net_usd', CASE WHEN (k + j) % 13 <> 0 THEN (1 + (k * 3 + i + j) % 480) * {BID_UNIT}D END,
            'experiment', CASE WHEN k % 10 = 9 THEN NULL
                WHEN k % 3 = 0 THEN array(named_struct('name', 'b_id', 'type', 'd_ig'))
                WHEN k % 3 = 1 THEN array(named_struct('name', 'b_id', 'type', 'ctr'), named_struct('name', 'x', 'type', 'd_ig'))
                ELSE array(named_struct('name', 'x', 'type', 'ctr')) END,
            'bid_request', CASE WHEN (k + j) % 31 <> 0 THEN
                transform(slice(array(1, 2), 1, CAST((k + i + j) % 3 AS INT)), b -> {bid}) END)"""
        ad = f"""named_struct(
            'ad_id', concat('a', k, '-', i),
            'is_impression', CASE WHEN (k + i) % 6 = 5 THEN NULL ELSE (k + i) % 3 = 0 END,
            'seat', CASE WHEN (k + i) % 37 <> 0 THEN
                transform(sequence(1, 1 + CAST((k + i) % 3 AS INT)), j -> {seat}) END)"""
        return (
            self._source("orders")
            .selectExpr("o_orderkey", "o_custkey", "o_orderkey AS k", "o_custkey AS c")
            .selectExpr(
                f"{_ORDER_TS} AS ts",
                "concat('r', k) AS request_id",
                "CASE WHEN k % 5 = 0 THEN 'France' ELSE 'United Kingdom' END AS user_country",
                *[f"{e} AS {n}" for n, e in person.items()],
                "named_struct('user_id', CASE WHEN k % 11 <> 0 THEN concat('u', c) END) AS site_user",
                """CASE c % 5
                    WHEN 0 THEN array(named_struct('id_type', 'login-id', 'user_id', concat('lg', c)), named_struct('id_type', 'pubcid', 'user_id', concat('u', c)))
                    WHEN 1 THEN array(named_struct('id_type', 'anonymous-id', 'user_id', concat('an', c)))
                    WHEN 2 THEN array(named_struct('id_type', 'maid', 'user_id', concat('md', c)), named_struct('id_type', 'maid', 'user_id', 'second'))
                    WHEN 3 THEN array(named_struct('id_type', 'pubcid', 'user_id', concat('pb', c)), named_struct('id_type', 'anonymous-id', 'user_id', concat('an', c)))
                    END AS user_ids""",
                f"""CASE k % 41 WHEN 0 THEN NULL ELSE
                    transform(slice(array(1, 2), 1, CASE WHEN k % 41 = 1 THEN 0 ELSE 1 + CAST(k % 2 AS INT) END), i -> {ad}) END AS ad""",
            )
        )

    def _events(self) -> DataFrame:
        return self._source("events").selectExpr(
            "event_id AS e",
            "CAST(ts AS TIMESTAMP) AS ts",
            "user_id AS u",
            "event_type",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n",
        )

    def site_events(self) -> DataFrame:
        """One pixel event per event: three of them belong to the advertiser's funnel."""
        person = _person("u")
        return self._events().selectExpr(
            "ts",
            *[f"{e} AS {n}" for n, e in person.items() if n != "device_name"],
            # Some conversions come under an id no request carries.
            "CASE WHEN e % 11 <> 0 THEN concat(CASE WHEN e % 7 = 3 THEN 'v' ELSE 'u' END, u) END AS site_user_id",
            """concat('https://shop.example/p?x=', e, CASE n % 4
                WHEN 1 THEN concat('&utm_medium=', element_at(array('email', 'cpc', 'social'), 1 + CAST(n % 3 AS INT)), '&utm_source=', element_at(array('news', 'search'), 1 + CAST(n % 2 AS INT)))
                WHEN 2 THEN '&utm_medium=cpc&y=1'
                WHEN 3 THEN concat('&utm_medium=&utm_source=s', n % 5)
                ELSE '' END) AS page_url""",
            """CASE event_type WHEN 'error' THEN '501' WHEN 'signup' THEN '502' WHEN 'purchase' THEN '503'
                ELSE '900' END AS pixel_id""",
            "CASE WHEN e % 53 <> 0 THEN concat('px-', event_type) END AS pixel_name",
            "CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN '77' ELSE '78' END AS internal_advertiser_id",
        )

    def site_sessions(self) -> DataFrame:
        """One session per event with one conversion or tracker pixel and one page view."""
        person = _person("u")
        domain = "concat('https://www.shop', e % 6, '.example/')"
        return self._events().selectExpr(
            "to_date(ts) AS date",
            "CASE WHEN e % 11 <> 0 THEN concat('p', u) END AS user_pwid_raw",
            "u % 97 < 60 AS is_household",
            "concat('u', u) AS site_user_id",
            *[f"{e} AS {n}" for n, e in person.items() if n in ("ip_address", "browser_name", "device_type", "os_name")],
            f"""array(
                named_struct('ts', ts,
                    'pixel_type', CASE WHEN event_type IN ('view', 'click') THEN 'tracker' ELSE 'conversion' END,
                    'pixel_id', CASE event_type WHEN 'error' THEN '501' WHEN 'signup' THEN '502' WHEN 'purchase' THEN '503' ELSE '900' END,
                    'pixel_name', CASE event_type WHEN 'click' THEN 'clickTrackingReporter-adClicked'
                        WHEN 'view' THEN 'clickTrackingReporter-activeHover' ELSE concat('px-', event_type) END,
                    'internal_advertiser_id', CASE WHEN e % 7 = 0 THEN 'none' ELSE CAST(70 + e % 4 AS STRING) END,
                    'advertiser_domain', {domain},
                    'var1', CASE WHEN e % 13 = 0 THEN concat('r', e) ELSE concat('r', e, '|a', e) END,
                    'var2', concat('x|y|z|cr-', 15000 + CAST(floor(e / 16) AS BIGINT) % 5)),
                named_struct('ts', ts, 'pixel_type', 'page', 'pixel_id', '1', 'pixel_name', 'page',
                    'internal_advertiser_id', '70', 'advertiser_domain', {domain},
                    'var1', CAST(NULL AS STRING), 'var2', CAST(NULL AS STRING))) AS site_pages""",
        )

    def _shown(self) -> DataFrame:
        """Orders as shown ads: every 16th shares its ad id with the one before."""
        return self._source("orders").selectExpr(
            "o_orderkey",
            "o_orderkey AS k",
            "o_custkey AS c",
            f"{_ORDER_TS} AS ts",
            "concat('a', CASE WHEN o_orderkey % 16 = 1 THEN o_orderkey - 1 ELSE o_orderkey END) AS ad_id",
            "15000 + CAST(floor(o_orderkey / 16) AS BIGINT) % 5 AS creative",
        )

    def pages(self) -> DataFrame:
        person = _person("c")
        return self._shown().selectExpr(
            "concat('pg', k) AS pages_primary_key",
            "ts",
            "CASE WHEN k % 4 = 3 THEN 'us' ELSE 'eu' END AS app_region",
            "ad_id",
            "CASE WHEN k % 29 <> 0 THEN concat('shop', k % 6, '.example') END AS advertiser_domain",
            "named_struct('user_pwid_raw', CASE WHEN k % 11 <> 0 THEN concat('p', c) END, 'user_id', concat('u', c)) AS site_user",
            *[f"{e} AS {n}" for n, e in person.items() if n in ("ip_address", "browser_name", "device_type", "os_name")],
            f"(1 + k % 480) * {BID_UNIT}D AS bid_net_usd",
            f"(1 + k % 480) * {BID_UNIT}D * 2 AS bid_gross_usd",
            "CASE WHEN k % 4 = 2 THEN 'rubicon' ELSE 'ozbeeswax' END AS seat_name",
            """transform(slice(array(1, 2), 1, 1 + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END), i -> named_struct(
                'request_id', concat('r', k, '-', i), 'bid_creative_id', concat('cr-', creative), 'ts', ts)) AS impression""",
        )

    def win_log(self) -> DataFrame:
        return self._shown().selectExpr(
            "ts AS bid_time_utc",
            "ad_id AS exchange_imp_id",
            "concat('r', k) AS exchange_auction_id",
            "70 + k % 4 AS advertiser_id",
            "concat('c', c % 6) AS campaign_id",
            "concat('alt', c % 6) AS campaign_alt_id",
            "CAST(creative AS STRING) AS creative_id",
            "concat('L', (c * 7) % 2500) AS line_item_alt_id",
            "k % 3 AS clicks",
            "k % 5 AS in_view_time_millis",
        )

    def attention(self) -> DataFrame:
        """Viewability of orders' ads, known under three times the order number."""
        return self._source("orders").selectExpr(
            f"to_date({_ORDER_TS.replace('o_orderkey', '(o_orderkey * 3)')}) AS date",
            "concat('a', o_orderkey * 3) AS imp_id",
            "o_orderkey % 2 AS dv_net_80_viewable_imp",
            "o_orderkey % 3 AS dv_net_100_viewable_imp",
            "o_orderkey % 4 AS dv_net_iab_viewable_imp",
            "o_orderkey % 5 AS dv_ad_mouse_hover_imp",
        )

    def line_items(self) -> DataFrame:
        return self._source("part").selectExpr(
            "concat('L', p_partkey) AS line_item_id",
            "concat('IO', p_partkey % 50) AS io_number",
            "p_type AS product",
            "p_brand AS record_type",
            "date_add(DATE'2024-01-01', CAST(p_size AS INT)) AS start_date",
            "date_add(DATE'2024-03-01', CAST(p_size AS INT)) AS end_date",
            "'CPM' AS metric",
            "concat('opp', p_partkey % 20) AS opportunity_name",
            "concat('acc', p_partkey % 10) AS account_id",
            "p_name AS account_name",
            "CASE WHEN p_partkey % 3 <> 0 THEN 'retail' END AS industry",
            "concat('ag', p_partkey % 4) AS agency",
            "concat('cg', p_partkey % 2) AS customer_group",
        )

    def ip_prefix_mapping(self) -> DataFrame:
        """Addresses seen per day in events; IPv6 addresses as /64 networks."""
        seen = self._events().selectExpr("to_date(ts) AS date", "u % 97 AS h").distinct()
        return seen.selectExpr(
            "date",
            """CASE WHEN h < 90 THEN concat('10.0.', h, '.0')
                ELSE concat('2001:db8:0:', lower(hex(h)), '::') END AS ip_address_prefix""",
            "CASE WHEN h % 4 = 3 THEN 'us' ELSE 'eu' END AS app_region",
            "CASE WHEN h >= 90 THEN 1000000 ELSE h * 1000000 END AS order_tier",
            """CASE WHEN h % 3 <> 0 THEN array(named_struct('ad_platform', 'hhip', 'user_ad_platform_id', concat('hh', h)),
                named_struct('ad_platform', 'x', 'user_ad_platform_id', concat('x', h))) END AS user_ad_platform_ids""",
        )

    def ip_prefix(self) -> DataFrame:
        return self.ip_prefix_mapping().selectExpr(
            "date", "app_region", "ip_address_prefix", "order_tier < 30000000 AS is_household"
        )

    def id_mapping(self) -> dict[str, DataFrame]:
        """Every customer under each kind of identifier; a household is known for some."""
        customers = self._source("customer").selectExpr("c_custkey AS c")

        def table(key: str, known: str, times: int = 1) -> DataFrame:
            household = f"""named_struct('ad_platform', CASE WHEN {known} THEN 'hhip' ELSE 'y' END,
                'user_ad_platform_id', CASE WHEN c % 31 <> 0 THEN concat('hh', c % 40) END)"""
            other = "named_struct('ad_platform', 'x', 'user_ad_platform_id', 'x')"
            entries = ", ".join([household] * times + [other])
            return customers.selectExpr(
                "DATE'2024-01-30' AS date", f"{key} AS mapping_key", f"array({entries}) AS user_ad_platform_ids"
            )

        return {
            "login_hash": table("md5(concat('lg', c))", "c % 5 = 0"),
            "anonymous_hash": table("concat('an', c)", "c % 5 = 1 OR c % 15 = 3"),
            "maid": table("concat('md', c)", "c % 5 = 2", times=2),
            "pubcid": table("concat('pb', c)", "c % 15 = 3 OR c % 15 = 8"),
            "site_user": table("concat('u', c)", "c % 10 = 4 OR c % 25 = 0"),
        }

    def audience(self) -> DataFrame:
        return self._events().selectExpr("ts", "event_type AS id_type", "concat('x', u) AS partner_id")
