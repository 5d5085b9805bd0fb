"""SQL equivalents of the registered queries, run on the same source tables."""

from __future__ import annotations

from checks.views_sql import with_views

_SQL: dict[str, str] = {}


def _add(name: str, views: tuple[str, ...], select: str, text: str = "", ts: str = "") -> None:
    """``text`` names columns shown as plain text, ``ts`` timestamps shown to the microsecond."""
    shown = [f"CAST({c} AS VARCHAR) AS {c}" for c in text.split()]
    shown += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ts.split()]
    star = f"* REPLACE ({', '.join(shown)})" if shown else "*"
    head = with_views(*views) if views else ""
    _SQL[name] = f"{head} SELECT {star} FROM ({select}) AS result"


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _in_sample(seed: int, key: str, fraction: float) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0 < {fraction}"


def _metrics(sent: str, imps: str, spend: str, names: str = "br_revenue bcpmm fill_rate cpm") -> str:
    formulas = {
        "br_revenue": f"round({spend}, 0)",
        "bcpmm": f"round({spend} / nullif({sent}, 0) * 1000000, 2)",
        "fill_rate": f"round({imps} / nullif({sent}, 0) * 100, 2)",
        "cpm": f"round({spend} / nullif({imps}, 0) * 1000, 2)",
    }
    listed = [f"{sent} AS bid_request_sent"] if sent else []
    listed.append(f"{imps} AS imps")
    listed += [f"{formulas[n]} AS {n}" for n in names.split()]
    return ", ".join(listed)


_NON_NULL = ("count(sent)", "count(br_won)", "sum(br_bid / 1000)")
_TRUE_ONLY = ("count(*) FILTER (WHERE sent)", "count(*) FILTER (WHERE br_won)", "sum(br_bid / 1000)")

# --- scans and column functions ----------------------------------------------------------

_add(
    "partition_listing",
    ("ev",),
    "SELECT d AS partition_date, count(*) AS total FROM ev GROUP BY d",
    text="partition_date",
)
_add(
    "partition_listing_stored",
    ("ev",),
    "SELECT d AS partition_date, count(*) AS total FROM ev GROUP BY d",
    text="partition_date",
)
_add(
    "block_sample_counts",
    ("requests",),
    f"""SELECT bucket, CASE WHEN domestic THEN 'United Kingdom' ELSE 'France' END AS user_country, count(*) AS requests, sum(n_ads) AS ads
        FROM (SELECT *, 'b' || substr(md5(request_id), 1, 2) AS bucket FROM requests)
        WHERE {_in_sample(5, "'bucket=' || bucket", 0.25)} GROUP BY ALL""",
)
_add(
    "day_scan_counts",
    ("requests",),
    """SELECT count(*) FILTER (WHERE d = DATE '2024-01-30') AS yesterday,
        count(*) FILTER (WHERE d BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS last_7_days,
        count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-30 06:00:00' AND TIMESTAMP '2024-01-30 14:10:00') AS clock_window,
        count(*) FILTER (WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS month FROM requests""",
)
_add("utm_fields", ("pixel_events",), "SELECT url AS page_url, medium AS utm_medium, source AS utm_source FROM pixel_events")
_add(
    "text_functions",
    ("pixel_events",),
    """SELECT CASE WHEN p = 1 THEN 'r' || CAST(e AS VARCHAR) || CASE WHEN e % 13 <> 0 THEN '|a' || CAST(e AS VARCHAR) ELSE '' END END AS var1,
        'shop' || CAST(e % 6 AS VARCHAR) || '.example' AS domain,
        CASE WHEN p = 1 AND e % 13 <> 0 THEN 'a' || CAST(e AS VARCHAR) END AS second_part,
        CASE WHEN p = 1 THEN CAST(15000 + (e // 16) % 5 AS VARCHAR) END AS creative_id,
        CASE browser WHEN 'Chrome' THEN 'Chrome' WHEN 'Mobile Safari' THEN 'Safari'
            WHEN 'Samsung Internet' THEN 'SamsungBrowser' ELSE 'other' END AS browser
        FROM pixel_events, (VALUES (1), (2)) pages(p)""",
)
_add(
    "elapsed_time",
    ("ev",),
    """SELECT ts, h AS hours_crossed, CASE WHEN h = 0 THEN 1 ELSE h END AS hours,
        CAST(ceil(CASE WHEN h = 0 THEN 1 ELSE h END / 24) AS BIGINT) AS days
        FROM (SELECT ts, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS h FROM ev)""",
    ts="ts",
)
_add("household_addresses", ("requests",), "SELECT request_id, ip AS ip_address, home_ip AS household_address FROM requests")

# --- delivery ----------------------------------------------------------------------------

_SEAT = """d AS date_ts, request_id, ad_id, ip AS ip_address, browser AS browser_name, device AS device_type,
    os AS os_name, os_version, usr AS site_user_id, seat_name, sent AS is_bid_request_sent, test_arm AS is_test_arm,
    control_arm AS is_control_arm, creative AS creative_id, first_bid_user AS bid_user_id,
    br_won AS br_is_impression, br_bid AS br_max_bid_net_usd"""
_SEAT_TEXT = "date_ts is_bid_request_sent is_test_arm is_control_arm br_is_impression"
_add("seat_level", ("seats",), f"SELECT {_SEAT} FROM seats", text=_SEAT_TEXT)
_add(
    "seat_level_creative_impressions",
    ("seats",),
    f"SELECT {_SEAT} FROM seats WHERE br_won AND creative = 'cr-15003'",
    text=_SEAT_TEXT,
)
_AD_ROWS = """SELECT d, k, i, request_id, ad_id, ip, usr, ad_won, domestic,
    max(seat_bid) FILTER (WHERE seat_won) AS ad_bid FROM all_seats GROUP BY ALL"""
_add(
    "ad_level",
    ("all_seats",),
    f"""SELECT d AS date_ts, request_id, ad_id, ip AS ip_address, usr AS site_user_id, ad_won AS is_impression,
        ad_bid AS max_bid_net_usd FROM ({_AD_ROWS})""",
    text="date_ts is_impression",
)
for _name, _counts in (("seat_delivery_report", _NON_NULL), ("seat_delivery_report_true_only", _TRUE_ONLY)):
    _add(
        _name,
        ("seats",),
        f"""SELECT d AS date_ts, platform AS ad_platform, coalesce(arm, 'other') AS exp_type, {_metrics(*_counts)}
            FROM seats GROUP BY ALL""",
        text="date_ts",
    )
_SOURCES = {
    "anonymous_id": "s_anonymous",
    "hhip": "s_hhip",
    "login_id": "s_login",
    "maid": "s_maid",
    "pubcid": "s_pubcid",
    "cookie": "s_cookie",
}
_FLAGS = ", ".join(f"CASE WHEN {c} THEN true END AS id_source_{n}" for n, c in _SOURCES.items())
_FLAG_NAMES = " ".join(f"id_source_{n}" for n in _SOURCES)
_FLAG_ROWS = f"""SELECT d AS date_ts, request_id, ad_id, seat_name, sent AS is_bid_request_sent,
    br_won AS br_is_impression, test_arm AS is_test_arm, control_arm AS is_control_arm, {_FLAGS},
    CASE WHEN seat_won AND seat_bid IS NOT NULL THEN seat_bid ELSE 0 END AS max_bid_net_usd, br_bid AS br_max_bid_net_usd
    FROM all_seats LEFT JOIN seat_bids USING (k, i, j)"""
_add(
    "id_source_flags",
    ("seat_bids",),
    _FLAG_ROWS,
    text=f"date_ts is_bid_request_sent br_is_impression is_test_arm is_control_arm {_FLAG_NAMES}",
)


def _digests(columns: str, key: str, rows: str) -> str:
    """Rows, filled values, sums of money and a digest of whole rows per key."""
    others = [c for c in columns.split() if c != key]
    money = ("br_max_bid_net_usd", "max_bid_net_usd")
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '?')" for c in others if c not in money)
    shown = [f"count({c}) AS n_{c}" for c in others] + [f"sum({c}) AS sum_{c}" for c in others if c in money]
    digest = f"CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)) AS BIGINT) AS digest"
    return f"SELECT {key}, count(*) AS n_rows, {digest}, {', '.join(shown)} FROM ({rows}) GROUP BY {key}"


_SEAT_NAMES = """date_ts request_id ad_id ip_address browser_name device_type os_name os_version site_user_id seat_name
    is_bid_request_sent is_test_arm is_control_arm creative_id bid_user_id br_is_impression br_max_bid_net_usd"""
_FLAG_SHOWN = f"""date_ts request_id ad_id seat_name is_bid_request_sent br_is_impression is_test_arm is_control_arm
    {_FLAG_NAMES} max_bid_net_usd br_max_bid_net_usd"""
_add("seat_level_counts", ("seats",), _digests(_SEAT_NAMES, "seat_name", f"SELECT {_SEAT} FROM seats"))
_add(
    "seat_level_creative_counts",
    ("seats",),
    _digests(_SEAT_NAMES, "seat_name", f"SELECT {_SEAT} FROM seats WHERE br_won AND creative = 'cr-15003'"),
)
_add("id_source_flag_counts", ("seat_bids",), _digests(_FLAG_SHOWN, "seat_name", _FLAG_ROWS))
_add(
    "id_source_report",
    ("seat_bids",),
    f"""SELECT date_ts,
        CASE WHEN seat_name IN ('beeswax', 'ozbeeswax', 'ozbwomp', 'ozbwompv') THEN 'beeswax' ELSE 'other' END AS ad_platform,
        CASE WHEN is_test_arm THEN 'disable_id_graph' WHEN is_control_arm THEN 'enable_id_graph' ELSE 'other' END AS exp_type,
        {_FLAG_NAMES.replace(' ', ', ')},
        {_metrics('count(is_bid_request_sent)', 'count(br_is_impression)', 'sum(br_max_bid_net_usd / 1000)')},
        round(sum(max_bid_net_usd / 1000), 2) AS seat_revenue FROM ({_FLAG_ROWS}) GROUP BY ALL""",
    text=f"date_ts {_FLAG_NAMES}",
)
_add(
    "bid_creative_reach",
    ("seats",),
    f"""SELECT d AS date_ts, creative AS creative_id, platform AS ad_platform, coalesce(arm, 'no_exp_bucket') AS exp_type,
        {_metrics(*_NON_NULL)}, count(DISTINCT first_bid_user) AS unique_bid_user_id
        FROM seats WHERE domestic AND br_won AND creative = 'cr-15003' GROUP BY ALL""",
    text="date_ts",
)

# --- households and conversions ----------------------------------------------------------

_add("household_prefixes", ("homes",), "SELECT home_day AS date_h, prefix AS ip_address_prefix FROM homes", text="date_h")
_add(
    "household_prefixes_us",
    ("prefixes",),
    "SELECT d AS date_h, prefix AS ip_address_prefix FROM prefixes WHERE region = 'us' AND tier <= 76000000",
    text="date_h",
)
_add(
    "flag_household",
    ("ads", "homes"),
    """SELECT d AS date_ts, request_id, ad_id, ip AS ip_address, prefix IS NOT NULL AS is_household
        FROM ads LEFT JOIN homes ON home_day = d AND prefix = ip""",
    text="date_ts is_household",
)
_DEVICE = "ip || browser || device || os || os_version"
_add(
    "conversion_id_counts",
    ("conv",),
    f"""SELECT d AS date_ts, pixel_name, count(DISTINCT usr) AS distinct_user_id_count, count(usr) AS total_user_id_count,
        count(DISTINCT {_DEVICE}) AS distinct_pwid_count, count({_DEVICE}) AS total_pwid_count FROM conv GROUP BY ALL""",
    text="date_ts",
)


def _device_match(strict: bool) -> str:
    bare = "WHERE NOT EXISTS (SELECT 1 FROM rest WHERE rest.four = lone.four AND rest.pixel_name IS NOT NULL)" if strict else ""
    conv_columns = "pixel_name, conv_user, five"
    return f"""WITH bought AS (SELECT pixel_name, usr AS conv_user, {_DEVICE} AS five, ip || browser || os || os_version AS four, device
            FROM conv WHERE step = 'completed'),
        tried AS (SELECT s.d, platform, coalesce(arm, 'normal_workflow') AS arm, sent, br_won, br_bid,
            ip || browser || os || os_version AS four, b.pixel_name, b.conv_user, b.five
            FROM seats s LEFT JOIN bought b ON b.conv_user = s.usr),
        lone AS (SELECT * FROM tried WHERE pixel_name IS NULL),
        rest AS (SELECT * FROM bought WHERE conv_user NOT IN (SELECT conv_user FROM tried WHERE conv_user IS NOT NULL)),
        matched AS (
            SELECT d, platform, arm, sent, br_won, br_bid, {conv_columns} FROM tried WHERE pixel_name IS NOT NULL
            UNION ALL SELECT lone.d, lone.platform, lone.arm, sent, br_won, br_bid, rest.pixel_name,
                coalesce(rest.conv_user, lone.conv_user), rest.five FROM lone JOIN rest ON rest.four = lone.four
                WHERE rest.pixel_name IS NOT NULL
            UNION ALL SELECT d, platform, arm, sent, br_won, br_bid, NULL, NULL, NULL FROM lone {bare})
        SELECT d AS date_ts, platform AS ad_platform, arm AS exp_type, pixel_name, {_metrics(*_TRUE_ONLY)},
            count(DISTINCT conv_user) AS distinct_user_id_count, count(conv_user) AS total_user_id_count,
            count(DISTINCT five) AS distinct_pwid_count, count(five) AS total_pwid_count FROM matched GROUP BY ALL"""


_add("device_match_report", ("seats", "conv"), _device_match(False), text="date_ts")
_add("device_match_report_strict", ("seats", "conv"), _device_match(True), text="date_ts")

_IMPRESSION = """d AS date_ts, request_id, seat_name, sent AS is_bid_request_sent, br_won AS br_is_impression,
    br_bid AS br_max_bid_net_usd, usr AS site_user_id, ip AS ip_address, home AS is_household"""
_IMPRESSION_TEXT = "date_ts is_bid_request_sent br_is_impression is_household"
_add(
    "map_conversions",
    ("mapped",),
    f"""SELECT {_IMPRESSION}, by_user, by_home AS by_household, has_visit, has_started, has_completed,
        mediums AS utm_medium, sources AS utm_source FROM mapped""",
    text=f"{_IMPRESSION_TEXT} by_user by_household has_visit has_started has_completed",
)
_add(
    "consolidate_conversions",
    ("mapped",),
    f"""SELECT {_IMPRESSION}, CASE WHEN has_visit THEN 'site_visit' END AS visit_pixels,
        CASE WHEN has_started THEN 'conversion_started' END AS started_pixels,
        CASE WHEN has_completed THEN 'conversion_completed' END AS completed_pixels,
        CASE WHEN by_user AND by_home THEN 'hhip,user_id' WHEN by_user THEN 'user_id' WHEN by_home THEN 'hhip' END AS conversion_sources,
        mediums AS utm_medium, sources AS utm_source FROM mapped""",
    text=_IMPRESSION_TEXT,
)


def _totals(when_none: str) -> str:
    counted = {"total_visits": "has_visit", "total_started": "has_started", "total_completed": "has_completed"}
    steps = [f"CAST(sum(CASE WHEN {c} THEN 1 ELSE {when_none} END) AS BIGINT) AS {n}" for n, c in counted.items()]
    ways = {"conversion_source_user_id": "by_user", "conversion_source_hhip": "by_home"}
    steps += [f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in ways.items()]
    return ", ".join(steps)


for _name, _none in (("conversion_report", "NULL"), ("conversion_report_stored", "0")):
    _add(
        _name,
        ("mapped",),
        f"""SELECT d AS date_ts, platform AS ad_platform, home AS is_household, {_metrics(*_TRUE_ONLY, names='br_revenue cpm')},
            {_totals(_none)} FROM mapped GROUP BY ALL""",
        text="date_ts is_household",
    )
for _name, _none in (("utm_conversion_report", "0"), ("utm_conversion_report_in_query", "NULL")):
    _add(
        _name,
        ("mapped",),
        f"""WITH mediums_of AS (SELECT id, unnest(string_split(coalesce(mediums, 'null'), ',')) AS utm_medium FROM mapped),
            sources_of AS (SELECT id, unnest(string_split(coalesce(sources, 'direct'), ',')) AS utm_source FROM mapped)
            SELECT d AS date_ts, platform AS ad_platform, home AS is_household, utm_medium, utm_source,
            {_metrics('', *_TRUE_ONLY[1:], names='br_revenue cpm')}, {_totals(_none)}
            FROM mapped JOIN mediums_of USING (id) JOIN sources_of USING (id) GROUP BY ALL""",
        text="date_ts is_household",
    )
_add(
    "site_conversion_utm_report",
    ("conv",),
    """WITH visitors AS (SELECT d, ip, usr, list(DISTINCT medium) FILTER (WHERE medium IS NOT NULL) AS ms,
            list(DISTINCT source) FILTER (WHERE source IS NOT NULL) AS ss,
            bool_or(step = 'visit') AS v, bool_or(step = 'started') AS s, bool_or(step = 'completed') AS c
            FROM conv GROUP BY d, ip, usr),
        one_medium AS (SELECT d, v, s, c, ss, unnest(coalesce(ms, ['null'])) AS utm_medium FROM visitors),
        pairs AS (SELECT d, v, s, c, utm_medium, unnest(coalesce(ss, ['direct'])) AS utm_source FROM one_medium)
        SELECT d AS date_ts, utm_medium, utm_source, CAST(sum(CASE WHEN v THEN 1 END) AS BIGINT) AS total_visits,
            CAST(sum(CASE WHEN s THEN 1 END) AS BIGINT) AS total_started,
            CAST(sum(CASE WHEN c THEN 1 END) AS BIGINT) AS total_completed FROM pairs GROUP BY ALL""",
    text="date_ts",
)


def _overlap(strict: bool, totals: bool) -> str:
    steps = ", ".join(f"count(*) FILTER (WHERE step = '{s}') AS {n}" for n, s in _STEPS.items())
    spread = "" if strict else "LEFT JOIN home_conv h ON h.conv_ip = ad_rows.ip"
    extra = ", 0 AS total_visits, 0 AS total_started, 0 AS total_completed" if totals else ""
    appended = (
        f"""UNION ALL SELECT DATE '2024-01-01', NULL, NULL, medium, source, 0, 0, 0.0, 0, 0, 0,
            {', '.join(f"count(*) FILTER (WHERE step = '{s}')" for s in _STEPS.values())}
            FROM conv WHERE usr IN (SELECT usr FROM conv GROUP BY usr HAVING count(*) > 1) GROUP BY medium, source"""
        if totals
        else ""
    )
    return f"""WITH ad_rows AS (SELECT a.*, EXISTS (SELECT 1 FROM homes WHERE home_day = a.d AND prefix = a.ip) AS home
            FROM ({_AD_ROWS}) a WHERE domestic),
        both_sides AS (SELECT usr FROM ad_rows INTERSECT SELECT usr FROM conv WHERE usr IS NOT NULL),
        user_conv AS (SELECT d AS conv_day, usr, medium, source, {steps} FROM conv WHERE usr IS NOT NULL GROUP BY ALL),
        home_conv AS (SELECT d AS conv_day, ip AS conv_ip, medium, source, {steps} FROM conv
            WHERE (usr IS NULL OR usr NOT IN (SELECT usr FROM both_sides)) AND ip IN (SELECT prefix FROM homes) GROUP BY ALL),
        by_user AS (SELECT d, usr, count(*) AS requests, count(*) FILTER (WHERE ad_won) AS imps, round(sum(ad_bid / 1000), 2) AS revenue
            FROM ad_rows WHERE usr IS NOT NULL GROUP BY ALL),
        by_ip AS (SELECT ad_rows.d, ad_rows.ip, home, count(*) AS requests, count(*) FILTER (WHERE ad_won) AS imps,
            round(sum(ad_bid / 1000), 2) AS revenue FROM ad_rows {spread}
            WHERE ad_rows.usr IS NULL OR ad_rows.usr NOT IN (SELECT usr FROM both_sides) GROUP BY ad_rows.d, ad_rows.ip, home),
        lines AS (SELECT d, false AS home, 'user_id' AS via, medium, source, requests, imps, revenue, visits, started, completed
            FROM by_user JOIN user_conv USING (usr)
            UNION ALL SELECT d, home, CASE WHEN visits IS NOT NULL THEN 'hhip' END, medium, source, requests, imps, revenue,
                visits, started, completed FROM by_ip LEFT JOIN home_conv ON conv_ip = ip)
        SELECT d AS date_ts, home AS is_household, via AS conversion_mapping_source, medium AS utm_medium, source AS utm_source,
            CAST(sum(requests) AS BIGINT) AS total_requests, CAST(sum(imps) AS BIGINT) AS total_impressions,
            round(sum(revenue), 2) AS total_revenue, CAST(sum(visits) AS BIGINT) AS visits,
            CAST(sum(started) AS BIGINT) AS started, CAST(sum(completed) AS BIGINT) AS completed {extra}
            FROM lines GROUP BY d, home, via, medium, source {appended}"""


_STEPS = {"visits": "visit", "started": "started", "completed": "completed"}
_OVERLAP_VIEWS = ("all_seats", "homes", "conv")
_add("delivery_overlap", _OVERLAP_VIEWS, _overlap(False, False), text="date_ts is_household")
_add("delivery_overlap_strict", _OVERLAP_VIEWS, _overlap(True, False), text="date_ts is_household")
_add("delivery_overlap_with_totals", _OVERLAP_VIEWS, _overlap(False, True), text="date_ts is_household")

# --- identity ----------------------------------------------------------------------------

_add(
    "cached_households",
    ("cached",),
    "SELECT mapping_key, household AS household_id, count(*) AS cached_rows FROM cached GROUP BY ALL",
)
_PERSON_SEAT = """d, request_id, ad_id, seat_name, sent, test_arm, control_arm, br_won, br_bid, platform, arm"""
_REQUEST_PERSON = "home_ip || os || device_name || browser"


def _people(mode: str) -> str:
    hit = f"SELECT 'cached_hhip' AS via, person, {_PERSON_SEAT} FROM person_seats JOIN cached_hits USING (id, request_id)"
    uncached = "request_id NOT IN (SELECT request_id FROM cached_hits)"
    if mode == "exclusive":
        return f"""{hit} UNION ALL SELECT DISTINCT 'request_hhip', {_REQUEST_PERSON}, {_PERSON_SEAT} FROM person_seats
            WHERE home AND {uncached}
            UNION ALL SELECT 'no_hhip_found', usr, {_PERSON_SEAT} FROM person_seats WHERE {uncached}
              AND request_id NOT IN (SELECT request_id FROM person_seats WHERE home)"""
    if mode == "distinct_fallback":
        return f"""{hit} UNION ALL SELECT 'request_hhip', {_REQUEST_PERSON}, {_PERSON_SEAT} FROM person_seats
            WHERE home AND {uncached}
            UNION ALL SELECT DISTINCT 'no_hhip_found', usr, {_PERSON_SEAT} FROM person_seats"""
    return f"""SELECT CASE WHEN h.person IS NOT NULL THEN 'cached_hhip' WHEN {_REQUEST_PERSON} IS NOT NULL THEN 'request_hhip'
            ELSE 'no_hhip_found' END AS via, coalesce(h.person, {_REQUEST_PERSON}, usr) AS person, {_PERSON_SEAT}
        FROM (SELECT * FROM person_seats WHERE br_won) s LEFT JOIN cached_hits h USING (id, request_id)
        LEFT JOIN (SELECT home_day, prefix, unnest(range(unnested)) FROM homes) x
          ON h.person IS NULL AND home_day = d AND prefix = home_ip"""


for _mode in ("exclusive", "distinct_fallback", "cascade"):
    _add(
        f"resolve_person_{_mode}",
        ("person_seats", "cached_hits"),
        f"""SELECT via AS ip_source, person AS premium_web_id, d AS date_ts, request_id, ad_id, seat_name,
            sent AS is_bid_request_sent, test_arm AS is_test_arm, control_arm AS is_control_arm,
            br_won AS br_is_impression, br_bid AS br_max_bid_net_usd, count(*) AS match_rows
            FROM ({_people(_mode)}) GROUP BY ALL""",
        text="date_ts is_bid_request_sent is_test_arm is_control_arm br_is_impression",
    )
_add(
    "cascade_sampled",
    ("person_seats", "cached_hits"),
    f"""SELECT via AS ip_source, person AS premium_web_id, d AS date_ts, request_id, ad_id, seat_name,
        sent AS is_bid_request_sent, test_arm AS is_test_arm, control_arm AS is_control_arm,
        br_won AS br_is_impression, br_bid AS br_max_bid_net_usd, count(*) AS match_rows
        FROM ({_people("cascade")}) WHERE {_in_sample(3, "request_id", 0.2)} GROUP BY ALL""",
    text="date_ts is_bid_request_sent is_test_arm is_control_arm br_is_impression",
)
for _name, _mode in (
    ("reach_of_people", "exclusive"), ("reach_exclusive", "exclusive"), ("reach_distinct_fallback", "distinct_fallback")
):
    _add(
        _name,
        ("person_seats", "cached_hits"),
        f"""SELECT d AS date_ts, platform AS ad_platform, coalesce(arm, 'no_exp_bucket') AS exp_type, {_metrics(*_NON_NULL)},
            count(DISTINCT person) AS unique_pwid FROM ({_people(_mode)}) GROUP BY ALL""",
        text="date_ts",
    )

# --- attribution -------------------------------------------------------------------------

_KEYS = """d AS date, pwid AS user_pwid_raw, browser AS browser_name, device AS device_type, os AS os_name,
    ip AS ip_address, home AS is_household, usr AS site_user_id"""
_FAMILY = """CASE browser WHEN 'Chrome' THEN 'Chrome' WHEN 'Mobile Safari' THEN 'Safari'
    WHEN 'Samsung Internet' THEN 'SamsungBrowser' ELSE 'other' END"""
_add(
    "root_delivery",
    ("delivered",),
    f"""SELECT {_KEYS}, ts, request_id, domain AS advertiser_domain, ad_id, line_id AS line_item_id, advertiser_id, campaign_id,
        creative AS creative_id, io_number, opportunity AS opportunity_name, net AS bid_net_usd, gross AS bid_gross_usd,
        clicks AS beeswax_clicks, in_view AS beeswax_in_view_time, tracker_domain AS tracker_advertiser_domain, tracker_click,
        tracker_hovers, v80 AS dv_net_80_viewable_imp, v100 AS dv_net_100_viewable_imp, viab AS dv_net_iab_viewable_imp,
        vhover AS dv_ad_mouse_hover_imp FROM delivered""",
    text="date is_household",
    ts="ts",
)
_CONVERTED = f"SELECT * REPLACE ({_FAMILY} AS browser) FROM converted"
_add(
    "root_conversions",
    ("converted",),
    f"""SELECT {_KEYS}, ts, domain AS advertiser_domain, pixel_id, pixel_name, CAST(1 AS BIGINT) AS conversion FROM ({_CONVERTED})""",
    text="date is_household",
    ts="ts",
)
_HOUR = "date_trunc('hour', ts)"
_add(
    "event_root_nested",
    ("delivered", "converted"),
    f"""WITH entries AS (SELECT *, count(*) AS copies FROM delivered GROUP BY ALL),
        shown AS (SELECT *, count(*) OVER (PARTITION BY d, pwid, browser, device, os, ip, home, usr, {_HOUR}) AS size FROM entries)
        SELECT {_KEYS}, {_HOUR} AS hour, size AS delivered, ts, request_id, domain AS advertiser_domain, ad_id,
        line_id AS line_item_id, advertiser_id, campaign_id, creative AS creative_id, io_number, opportunity AS opportunity_name,
        net AS bid_net_usd, gross AS bid_gross_usd, clicks AS beeswax_clicks, in_view AS beeswax_in_view_time,
        tracker_domain AS tracker_advertiser_domain, tracker_click, tracker_hovers, v80 AS dv_net_80_viewable_imp,
        v100 AS dv_net_100_viewable_imp, viab AS dv_net_iab_viewable_imp, vhover AS dv_ad_mouse_hover_imp,
        NULL AS pixel_id, NULL AS pixel_name, copies FROM shown
        UNION ALL SELECT {_KEYS}, {_HOUR} AS hour, NULL, ts, NULL, domain, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, pixel_id, pixel_name, count(*) FROM ({_CONVERTED}) GROUP BY ALL""",
    text="date is_household",
    ts="ts hour",
)
_add(
    "active_events",
    ("delivered", "converted"),
    f"""WITH every AS (
          SELECT d, pwid, browser, device, os, ip, home, usr, coalesce(domain, tracker_domain) AS domain, campaign_id,
            CASE WHEN campaign_id = 'c3' THEN NULL ELSE 1 END AS impression, NULL AS conversion
          FROM delivered
          UNION ALL SELECT d, pwid, browser, device, os, ip, home, usr, domain, NULL, NULL, 1 FROM ({_CONVERTED})),
        marked AS (SELECT *,
            count(impression) OVER (PARTITION BY pwid, browser, device, os, ip, home, usr, domain) AS device_impressions,
            count(conversion) OVER (PARTITION BY pwid, domain) AS person_conversions FROM every)
        SELECT coalesce(campaign_id, 'none') AS campaign_id, count(impression) AS impressions, count(conversion) AS conversions,
            count(*) AS events, 'kept' AS state FROM marked WHERE device_impressions > 0 OR person_conversions > 0 GROUP BY ALL
        UNION ALL SELECT coalesce(campaign_id, 'none'), count(impression), count(conversion), count(*), 'all' FROM marked GROUP BY ALL""",
)
_ROW_ORDER = ", ".join(
    f"{c} ASC NULLS FIRST"
    for c in """ts pwid browser device os ip home usr domain campaign_id line_id opportunity io_number gross clicks
    tracker_click conv_ts pixel_name pixel_id""".split()
)
_FIRST_MARKED = f"""SELECT *, row_number() OVER (PARTITION BY d, ad_id, creative ORDER BY {_ROW_ORDER}) = 1 AS is_first FROM attributed"""
_MAPPED = "CASE WHEN conv_ts IS NOT NULL {also} THEN true END"
_add(
    "attribute_conversions",
    ("attributed",),
    f"""SELECT d AS date, pwid AS user_pwid_raw, browser AS browser_name, device AS device_type, os AS os_name, ip AS ip_address,
        home AS is_household, usr AS site_user_id, campaign_id, line_id AS line_item_id, opportunity AS opportunity_name,
        io_number, domain AS advertiser_domain, ad_id, creative AS creative_id, ts AS impression_ts, gross AS bid_gross_usd,
        clicks AS beeswax_clicks, tracker_click, conv_ts AS conversion_ts, pixel_name, pixel_id, hours AS hrs_since_impression,
        CAST(ceil(hours / 24) AS INTEGER) AS days_since_impression,
        CASE WHEN clicks > 0 THEN true END AS is_beeswax_click, CASE WHEN tracker_click > 0 THEN true END AS is_tracker_click,
        {_MAPPED.format(also='')} AS is_conversion_mapped, {_MAPPED.format(also='AND clicks > 0')} AS is_beeswax_click_conversion,
        {_MAPPED.format(also='AND tracker_click > 0')} AS is_tracker_click_conversion,
        greatest(count(DISTINCT conv_id), 1) AS conversion_copies,
        count(*) // greatest(count(DISTINCT conv_id), 1) AS row_copies, bool_or(is_first) AS is_first_row
        FROM ({_FIRST_MARKED}) GROUP BY ALL, conv_pwid, conv_domain""".replace("GROUP BY ALL, conv_pwid, conv_domain", """GROUP BY
        d, pwid, browser, device, os, ip, home, usr, campaign_id, line_id, opportunity, io_number, domain, ad_id, creative, ts,
        gross, clicks, tracker_click, conv_ts, pixel_name, pixel_id, hours, conv_pwid, conv_domain"""),
    text="""date is_household is_beeswax_click is_tracker_click is_conversion_mapped is_beeswax_click_conversion
    is_tracker_click_conversion is_first_row""",
    ts="impression_ts conversion_ts",
)


_add(
    "attributed_rows",
    ("attributed",),
    f"""SELECT d AS date, campaign_id, pwid AS user_pwid_raw, count(*) AS mapped_rows,
        count(DISTINCT (ts, ad_id, creative)) AS impression_keys, count(DISTINCT conv_id) AS conversion_keys,
        count(*) FILTER (WHERE is_first) AS first_rows FROM ({_FIRST_MARKED}) GROUP BY ALL""",
    text="date",
)


_add(
    "attributed_rows_in_slots",
    ("attributed",),
    """SELECT d AS date, domain AS advertiser_domain, pixel_name, count(*) AS mapped_rows,
        count(DISTINCT conv_id) AS conversion_keys, CAST(sum(hours) AS BIGINT) AS hours FROM attributed GROUP BY ALL""",
    text="date",
)
_add(
    "conversion_lags",
    ("imp_rows", "conv_rows"),
    """SELECT c.domain AS advertiser_domain, c.pixel_name, (epoch_us(c.ts) - epoch_us(m.ts)) // 86400000000 AS lag_days,
        count(*) AS pairs, count(DISTINCT c.pwid) AS people
        FROM imp_rows m JOIN conv_rows c ON c.pwid = m.pwid AND c.domain = m.domain
        AND c.ts >= m.ts AND c.ts <= m.ts + INTERVAL 30 DAY GROUP BY ALL""",
)


def _reached(test: str = "true") -> str:
    return f"count(DISTINCT conv_id) FILTER (WHERE {test})"


_CAMPAIGN_SQL = f"""SELECT d AS date, campaign_id, line_id AS line_item_id, opportunity AS opportunity_name, io_number,
    browser AS browser_name, count(DISTINCT (ts, ad_id, creative)) AS impressions,
    count(DISTINCT (ts, ad_id, creative)) FILTER (WHERE clicks > 0) AS beeswax_clicks,
    CAST(sum(tracker_click) FILTER (WHERE is_first) AS BIGINT) AS tracker_clicks,
    count(DISTINCT (ts, ad_id, creative)) FILTER (WHERE tracker_click > 0) AS tracker_click_impressions,
    {_reached()} AS conversions,
    {_reached('ceil(hours / 24) <= 7')} AS pv_conversions_7d,
    {_reached('ceil(hours / 24) <= 30')} AS pv_conversions_30d,
    {_reached('ceil(hours / 24) <= 7 AND tracker_click > 0')} AS pc_conversions_7d,
    {_reached('ceil(hours / 24) <= 30 AND tracker_click > 0')} AS pc_conversions_30d,
    {_reached('clicks > 0')} AS beeswax_click_conversions,
    {_reached('tracker_click > 0')} AS tracker_click_conversions,
    sum(gross) FILTER (WHERE is_first) / 1000 AS bid_gross_usd
    FROM ({_FIRST_MARKED}) GROUP BY d, campaign_id, line_id, opportunity, io_number, browser"""
_add("campaign_rollup", ("attributed",), _CAMPAIGN_SQL, text="date")
_add("campaign_report", ("attributed",), _CAMPAIGN_SQL, text="date")


def _touched(name: str, days: int) -> str:
    return f"""{name} AS (SELECT browser, device, domain, campaign_id, opportunity, d, count(*) AS taken FROM (
        SELECT c.pwid, c.domain, c.ts, i.browser, i.device, i.campaign_id, i.opportunity, i.d
        FROM (SELECT DISTINCT pwid, domain, ts FROM converted) c
        JOIN delivered i ON i.pwid = c.pwid AND i.domain = c.domain AND c.ts BETWEEN i.ts AND i.ts + INTERVAL {days} DAY
        QUALIFY row_number() OVER (PARTITION BY c.pwid, c.domain, c.ts ORDER BY i.ts, i.browser NULLS FIRST,
            i.device NULLS FIRST, i.campaign_id NULLS FIRST, i.opportunity NULLS FIRST) = 1) GROUP BY ALL)"""


_SAME_GROUP = " AND ".join(
    f"x.{c} IS NOT DISTINCT FROM s.{c}" for c in ("browser", "device", "domain", "campaign_id", "opportunity", "d")
)
_add(
    "first_touch_report",
    ("delivered", "converted"),
    f"""WITH {_touched('by_day', 1)}, {_touched('by_week', 7)},
        s AS (SELECT browser, device, domain, campaign_id, opportunity, d,
            count(DISTINCT (coalesce(pwid, ''), os, ip, coalesce(CAST(home AS VARCHAR), ''), usr, ts)) AS shown
            FROM delivered GROUP BY ALL)
        SELECT s.browser AS browser_name, s.device AS device_type, s.domain AS advertiser_domain, s.campaign_id,
            s.opportunity AS opportunity_name, s.d AS impression_date, shown AS impressions,
            (SELECT taken FROM by_day x WHERE {_SAME_GROUP}) AS conversions_attributed_day,
            (SELECT taken FROM by_week x WHERE {_SAME_GROUP}) AS conversions_attributed_week FROM s""",
    text="impression_date",
)

# --- line items and exports --------------------------------------------------------------



def _pixels(kept: str) -> str:
    return f"""WITH p AS (SELECT CASE WHEN e % 7 = 0 THEN 'none' ELSE CAST(70 + e % 4 AS VARCHAR) END AS adv,
            CASE kind WHEN 'error' THEN '501' WHEN 'signup' THEN '502' ELSE '503' END AS pixel_id, 'px-' || kind AS pixel_name,
            count(*) AS n FROM ev WHERE kind IN ('error', 'signup', 'purchase') GROUP BY ALL),
        w AS (SELECT advertiser_id, line_alt, campaign_alt_id, campaign_id, p_partkey, line_id, io_number, opportunity,
            count(*) AS m FROM wins WHERE {kept} GROUP BY ALL)
        SELECT p.adv AS internal_advertiser_id, pixel_id, pixel_name, w.advertiser_id, w.line_alt AS line_item_alt_id,
        w.campaign_alt_id, w.campaign_id, line_id AS line_item_id, io_number, p_type AS product, p_brand AS record_type,
        CASE WHEN line_id IS NOT NULL THEN 'CPM' END AS metric, opportunity AS opportunity_name,
        'acc' || CAST(w.p_partkey % 10 AS VARCHAR) AS account_id, p_name AS account_name,
        CASE WHEN w.p_partkey % 3 <> 0 THEN 'retail' END AS industry, 'ag' || CAST(w.p_partkey % 4 AS VARCHAR) AS agency,
        'cg' || CAST(w.p_partkey % 2 AS VARCHAR) AS customer_group,
        DATE '2024-01-01' + CAST(min(p_size) AS INTEGER) AS start_date, DATE '2024-03-01' + CAST(max(p_size) AS INTEGER) AS end_date,
        CAST(sum(p.n * coalesce(w.m, 1)) AS BIGINT) AS number_pixel_events
        FROM p LEFT JOIN w ON w.advertiser_id = TRY_CAST(p.adv AS BIGINT)
        LEFT JOIN part ON part.p_partkey = w.p_partkey GROUP BY ALL"""


_add("match_pixels_to_line_items", ("ev", "wins"), _pixels("true"), text="start_date end_date")
_add(
    "match_pixels_to_line_items_sampled",
    ("ev", "wins"),
    _pixels(_in_sample(7, "'r' || CAST(win_k AS VARCHAR)", 0.05)),
    text="start_date end_date",
)
_PARTS = """WITH days AS (SELECT d, count(*) AS total, CAST(ceil(count(*) / 150) AS BIGINT) AS parts FROM ev GROUP BY d),
    files AS (SELECT d, total, parts, unnest(range(1, parts + 1)) AS part FROM days)
    SELECT d AS export_date, CAST(part AS VARCHAR) || '/' || CAST(parts AS VARCHAR) AS partition,
        'audience_' || strftime(d, '%Y%m%d') || '_part' || CAST(part AS VARCHAR) || 'of' || CAST(parts AS VARCHAR) || '.csv' AS filename,
        least(150, total - (part - 1) * 150) AS row_count FROM files"""
_add("export_manifest", ("ev",), _PARTS, text="export_date")
_add("export_daily_csv", ("ev",), f"SELECT filename, row_count FROM ({_PARTS})")
_add(
    "export_ordered_csv",
    ("ev",),
    "SELECT ts, kind AS id_type, 'x' || CAST(u AS VARCHAR) AS partner_id FROM ev",
    ts="ts",
)
_add(
    "export_single_header_csv",
    ("ev",),
    """SELECT 'ts,id_type,partner_id' AS line UNION ALL
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || kind || ',x' || CAST(u AS VARCHAR) FROM ev""",
)
_add(
    "users_over_spans",
    ("requests",),
    """SELECT span, CASE WHEN domestic THEN 'United Kingdom' ELSE 'France' END AS user_country, count(DISTINCT usr) AS distinct_ids
        FROM requests JOIN (VALUES ('day', DATE '2024-01-30', DATE '2024-01-30'), ('week', DATE '2024-01-24', DATE '2024-01-30'),
            ('month', DATE '2024-01-01', DATE '2024-01-30'), ('middle', DATE '2024-01-05', DATE '2024-01-17')) s(span, low, high)
            ON d BETWEEN low AND high
        GROUP BY ALL HAVING count(DISTINCT usr) > 0""",
)
_SQL["campaign_report_from_days"] = _SQL["campaign_report"]
_SQL["campaign_report_from_nested"] = _SQL["campaign_report"]
_SQL["seat_delivery_report_from_tables"] = _SQL["seat_delivery_report"]
