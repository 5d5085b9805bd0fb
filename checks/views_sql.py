"""The derived advertising tables as flat SQL relations over the source tables.

Where the DataFrame side builds nested arrays, these relations hold one row per request,
ad, seat and bid, so the checks do not share its unnesting.
"""

from __future__ import annotations


def _person(n: str) -> str:
    return f"""
        CASE WHEN {n} % 97 < 90 THEN '10.0.' || CAST({n} % 97 AS VARCHAR) || '.0'
             WHEN {n} % 97 < 96 THEN '2001:db8:0:' || lower(to_hex({n} % 97)) || ':1:2:3:' || lower(to_hex({n} % 256))
             ELSE 'unknown' END AS ip,
        CASE WHEN {n} % 97 < 90 THEN '10.0.' || CAST({n} % 97 AS VARCHAR) || '.0'
             WHEN {n} % 97 < 96 THEN '2001:db8:0:' || lower(to_hex({n} % 97)) || '::' END AS home_ip,
        CASE WHEN {n} % 19 <> 7 THEN
             CASE {n} % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Mobile Safari' WHEN 2 THEN 'Samsung Internet' ELSE 'Opera' END
             END AS browser,
        CASE {n} % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
        CASE WHEN {n} % 23 <> 5 THEN 'dev' || CAST({n} % 8 AS VARCHAR) END AS device_name,
        CASE {n} % 2 WHEN 0 THEN 'iOS' ELSE 'Android' END AS os,
        CASE WHEN {n} % 17 <> 3 THEN 'v' || CAST({n} % 7 AS VARCHAR) END AS os_version"""


def _order_ts(n: str) -> str:
    return f"make_timestamp((1704067200 + ({n} * 7919) % 2592000) * 1000000)"


UNIT = "CAST(1.953125 AS DOUBLE)"

RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "requests": (
        (),
        f"""SELECT o_orderkey AS k, o_custkey AS c, {_order_ts('o_orderkey')} AS ts,
            CAST({_order_ts('o_orderkey')} AS DATE) AS d, 'r' || CAST(o_orderkey AS VARCHAR) AS request_id,
            o_orderkey % 5 <> 0 AS domestic, {_person('o_custkey')},
            CASE WHEN o_orderkey % 11 <> 0 THEN 'u' || CAST(o_custkey AS VARCHAR) END AS usr,
            CASE WHEN o_orderkey % 41 <= 1 THEN 0 ELSE 1 + o_orderkey % 2 END AS n_ads
            FROM orders""",
    ),
    "ads": (
        ("requests",),
        """SELECT r.*, a.i, CASE WHEN a.i IS NOT NULL THEN 'a' || CAST(k AS VARCHAR) || '-' || CAST(a.i AS VARCHAR) END AS ad_id,
            CASE WHEN (k + a.i) % 6 <> 5 THEN (k + a.i) % 3 = 0 END AS ad_won,
            CASE WHEN (k + a.i) % 37 = 0 THEN 0 ELSE 1 + (k + a.i) % 3 END AS n_seats
            FROM requests r LEFT JOIN (VALUES (1), (2)) a(i) ON a.i <= r.n_ads""",
    ),
    "all_seats": (
        ("ads",),
        f"""SELECT ads.*, s.j,
            CASE (k + 2 * i + s.j) % 6 WHEN 0 THEN 'beeswax' WHEN 1 THEN 'ozbeeswax' WHEN 2 THEN 'ozbwompv'
                WHEN 3 THEN 'beeswaxtest' WHEN 4 THEN 'rubicon' WHEN 5 THEN 'ozbwomp' END AS seat_name,
            CASE WHEN s.j IS NOT NULL THEN CASE (k + s.j) % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END END AS sent,
            CASE WHEN (k + i) % 8 <> 7 THEN (k + i + s.j) % 4 = 0 END AS seat_won,
            CASE WHEN (k + s.j) % 13 <> 0 THEN (1 + (k * 3 + i + s.j) % 480) * {UNIT} END AS seat_bid,
            CASE WHEN s.j IS NOT NULL AND k % 10 <> 9 AND k % 3 = 0 THEN true END AS test_arm,
            CASE WHEN s.j IS NOT NULL AND k % 10 <> 9 AND k % 3 = 1 THEN true END AS control_arm,
            CASE WHEN (k + s.j) % 31 = 0 THEN 0 ELSE (k + i + s.j) % 3 END AS n_bids
            FROM ads LEFT JOIN (VALUES (1), (2), (3)) s(j) ON s.j <= ads.n_seats""",
    ),
    "bids": (
        ("all_seats",),
        f"""SELECT s.k, s.i, s.j, v.b,
            CASE WHEN (k + j + v.b) % 5 <> 4 THEN (k + i + j + v.b) % 3 = 0 END AS won,
            CASE WHEN (k + v.b) % 9 <> 8 THEN (1 + (k * 13 + i * 7 + j * 5 + v.b) % 480) * {UNIT} END AS net,
            'cr-' || CAST(15000 + k % 5 AS VARCHAR) AS creative,
            CASE WHEN k % 8 <> 5 THEN 'b' || CAST(c % 50 + v.b AS VARCHAR) END AS bid_user,
            CASE (k + j + v.b) % 6 WHEN 0 THEN 'anonymous-id' WHEN 1 THEN 'hhip' WHEN 2 THEN 'login-id'
                WHEN 3 THEN 'maid' WHEN 4 THEN 'pubcid' END AS source,
            CASE WHEN (k + v.b) % 4 <> 0 THEN (k + j) % 2 = 0 END AS by_cookie
            FROM all_seats s JOIN (VALUES (1), (2)) v(b) ON v.b <= s.n_bids""",
    ),
    "seat_bids": (
        ("bids",),
        """SELECT k, i, j, bool_or(won) AS br_won, max(net) FILTER (WHERE won) AS br_bid, max(creative) AS creative,
            max(bid_user) FILTER (WHERE b = 1) AS first_bid_user,
            bool_or(source = 'anonymous-id') AS s_anonymous, bool_or(source = 'hhip') AS s_hhip,
            bool_or(source = 'login-id') AS s_login, bool_or(source = 'maid') AS s_maid,
            bool_or(source = 'pubcid') AS s_pubcid, bool_or(source IS NULL AND by_cookie) AS s_cookie
            FROM bids GROUP BY k, i, j""",
    ),
    "seats": (
        ("all_seats", "seat_bids"),
        """SELECT s.*, br_won, br_bid, creative, first_bid_user,
            CASE WHEN seat_name IN ('beeswax', 'ozbeeswax', 'ozbwomp', 'ozbwompv') THEN 'beeswax' ELSE 'other' END AS platform,
            CASE WHEN test_arm THEN 'disable_id_graph' WHEN control_arm THEN 'enable_id_graph' END AS arm
            FROM all_seats s LEFT JOIN seat_bids USING (k, i, j)
            WHERE contains(seat_name, 'beeswax') OR starts_with(seat_name, 'ozbwomp')""",
    ),
    "ev": (
        (),
        """SELECT event_id AS e, ts, CAST(ts AS DATE) AS d, user_id AS u, event_type AS kind,
            CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events""",
    ),
    "pixel_events": (
        ("ev",),
        f"""SELECT e, ts, d, n, {_person('u')},
            CASE WHEN e % 11 <> 0 THEN CASE WHEN e % 7 = 3 THEN 'v' ELSE 'u' END || CAST(u AS VARCHAR) END AS usr,
            'https://shop.example/p?x=' || CAST(e AS VARCHAR) || CASE n % 4
                WHEN 1 THEN '&utm_medium=' || CASE n % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'cpc' ELSE 'social' END
                    || '&utm_source=' || CASE n % 2 WHEN 0 THEN 'news' ELSE 'search' END
                WHEN 2 THEN '&utm_medium=cpc&y=1'
                WHEN 3 THEN '&utm_medium=&utm_source=s' || CAST(n % 5 AS VARCHAR) ELSE '' END AS url,
            CASE n % 4 WHEN 1 THEN CASE n % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'cpc' ELSE 'social' END
                WHEN 2 THEN 'cpc' END AS medium,
            CASE n % 4 WHEN 1 THEN CASE n % 2 WHEN 0 THEN 'news' ELSE 'search' END
                WHEN 3 THEN 's' || CAST(n % 5 AS VARCHAR) END AS source,
            CASE kind WHEN 'error' THEN 'visit' WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' END AS step,
            CASE WHEN e % 53 <> 0 THEN 'px-' || kind END AS pixel_name
            FROM ev""",
    ),
    "conv": (("pixel_events",), "SELECT * FROM pixel_events WHERE step IS NOT NULL"),
    "prefixes": (
        ("ev",),
        """SELECT d, CASE WHEN h < 90 THEN '10.0.' || CAST(h AS VARCHAR) || '.0'
                ELSE '2001:db8:0:' || lower(to_hex(h)) || '::' END AS prefix,
            CASE WHEN h % 4 = 3 THEN 'us' ELSE 'eu' END AS region,
            CASE WHEN h >= 90 THEN 1000000 ELSE h * 1000000 END AS tier,
            CASE WHEN h % 3 = 0 THEN 1 ELSE 2 END AS unnested
            FROM (SELECT DISTINCT d, u % 97 AS h FROM ev)""",
    ),
    "homes": (("prefixes",), "SELECT d AS home_day, prefix, unnested FROM prefixes WHERE region = 'eu' AND tier <= 55000000"),
    "impressions": (
        ("seats", "homes"),
        """SELECT DISTINCT d, request_id, seat_name, platform, sent, br_won, br_bid, usr, ip,
            EXISTS (SELECT 1 FROM homes WHERE home_day = d AND prefix = ip) AS home
            FROM seats WHERE domestic AND br_won""",
    ),
    "impression_ids": (
        ("impressions", "conv"),
        """SELECT row_number() OVER () AS id, m.*,
            NOT EXISTS (SELECT 1 FROM conv WHERE conv.usr = m.usr)
              OR EXISTS (SELECT 1 FROM conv WHERE conv.usr = m.usr AND step <> 'visit') AS by_address
            FROM impressions m""",
    ),
    "reached": (
        ("impression_ids", "conv"),
        """SELECT id, 'user_id' AS via, c.step, c.medium, c.source, false AS address_only
            FROM impression_ids m JOIN conv c ON c.usr = m.usr WHERE c.step = 'visit'
            UNION ALL
            SELECT id, 'hhip', CASE WHEN home THEN c.step END, c.medium, c.source, true
            FROM impression_ids m JOIN conv c ON c.ip = m.ip WHERE m.by_address""",
    ),
    "mapped": (
        ("impression_ids", "reached"),
        """SELECT m.*, coalesce(by_user, false) AS by_user, coalesce(by_home, false) AS by_home,
            coalesce(has_visit, false) AS has_visit, coalesce(has_started, false) AS has_started,
            coalesce(has_completed, false) AS has_completed, mediums, sources
            FROM impression_ids m LEFT JOIN (
              SELECT id, bool_or(via = 'user_id') AS by_user, bool_or(address_only AND step = 'visit') AS by_home,
                bool_or(step = 'visit') AS has_visit, bool_or(address_only AND step = 'started') AS has_started,
                bool_or(address_only AND step = 'completed') AS has_completed,
                string_agg(DISTINCT medium, ',' ORDER BY medium) AS mediums,
                string_agg(DISTINCT source, ',' ORDER BY source) AS sources
              FROM reached GROUP BY id) USING (id)""",
    ),
    "cached": (
        (),
        """WITH known AS (
              SELECT c_custkey AS c, unnest([
                CASE WHEN c_custkey % 5 = 0 THEN md5('lg' || CAST(c_custkey AS VARCHAR)) END,
                CASE WHEN c_custkey % 5 = 1 OR c_custkey % 15 = 3 THEN 'an' || CAST(c_custkey AS VARCHAR) END,
                CASE WHEN c_custkey % 5 = 2 THEN 'md' || CAST(c_custkey AS VARCHAR) END,
                CASE WHEN c_custkey % 5 = 2 THEN 'md' || CAST(c_custkey AS VARCHAR) END,
                CASE WHEN c_custkey % 15 = 3 OR c_custkey % 15 = 8 THEN 'pb' || CAST(c_custkey AS VARCHAR) END,
                CASE WHEN c_custkey % 10 = 4 OR c_custkey % 25 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) END]) AS mapping_key
              FROM customer)
            SELECT mapping_key, CASE WHEN c % 31 <> 0 THEN 'hh' || CAST(c % 40 AS VARCHAR) END AS household
            FROM known WHERE mapping_key IS NOT NULL""",
    ),
    "person_seats": (
        ("seats", "homes"),
        """SELECT row_number() OVER () AS id, s.*,
            CASE c % 5 WHEN 0 THEN md5('lg' || CAST(c AS VARCHAR)) END AS login_key,
            CASE WHEN c % 5 IN (1, 3) THEN 'an' || CAST(c AS VARCHAR) END AS anonymous_key,
            CASE c % 5 WHEN 2 THEN 'md' || CAST(c AS VARCHAR) END AS maid_key,
            CASE c % 5 WHEN 0 THEN 'u' || CAST(c AS VARCHAR) WHEN 3 THEN 'pb' || CAST(c AS VARCHAR) END AS pubcid_key,
            EXISTS (SELECT 1 FROM homes WHERE home_day = d AND prefix = home_ip) AS home
            FROM seats s WHERE domestic""",
    ),
    "cached_hits": (
        ("person_seats", "cached"),
        """SELECT id, request_id, household || device_name || os || browser AS person
            FROM person_seats s JOIN cached x ON x.mapping_key = login_key OR x.mapping_key = anonymous_key
              OR x.mapping_key = maid_key OR x.mapping_key = pubcid_key OR x.mapping_key = usr""",
    ),
    "shown": (
        (),
        f"""SELECT o_orderkey AS k, o_custkey AS c, {_order_ts('o_orderkey')} AS ts,
            CAST({_order_ts('o_orderkey')} AS DATE) AS d,
            'a' || CAST(o_orderkey - CASE WHEN o_orderkey % 16 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS ad_id,
            CAST(15000 + (o_orderkey // 16) % 5 AS VARCHAR) AS creative, {_person('o_custkey')}
            FROM orders""",
    ),
    "page_imps": (
        ("shown", "prefixes"),
        f"""SELECT s.*, CASE WHEN k % 11 <> 0 THEN 'p' || CAST(c AS VARCHAR) END AS pwid,
            'shop' || CAST(k % 6 AS VARCHAR) || '.example' AS domain,
            (1 + k % 480) * {UNIT} AS net, (1 + k % 480) * {UNIT} * 2 AS gross,
            (SELECT any_value(tier < 30000000) FROM prefixes p WHERE p.d = DATE '2024-01-30' AND p.prefix = s.ip
               AND p.region = CASE WHEN k % 4 = 3 THEN 'us' ELSE 'eu' END) AS home
            FROM shown s JOIN (VALUES (1), (2)) x(copy) ON x.copy = 1 OR k % 10 = 0
            WHERE k % 29 <> 0 AND k % 4 <> 2""",
    ),
    "wins": (
        ("shown",),
        """SELECT s.k AS win_k, s.ts AS win_ts, s.d, s.ad_id, s.creative, 70 + s.k % 4 AS advertiser_id,
            'c' || CAST(s.c % 6 AS VARCHAR) AS campaign_id, 'alt' || CAST(s.c % 6 AS VARCHAR) AS campaign_alt_id,
            'L' || CAST((s.c * 7) % 2500 AS VARCHAR) AS line_alt,
            CASE WHEN s.k % 3 <> 0 THEN s.k % 3 END AS clicks, CASE WHEN s.k % 5 > 0 THEN s.k % 5 END AS in_view,
            p_partkey, 'L' || CAST(p_partkey AS VARCHAR) AS line_id, 'IO' || CAST(p_partkey % 50 AS VARCHAR) AS io_number,
            'opp' || CAST(p_partkey % 20 AS VARCHAR) AS opportunity
            FROM shown s LEFT JOIN part ON p_partkey = (s.c * 7) % 2500""",
    ),
    "trackers": (
        ("ev",),
        """SELECT d, CASE WHEN e % 13 <> 0 THEN 'a' || CAST(e AS VARCHAR) END AS ad_id,
            'shop' || CAST(e % 6 AS VARCHAR) || '.example' AS tracker_domain,
            CAST(15000 + (e // 16) % 5 AS VARCHAR) AS creative,
            count(*) FILTER (WHERE kind = 'click') AS tracker_click, count(*) FILTER (WHERE kind = 'view') AS tracker_hovers
            FROM ev WHERE kind IN ('view', 'click') GROUP BY d, e, ad_id, tracker_domain, creative""",
    ),
    "seen_ads": (
        (),
        f"""SELECT CAST({_order_ts('(o_orderkey * 3)')} AS DATE) AS d, 'a' || CAST(o_orderkey * 3 AS VARCHAR) AS ad_id,
            o_orderkey % 2 AS v80, o_orderkey % 3 AS v100, o_orderkey % 4 AS viab, o_orderkey % 5 AS vhover FROM orders""",
    ),
    "delivered": (
        ("page_imps", "wins", "trackers", "seen_ads"),
        """SELECT p.d, p.pwid, p.browser, p.device, p.os, p.ip, p.home, 'u' || CAST(p.c AS VARCHAR) AS usr,
            w.win_ts AS ts, 'r' || CAST(w.win_k AS VARCHAR) AS request_id, p.domain, p.ad_id, w.line_id, w.advertiser_id,
            w.campaign_id, p.creative, w.io_number, w.opportunity, p.net, p.gross, w.clicks, w.in_view,
            t.tracker_domain, t.tracker_click, t.tracker_hovers, v80, v100, viab, vhover
            FROM page_imps p JOIN wins w ON w.d = p.d AND w.ad_id = p.ad_id AND w.creative = p.creative
            LEFT JOIN trackers t ON t.d = p.d AND t.ad_id = p.ad_id AND t.creative = p.creative
            LEFT JOIN seen_ads a ON a.d = p.d AND a.ad_id = p.ad_id""",
    ),
    "converted": (
        ("ev",),
        f"""SELECT d, ts, CASE WHEN e % 11 <> 0 THEN 'p' || CAST(u AS VARCHAR) END AS pwid, {_person('u')},
            u % 97 < 60 AS home, 'u' || CAST(u AS VARCHAR) AS usr,
            'shop' || CAST(e % 6 AS VARCHAR) || '.example' AS domain,
            CASE kind WHEN 'error' THEN '501' WHEN 'signup' THEN '502' ELSE '503' END AS pixel_id, 'px-' || kind AS pixel_name
            FROM ev WHERE kind IN ('error', 'signup', 'purchase')""",
    ),
    # Impressions against conversions row by row, copies kept apart.
    "imp_rows": (("delivered",), "SELECT row_number() OVER () AS imp_id, * FROM delivered"),
    "conv_rows": (("converted",), "SELECT row_number() OVER () AS conv_id, * FROM converted"),
    "attributed": (
        ("imp_rows", "conv_rows"),
        """SELECT i.*, hit.* EXCLUDE (key_ts, key_ad, key_creative),
            CASE WHEN conv_ts IS NOT NULL THEN greatest(date_diff('hour', i.ts, conv_ts), 1) END AS hours
            FROM imp_rows i LEFT JOIN (
              SELECT m.ts AS key_ts, m.ad_id AS key_ad, m.creative AS key_creative,
                c.conv_id, c.ts AS conv_ts, c.pwid AS conv_pwid, c.domain AS conv_domain, c.pixel_id, c.pixel_name
              FROM imp_rows m JOIN conv_rows c ON c.pwid = m.pwid AND c.domain = m.domain
                AND c.ts >= m.ts AND c.ts <= m.ts + INTERVAL 30 DAY) hit
            ON hit.key_ts = i.ts AND hit.key_ad = i.ad_id AND hit.key_creative = i.creative""",
    ),
}


def with_views(*names: str) -> str:
    """WITH clause holding the named relations and everything they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in RELATIONS[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n][1]})" for n in ordered)
