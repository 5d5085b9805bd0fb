"""Attributing conversions to impressions of the same person and advertiser.

Both reports are computed without impression-by-conversion pairs; ``attribute_conversions``
gives the pairs themselves where they are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.functions.text import hashed_key, micros_text
from adlytics.functions.times import days_rounded_up, hours_at_least_one
from adlytics.operators.event_root import ROOT_KEYS
from adlytics.operators.intervals import MOST_POINTS, interval_join
from adlytics.operators.joins import join_null_safe
from adlytics.operators.timeline import count_before, first_at_or_after
from adlytics.workspace import Workspace

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS
_PERSON = tuple(k for k in ROOT_KEYS if k != "date")
_MATCH = ("user_pwid_raw", "advertiser_domain")
_DELIVERY = (
    "ad_id",
    "creative_id",
    "campaign_id",
    "line_item_id",
    "opportunity_name",
    "io_number",
    "bid_gross_usd",
    "beeswax_clicks",
    "tracker_click",
)


def attribution_events(rows: DataFrame, use_tracker_domain: bool = True) -> DataFrame:
    """Events with one timestamp and one advertiser domain.

    ``use_tracker_domain`` falls back on the domain the click tracker saw.
    """
    domains = ["conversion.advertiser_domain", "delivery.advertiser_domain"]
    if use_tracker_domain:
        domains.append("delivery.tracker_advertiser_domain")
    return rows.select(
        *_PERSON,
        F.coalesce("conversion.ts", "delivery.ts").alias("ts"),
        F.coalesce(*domains).alias("advertiser_domain"),
        *[F.col(f"delivery.{f}").alias(f) for f in _DELIVERY],
        F.when(F.col("delivery.ts").isNotNull(), F.lit(1)).alias("impression"),
        F.col("conversion.pixel_name").alias("pixel_name"),
        F.col("conversion.pixel_id").alias("pixel_id"),
        F.col("conversion.conversion").alias("conversion"),
    )


def keep_active(events: DataFrame) -> DataFrame:
    """Keep events of a device with an impression or of a person with a conversion.

    An impression or conversion keeps itself, so only other events need a look at their
    group; no window over whole groups is needed. A root built by ``event_root`` holds no
    other events, so the reports do without this step; it is for roots from elsewhere.
    """
    itself = F.col("impression").isNotNull() | F.col("conversion").isNotNull()
    active, rest = events.filter(itself), events.filter(~itself)
    device = [*_PERSON, "advertiser_domain"]
    devices = events.filter(F.col("impression").isNotNull()).select(*device).distinct().withColumn("d", F.lit(True))
    people = events.filter(F.col("conversion").isNotNull()).select(*_MATCH).distinct().withColumn("p", F.lit(True))
    flagged = join_null_safe(join_null_safe(rest, devices, device), people, _MATCH)
    kept = flagged.filter(F.col("d").isNotNull() | F.col("p").isNotNull()).drop("d", "p")
    return active.unionByName(kept)


def impression_key() -> Column:
    return hashed_key(micros_text(F.col("ts")), F.col("ad_id"), F.col("creative_id"))


def _impressions(events: DataFrame) -> DataFrame:
    """Distinct impression rows with their number of copies."""
    return (
        events.filter(F.col("ad_id").isNotNull())
        .groupBy("ts", *_PERSON, "advertiser_domain", *_DELIVERY)
        .agg(F.count(F.lit(1)).alias("impression_copies"))
    )


def _conversions(events: DataFrame) -> DataFrame:
    """Distinct conversions with their number of copies, each counting as a conversion."""
    return (
        events.filter(F.col("conversion") > 0)
        .groupBy(*_MATCH, F.col("ts").alias("conversion_ts"), "pixel_name", "pixel_id")
        .agg(F.count(F.lit(1)).alias("conversion_copies"))
    )


def _matchable(rows: DataFrame, conversions: DataFrame) -> DataFrame:
    """Rows of persons and advertisers that have a conversion at all; most have none."""
    return rows.join(conversions.select(*_MATCH).distinct(), list(_MATCH), "left_semi")


def _kept(space: Workspace | None, table: DataFrame, name: str) -> DataFrame:
    return table if space is None else space.save(table, name)


def _conversions_after(
    impressions: DataFrame, conversions: DataFrame, days: int, space: Workspace | None, most: int
) -> DataFrame:
    """Pairs of an instant at which something was shown and a conversion within ``days`` after it."""
    spans = conversions.withColumn("until", F.unix_micros("conversion_ts")).withColumn(
        "since", F.col("until") - F.lit(days * DAY_MICROS)
    )
    shown = (
        _matchable(impressions, conversions)
        .groupBy(*_MATCH, "ts", "impression_primary_key")
        .agg(F.sum("impression_copies").alias("match_copies"))
        .withColumn("at", F.unix_micros("ts"))
    )
    pairs = interval_join(_kept(space, shown, "shown"), spans, _MATCH, "at", "since", "until", most, space)
    return pairs.drop("at", "since", "until")


def attribute_conversions(
    events: DataFrame, days: int = 30, space: Workspace | None = None, most: int = MOST_POINTS
) -> DataFrame:
    """Impressions with the conversions within ``days`` after them, one row per match.

    An impression without conversions keeps one row. Matches are found per person and
    advertiser and attach to every impression row of the same instant, ad and creative.
    Equal rows are summed: ``row_copies`` and ``conversion_copies`` say how many equal
    rows and conversions a row stands for (``expand_copies`` spells them out).
    ``is_first_row`` marks one row per day, ad and creative, its earliest. A person with more
    than ``most`` impressions is spread over slots of time (``interval_join``); with a workspace,
    impressions and conversions are saved there, so the events are read twice only.
    """
    impressions = _impressions(events).withColumn("impression_primary_key", impression_key())
    impressions = _kept(space, impressions, "impressions")
    conversions = _kept(space, _conversions(events), "conversions")
    found = _conversions_after(impressions, conversions, days, space, most)
    matches = found.select(
        "impression_primary_key",
        F.col("user_pwid_raw").alias("conversion_pwid"),
        F.col("advertiser_domain").alias("conversion_domain"),
        "conversion_ts",
        "pixel_name",
        "pixel_id",
        "conversion_copies",
        "match_copies",
    )
    joined = impressions.join(matches, "impression_primary_key", "left")
    hours = hours_at_least_one(F.col("conversion_ts"), F.col("ts"))
    mapped = F.col("conversion_ts").isNotNull()
    conversion_key = hashed_key(
        F.col("conversion_pwid"),
        F.col("conversion_domain"),
        micros_text(F.col("conversion_ts")),
        F.col("pixel_name"),
        F.col("pixel_id"),
    )
    rows = joined.select(
        F.to_date("ts").alias("date"),
        *_PERSON,
        "campaign_id",
        "line_item_id",
        "opportunity_name",
        "io_number",
        "advertiser_domain",
        "ad_id",
        "creative_id",
        F.col("ts").alias("impression_ts"),
        "impression_primary_key",
        "bid_gross_usd",
        "beeswax_clicks",
        "tracker_click",
        "conversion_ts",
        "pixel_name",
        "pixel_id",
        F.when(mapped, conversion_key).alias("conversion_primary_key"),
        hours.alias("hrs_since_impression"),
        days_rounded_up(hours).alias("days_since_impression"),
        F.when(F.col("beeswax_clicks") > 0, True).alias("is_beeswax_click"),
        F.when(F.col("tracker_click") > 0, True).alias("is_tracker_click"),
        F.when(mapped, True).alias("is_conversion_mapped"),
        F.when(mapped & (F.col("beeswax_clicks") > 0), True).alias("is_beeswax_click_conversion"),
        F.when(mapped & (F.col("tracker_click") > 0), True).alias("is_tracker_click_conversion"),
        F.coalesce("conversion_copies", F.lit(1)).alias("conversion_copies"),
        (F.col("impression_copies") * F.coalesce("match_copies", F.lit(1))).alias("row_copies"),
    )
    return _mark_first_row(rows)


_FIRST_OF = ("date", "ad_id", "creative_id")
_FIRST_ORDER = (
    "impression_ts",
    *_PERSON,
    "advertiser_domain",
    "campaign_id",
    "line_item_id",
    "opportunity_name",
    "io_number",
    "bid_gross_usd",
    "beeswax_clicks",
    "tracker_click",
)


def _mark_first_row(rows: DataFrame) -> DataFrame:
    """Flag the smallest row per day, ad and creative: a mergeable minimum, not a sort."""
    order = F.struct(*_FIRST_ORDER, "conversion_ts", "pixel_name", "pixel_id", "conversion_primary_key")
    first = rows.groupBy(*_FIRST_OF).agg(F.min(order).alias("first_row"))
    flagged = join_null_safe(rows, first, _FIRST_OF)
    return flagged.withColumn("is_first_row", order.eqNullSafe(F.col("first_row"))).drop("first_row")


def expand_copies(mapping: DataFrame) -> DataFrame:
    """One row per single impression row and conversion; copies get their own keys."""
    numbered = mapping.withColumn(
        "conversion_row_num", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("conversion_copies")))
    )
    keyed = numbered.withColumn(
        "conversion_primary_key",
        F.when(
            F.col("conversion_primary_key").isNotNull(),
            hashed_key(F.col("conversion_primary_key"), F.col("conversion_row_num")),
        ),
    )
    repeated = keyed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("row_copies"))))
    first = F.col("is_first_row") & (F.col("copy") == 1) & (F.col("conversion_row_num") == 1)
    return repeated.withColumn("is_first_row", first).drop(
        "copy", "row_copies", "conversion_copies", "conversion_row_num"
    )


def conversion_lags(
    events: DataFrame, days: int = 30, space: Workspace | None = None, most: int = MOST_POINTS
) -> DataFrame:
    """Per advertiser, pixel and whole days between them: impressions followed by a conversion.

    ``pairs`` counts every impression row with every conversion, ``people`` the persons.
    """
    impressions = _impressions(events).withColumn("impression_primary_key", impression_key())
    impressions = _kept(space, impressions, "impressions")
    conversions = _kept(space, _conversions(events), "conversions")
    found = _conversions_after(impressions, conversions, days, space, most)
    lag = F.floor((F.unix_micros("conversion_ts") - F.unix_micros("ts")) / F.lit(DAY_MICROS))
    by = ["advertiser_domain", "pixel_name", "lag_days"]
    of_person = found.groupBy(*by[:2], lag.alias("lag_days"), "user_pwid_raw").agg(
        F.sum(F.col("match_copies") * F.col("conversion_copies")).alias("pairs")
    )
    return of_person.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("people"))


CAMPAIGN = ("date", "campaign_id", "line_item_id", "opportunity_name", "io_number", "browser_name")
_ROLLUP = (
    "impressions",
    "beeswax_clicks",
    "tracker_clicks",
    "tracker_click_impressions",
    "conversions",
    "pv_conversions_7d",
    "pv_conversions_30d",
    "pc_conversions_7d",
    "pc_conversions_30d",
    "beeswax_click_conversions",
    "tracker_click_conversions",
    "bid_gross_usd",
)
_COUNTED = tuple(c for c in _ROLLUP if c not in ("tracker_clicks", "bid_gross_usd"))


def _sum_parts(parts: Sequence[DataFrame], by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Add up frames that each hold some of the measures per group."""
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def _finish_rollup(parts: Sequence[DataFrame]) -> DataFrame:
    total = _sum_parts(parts, CAMPAIGN, _ROLLUP)
    filled = [F.coalesce(c, F.lit(0)).alias(c) if c in _COUNTED else F.col(c) for c in _ROLLUP[:-1]]
    return total.select(*CAMPAIGN, *filled, (F.col("bid_gross_usd") / 1000).alias("bid_gross_usd")).orderBy("date")


def campaign_rollup(mapping: DataFrame) -> DataFrame:
    """Impressions, clicks, conversions and spend per day and campaign, from the mapping.

    Distinct counts are taken after one row per impression and per conversion is formed,
    instead of one distinct aggregate per column.
    """
    per_impression = mapping.groupBy(*CAMPAIGN, "impression_primary_key").agg(
        F.max("is_beeswax_click").alias("b"),
        F.max("is_tracker_click").alias("t"),
        F.sum(F.when(F.col("is_first_row"), F.col("tracker_click"))).alias("tracker_clicks"),
        F.sum(F.when(F.col("is_first_row"), F.col("bid_gross_usd"))).alias("bid_gross_usd"),
    )
    shown = per_impression.groupBy(*CAMPAIGN).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if("b").alias("beeswax_clicks"),
        F.count_if("t").alias("tracker_click_impressions"),
        F.sum("tracker_clicks").alias("tracker_clicks"),
        F.sum("bid_gross_usd").alias("bid_gross_usd"),
    )
    after_click = F.when(F.col("is_tracker_click"), F.col("days_since_impression"))
    per_conversion = (
        mapping.filter(F.col("conversion_primary_key").isNotNull())
        .groupBy(*CAMPAIGN, "conversion_primary_key")
        .agg(
            F.max("conversion_copies").alias("n"),
            F.min("days_since_impression").alias("days"),
            F.min(after_click).alias("click_days"),
            F.max("is_beeswax_click_conversion").alias("b"),
            F.max("is_tracker_click_conversion").alias("t"),
        )
    )

    def counted(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))

    converted = per_conversion.groupBy(*CAMPAIGN).agg(
        F.sum("n").alias("conversions"),
        counted(F.col("days") <= 7).alias("pv_conversions_7d"),
        counted(F.col("days") <= 30).alias("pv_conversions_30d"),
        counted(F.col("click_days") <= 7).alias("pc_conversions_7d"),
        counted(F.col("click_days") <= 30).alias("pc_conversions_30d"),
        counted(F.col("b")).alias("beeswax_click_conversions"),
        counted(F.col("t")).alias("tracker_click_conversions"),
    )
    return _finish_rollup([shown, converted])


def campaign_report(events: DataFrame) -> DataFrame:
    """``campaign_rollup`` of the 30-day mapping, without building the mapping.

    Within one person, advertiser and campaign day, a conversion is reached by some
    impression exactly when it lies between the first impression and the end of the last
    impression's window, because all of them fall on one day. So each such group asks for
    conversion counts in time ranges, read off running counts.
    """
    impressions = events.filter(F.col("ad_id").isNotNull()).withColumn("date", F.to_date("ts"))
    conversions = _conversions(events)
    key = ("ts", "ad_id", "creative_id")
    per_key = impressions.groupBy(*CAMPAIGN, *key).agg(
        F.max(F.coalesce(F.col("beeswax_clicks") > 0, F.lit(False))).alias("b"),
        F.max(F.coalesce(F.col("tracker_click") > 0, F.lit(False))).alias("t"),
    )
    shown = per_key.groupBy(*CAMPAIGN).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if("b").alias("beeswax_clicks"),
        F.count_if("t").alias("tracker_click_impressions"),
    )
    order = F.struct(*["ts" if c == "impression_ts" else c for c in _FIRST_ORDER])
    first = (
        impressions.groupBy(*_FIRST_OF)
        .agg(F.min(order).alias("first_row"))
        .select("date", "first_row.*")
        .groupBy(*CAMPAIGN)
        .agg(F.sum("tracker_click").alias("tracker_clicks"), F.sum("bid_gross_usd").alias("bid_gross_usd"))
    )

    # Impression rows of one instant, ad and creative share their matches.
    people = _matchable(impressions.select(*_MATCH, *key), conversions).distinct()
    at = F.unix_micros("ts")
    spans = (
        join_null_safe(people, per_key, key, "inner")
        .groupBy(*CAMPAIGN, *_MATCH)
        .agg(
            F.min(at).alias("first"),
            F.max(at).alias("last"),
            F.min(F.when(F.col("t"), at)).alias("first_t"),
            F.max(F.when(F.col("t"), at)).alias("last_t"),
            F.min(F.when(F.col("b"), at)).alias("first_b"),
            F.max(F.when(F.col("b"), at)).alias("last_b"),
        )
    )

    def window_end(last: str) -> Column:
        return F.col(last) + F.lit(30 * DAY_MICROS + 1)

    def seven_days_end(last: str) -> Column:
        # At most 168 hour boundaries after the last impression.
        hour = F.floor(F.col(last) / F.lit(HOUR_MICROS))
        return (hour + F.lit(7 * 24 + 1)) * F.lit(HOUR_MICROS)

    ranges = {
        "conversions": ("first", window_end("last")),
        "pv_conversions_7d": ("first", seven_days_end("last")),
        "pc_conversions_30d": ("first_t", window_end("last_t")),
        "pc_conversions_7d": ("first_t", seven_days_end("last_t")),
        "beeswax_click_conversions": ("first_b", window_end("last_b")),
    }
    ends = []
    for name, (start, end) in ranges.items():
        ends.append(F.struct(F.lit(name).alias("measure"), F.lit(-1).alias("sign"), F.col(start).alias("at")))
        ends.append(F.struct(F.lit(name).alias("measure"), F.lit(1).alias("sign"), end.alias("at")))
    asked = (
        spans.select(*CAMPAIGN, *_MATCH, F.inline(F.array(*ends)))
        .filter(F.col("at").isNotNull())
    )
    points = conversions.filter(F.col("user_pwid_raw").isNotNull() & F.col("advertiser_domain").isNotNull()).select(
        *_MATCH, F.unix_micros("conversion_ts").alias("at"), F.col("conversion_copies").alias("n")
    )
    answered = count_before(asked, points, _MATCH)
    measured = {
        name: F.sum(F.when(F.col("measure") == name, F.col("sign") * F.col("n_before"))) for name in ranges
    }
    converted = (
        answered.groupBy(*CAMPAIGN)
        .agg(*[c.alias(name) for name, c in measured.items()])
        .withColumns(
            {
                "pv_conversions_30d": F.col("conversions"),
                "tracker_click_conversions": F.col("pc_conversions_30d"),
            }
        )
    )
    return _finish_rollup([shown, first, converted])


def first_touch_report(events: DataFrame) -> DataFrame:
    """Impressions and conversions per campaign; the earliest impression takes each.

    A conversion goes to the earliest impression of the day, and of the week, before it.
    Equal conversions count once. Among impressions of one instant the smallest browser,
    device, campaign and opportunity is taken.
    """
    by = ("browser_name", "device_type", "advertiser_domain", "campaign_id", "opportunity_name", "impression_date")
    named = events.filter(F.col("advertiser_domain") != "")
    impressions = named.filter(F.col("impression") > 0).withColumn("impression_date", F.to_date("ts"))
    shown = (
        impressions.select(*dict.fromkeys([*by, *_PERSON, "ts"]))
        .distinct()
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("impressions"))
    )
    with_person = F.col("user_pwid_raw").isNotNull()
    payload = ("browser_name", "device_type", "campaign_id", "opportunity_name")
    conversions = (
        named.filter((F.col("conversion") > 0) & with_person)
        .select(*_MATCH, F.unix_micros("ts").alias("conversion_at"))
        .distinct()
    )
    touches = _matchable(impressions, conversions).select(*_MATCH, F.unix_micros("ts").alias("at"), *payload)
    windows = {"conversions_attributed_day": 1, "conversions_attributed_week": 7}
    tries = conversions.select(
        *_MATCH,
        "conversion_at",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("window"), (F.col("conversion_at") - F.lit(days * DAY_MICROS)).alias("at")
                    )
                    for name, days in windows.items()
                ]
            )
        ),
    )
    attributed = (
        first_at_or_after(tries, touches, _MATCH, payload)
        .filter(F.col("hit.at") <= F.col("conversion_at"))
        .select(
            "advertiser_domain",
            *[F.col(f"hit.{c}").alias(c) for c in payload],
            F.to_date(F.timestamp_micros("hit.at")).alias("impression_date"),
            "window",
        )
        .groupBy(*by)
        .agg(*[F.count_if(F.col("window") == name).alias(name) for name in windows])
    )
    total = _sum_parts([shown, attributed], by, ["impressions", *windows])
    return total.select(*by, "impressions", *[F.nullif(name, F.lit(0)).alias(name) for name in windows])
