import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from adlytics.functions import arrays, ip, text, times
from adlytics.schemas import prune, schema
from helpers import ts


def one(spark, column, **values):
    frame = spark.range(1)
    for name, (value, kind) in values.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, medium, source",
    [
        ("https://s.example/?utm_medium=email&utm_source=news", "email", "news"),
        ("https://s.example/?utm_source=news", None, "news"),
        ("https://s.example/?utm_medium=&utm_source=", None, None),
        ("https://s.example/", None, None),
        (None, None, None),
    ],
)
def test_utm(spark, url, medium, source):
    url = (url, "string")
    assert one(spark, text.utm_medium(F.col("u")), u=url) == medium
    assert one(spark, text.utm_source(F.col("u")), u=url) == source


@pytest.mark.parametrize(
    "url, domain",
    [
        ("https://www.shop.example/", "shop.example"),
        ("http://shop.example//", "shop.example"),
        ("shop.example", "shop.example"),
        ("", ""),
    ],
)
def test_bare_domain(spark, url, domain):
    assert one(spark, text.bare_domain(F.col("u")), u=(url, "string")) == domain


def test_strip_leading_is_a_set_of_characters(spark):
    assert one(spark, text.strip_leading(F.col("c"), "abc-"), c=("abc-15003", "string")) == "15003"
    assert one(spark, text.strip_leading(F.col("c"), "abc-"), c=("cab7", "string")) == "7"
    assert one(spark, text.strip_leading(F.col("c"), "abc-"), c=("xab", "string")) == "xab"


def test_part(spark):
    value = ("r1|a2", "string")
    assert one(spark, text.part(F.col("v"), 0), v=value) == "r1"
    assert one(spark, text.part(F.col("v"), 1), v=value) == "a2"
    assert one(spark, text.part(F.col("v"), 2), v=value) is None
    assert one(spark, text.part(F.col("v"), 0), v=("plain", "string")) == "plain"


def test_browser_family(spark):
    names = {"Chrome": "Chrome", "Mobile Chrome": "Chrome", "safari": "Safari", "GSA": "UIWebView", "Opera": "other"}
    for name, family in names.items():
        assert one(spark, text.browser_family(F.col("b")), b=(name, "string")) == family
    assert one(spark, text.browser_family(F.col("b")), b=(None, "string")) == "other"


def test_fingerprint_is_null_with_a_missing_part(spark):
    assert one(spark, text.fingerprint(F.lit("a"), F.lit("b"))) == "ab"
    assert one(spark, text.fingerprint(F.lit("a"), F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "start, end, crossed, hours, days",
    [
        ("2024-01-01T00:59:00", "2024-01-01T01:01:00", 1, 1, 1),
        ("2024-01-01T00:00:00", "2024-01-01T00:00:00", 0, 1, 1),
        ("2024-01-01T00:00:00", "2024-01-01T00:59:59", 0, 1, 1),
        ("2024-01-01T00:00:00", "2024-01-02T00:00:00", 24, 24, 1),
        ("2024-01-01T00:00:00", "2024-01-02T00:00:01", 24, 24, 1),
        ("2024-01-01T00:00:00", "2024-01-02T01:00:00", 25, 25, 2),
        ("2024-01-01T00:30:00", "2024-01-08T00:30:00", 168, 168, 7),
        ("2024-01-01T00:30:00", "2024-01-31T00:30:00", 720, 720, 30),
    ],
)
def test_elapsed(spark, start, end, crossed, hours, days):
    frame = spark.createDataFrame([(ts(start), ts(end))], "a timestamp, b timestamp")
    found = times.hours_at_least_one(F.col("b"), F.col("a"))
    row = frame.select(times.hours_crossed(F.col("b"), F.col("a")), found, times.days_rounded_up(found)).first()
    assert tuple(row) == (crossed, hours, days)


def _expected_address(value):
    if value.count(":") == 0:
        return value
    if value.count(":") > 7:  # beyond the shape test, like "1:2:3:4:5:6:7::"
        return None
    try:
        network = ipaddress.ip_network(f"{value}/64", strict=False)
    except ValueError:
        return None
    return str(network.network_address)


def test_household_address(spark):
    rng = random.Random(3)
    texts = ["1.2.3.4", "999.1.1.1", "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0A::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::"]
    for _ in range(400):
        groups = [rng.choice(["0", "0000", "0db8", "1", "ABCD", "0a0"]) for _ in range(8)]
        full = ":".join(groups)
        texts += [full, str(ipaddress.ip_address(full)).upper(), ipaddress.ip_address(full).exploded]
        cut = rng.randrange(8)
        texts.append(":".join(groups[:cut]) + "::" + ":".join(groups[cut + rng.randrange(1, 4) :]))
    invalid = ["1:2:3", "1::2::3", ":::", "12345::", "g::1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "unknown", "", "1.2.3"]
    frame = spark.createDataFrame([(t,) for t in texts + invalid], "a string")
    found = {r["a"]: r["h"] for r in frame.select("a", ip.household_address(F.col("a")).alias("h")).collect()}
    for value in texts:
        assert found[value] == _expected_address(value), value
    assert {v: found[v] for v in invalid if found[v] is not None} == {}
    assert spark.range(1).select(ip.household_address(F.lit(None).cast("string"))).first()[0] is None


def test_array_reading(spark):
    frame = spark.createDataFrame(
        [(1, [(True, 1.0), (False, 9.0), (None, 5.0)]), (2, [(False, None)]), (3, []), (4, None)],
        "id int, b array<struct<won boolean, net double>>",
    )
    made = F.col("b")
    rows = frame.select(
        "id",
        arrays.max_field(made, "won"),
        arrays.max_field(made, "net", lambda x: x["won"]),
        arrays.true_if_any(made, lambda x: x["net"] > 4),
        arrays.first_field(made, "net"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (1, True, 1.0, True, 1.0),
        (2, False, None, None, None),
        (3, None, None, None, None),
        (4, None, None, None, None),
    ]


def test_distinct_values_of_nothing(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", None)], "k string, v string")
    grouped = frame.groupBy("k").agg(
        arrays.distinct_values(F.col("v")).alias("n"), arrays.distinct_values(F.col("v"), "empty").alias("e")
    )
    assert {r["k"]: (r["n"], r["e"]) for r in grouped.collect()} == {"a": (["x"], ["x"]), "b": (None, [])}


def test_prune_keeps_nested_paths():
    cut = prune(schema("bidstream"), ["ts", "ad.ad_id", "ad.seat.seat_name"])
    assert cut.simpleString() == "struct<ts:timestamp,ad:array<struct<ad_id:string,seat:array<struct<seat_name:string>>>>>"
    with pytest.raises(ValueError):
        prune(schema("bidstream"), ["nothing"])
