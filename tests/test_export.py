import glob
import hashlib
import math
from collections import Counter
from datetime import timedelta

import pytest

from adlytics.operators import metadata
from adlytics.params import Period, Window
from adlytics.schemas import BID_FIELDS
from adlytics.sources import export
from adlytics.sources.derived import Derived
from adlytics.sources.tables import ParquetTables, partition_days, read_table, sample_rows, save_table, with_names
from adlytics.workspace import Workspace
from datetime import date, time
from pyspark.sql import functions as F
from helpers import rows_of, table, ts

START = ts("2024-01-01T00:00:00")
SIZES = {0: 25, 1: 10, 2: 1}


@pytest.fixture(scope="module")
def audience(spark):
    rows = []
    for day, size in SIZES.items():
        for i in range(size):
            # Half of the first day are copies of one row.
            at = START + timedelta(days=day, minutes=0 if i % 2 else i)
            rows.append({"ts": at, "id_type": "t", "partner_id": "copy" if i % 2 else f"x{i}"})
    return table(spark, "audience", rows)


def lines_of(folder):
    lines = []
    for file in sorted(glob.glob(f"{folder}/part-*")):
        with open(file) as opened:
            lines += opened.read().splitlines()
    return lines


def test_manifest(audience):
    found = rows_of(export.export_manifest(audience, "x", part_rows=10), "partition", "filename", "row_count")
    assert found == [
        ("1/1", "x_20240102_part1of1.csv", 10), ("1/1", "x_20240103_part1of1.csv", 1),
        ("1/3", "x_20240101_part1of3.csv", 10), ("2/3", "x_20240101_part2of3.csv", 10), ("3/3", "x_20240101_part3of3.csv", 5),
    ]


@pytest.mark.parametrize("part_rows", [1, 4, 10, 100])
def test_parts_hold_every_row_once(audience, part_rows):
    parts = export.export_parts(audience, "x", part_rows)
    assert rows_of(parts.drop("filename")) == rows_of(audience)
    manifest = {r["filename"]: r["row_count"] for r in export.export_manifest(audience, "x", part_rows).collect()}
    assert dict(Counter(r["filename"] for r in parts.collect())) == manifest
    assert len(manifest) == sum(math.ceil(size / part_rows) for size in SIZES.values())


def test_daily_files(spark, audience, tmp_path):
    export.export_daily_csv(audience, str(tmp_path), "x", part_rows=10)
    folders = sorted(p.name for p in (tmp_path / "parts").glob("filename=*"))
    assert len(folders) == 5 and folders[0] == "filename=x_20240101_part1of3.csv"
    assert all(len(list((tmp_path / "parts" / f).glob("*.csv"))) == 1 for f in folders)
    index = spark.read.csv(str(tmp_path / "INDEX.csv"), header=True)
    assert index.columns == ["Date", "Partition", "Filename", "Row Count"] and index.count() == 5


def test_ordered_files(audience, tmp_path):
    export.export_ordered_csv(audience, str(tmp_path / "o"), ["ts", "partner_id"])
    lines = lines_of(tmp_path / "o")
    assert lines == sorted(lines) and len(lines) == sum(SIZES.values())


def test_one_instant_is_dealt_over_several_files(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.lit(START).cast("timestamp").alias("ts"), F.lit("t").alias("id_type"), F.lpad(F.col("id").cast("string"), 6, "0").alias("partner_id")
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # these files are far smaller than those it merges
    try:
        export.export_ordered_csv(rows.repartition(4), str(tmp_path / "i"), ["ts"])
    finally:
        spark.conf.set(coalesce, "true")
    sizes = [len(open(f).readlines()) for f in glob.glob(f"{tmp_path}/i/part-*")]
    lines = lines_of(tmp_path / "i")
    assert lines == sorted(lines) and len(lines) == 20_000 and max(sizes) < 12_000


def test_single_header(audience, tmp_path):
    export.export_single_header_csv(audience, str(tmp_path / "s"), ["ts", "partner_id"])
    lines = lines_of(tmp_path / "s")
    assert lines[0] == "ts,id_type,partner_id"
    assert lines[1:] == sorted(lines[1:]) and len(lines) == 1 + sum(SIZES.values())
    assert lines[1].startswith("2024-01-01 00:00:00.000000,t,")


def test_partition_days(audience):
    assert [r["total"] for r in partition_days(audience).collect()] == list(SIZES.values())


def test_saved_tables_and_pruned_reads(spark, audience, tmp_path):
    saved = save_table(audience.withColumnRenamed("partner_id", "theirs"), str(tmp_path / "a"))
    assert rows_of(with_names(saved, {"theirs": "partner_id"})) == rows_of(audience)
    cut = read_table(spark, str(tmp_path / "a"), "audience", ["ts", "id_type"])
    assert cut.columns == ["ts", "id_type"]
    plan = cut.filter(Period(date(2024, 1, 1), date(2024, 1, 1)).covers_ts(cut["ts"]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_pixels_to_line_items(spark):
    page = (START, "conversion", "1", "px", "7", None, None, None)
    sessions = table(spark, "site_sessions", [
        {"date": START.date(), "site_pages": [page, page, page[:1] + ("tracker",) + page[2:], page[:4] + ("none",) + page[5:]]},
        {"date": START.date() + timedelta(days=1), "site_pages": [page]},
    ])
    wins = table(spark, "win_log", [
        {"bid_time_utc": START, "advertiser_id": 7, "campaign_id": "c", "line_item_alt_id": item} for item in ("L", "L", "none", None)
    ])
    items = table(spark, "line_items", [
        {"line_item_id": "L", "start_date": date(2024, 1, d), "end_date": date(2024, 2, d)} for d in (1, 5)
    ])
    day = Period(START.date(), START.date())
    found = metadata.match_pixels_to_line_items(sessions, wins, items, day)
    columns = ("internal_advertiser_id", "line_item_alt_id", "line_item_id", "start_date", "end_date", "number_pixel_events")
    assert rows_of(found, *columns) == sorted([
        ("7", "L", "L", date(2024, 1, 1), date(2024, 2, 5), 8), ("7", "none", None, None, None, 2),
        ("7", None, None, None, None, 2), ("none", None, None, None, None, 1)], key=repr)


def test_sample_depends_on_the_key_alone(spark):
    ids = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("key"), F.col("id"))
    one, other = ({r["id"] for r in sample_rows(rows, 0.1, "key", 3).collect()} for rows in (ids.coalesce(1), ids.repartition(7)))
    expected = {i for i in range(3000) if int(hashlib.md5(f"3:r{i}".encode()).hexdigest()[:8], 16) / 2**32 < 0.1}
    assert one == other == expected
    assert sample_rows(ids, 1.0, "key").count() == 3000
    assert sample_rows(spark.createDataFrame([(None,)], "key string"), 0.0, "key").count() == 0


def test_partitioned_tables_open_only_the_days_asked_for(spark, tmp_path):
    bids = Derived(spark, "/root/testdata/sf0.001").bidstream().withColumn("day", F.to_date("ts"))
    save_table(bids, str(tmp_path / "bidstream"), ["day"])
    tables = ParquetTables(spark, str(tmp_path), {"bidstream": BID_FIELDS["seat_delivery_report"]}, {"bidstream": "day"})
    for when in (Period(date(2024, 1, 3), date(2024, 1, 4)), Window(date(2024, 1, 5), time(6), time(9))):
        rows = tables.scan("bidstream", when)
        assert rows.count() == bids.filter(when.covers_ts(F.col("ts"))).count() > 0
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan and "device_type" not in plan


def test_closed_workspace_leaves_nothing(spark, tmp_path):
    with Workspace(spark, str(tmp_path)) as space:
        built = []
        for _ in range(2):
            kept = space.share("ids", lambda: built.append(1) or spark.range(5))
        assert kept.count() == 5 and built == [1]
        space.save(spark.range(3), "more")
        assert len(list(tmp_path.glob("work-*/*"))) == 2
    assert list(tmp_path.iterdir()) == []
