"""Only the files that are asked for are opened: those of other days or blocks are no parquet at all."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adlytics.operators import delivery
from adlytics.params import Period
from adlytics.plans import reports
from adlytics.sources.derived import COUNTRY, CREATIVE_CHARACTERS, PIXELS, Derived
from adlytics.sources.tables import ParquetTables, partition_days, sample_blocks, save_table
from adlytics.workspace import Workspace
from checks.queries import STORED_BY, stored_by_day
from helpers import rows_of

FOLDER = "/root/testdata/sf0.001"
DAYS = Period(date(2024, 1, 10), date(2024, 1, 12))


def spoil(folder):
    """Replace every parquet file below a folder by text."""
    files = sorted(Path(folder).rglob("*.parquet"))
    for file in files:
        file.write_text("no parquet")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    return len(files)


@pytest.fixture(scope="module")
def derived(spark):
    return Derived(spark, FOLDER)


@pytest.fixture(scope="module")
def tables(spark, derived, tmp_path_factory):
    """Stored tables in which only the files of DAYS can be read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    found = stored_by_day(derived, folder)
    save_table(derived.line_items(), f"{folder}/line_items")
    for kind, rows in derived.id_mapping().items():
        save_table(rows.repartition("date"), f"{folder}/id_mapping/{kind}", ["date"])
    spoiled = 0
    for name in [*STORED_BY, *[f"id_mapping/{kind}" for kind in derived.id_mapping()]]:
        for day in Path(folder, name).glob("*=*"):
            if not DAYS.start <= date.fromisoformat(day.name.split("=")[1]) <= DAYS.end:
                spoiled += spoil(day)
    assert spoiled > 150
    return found


REPORTS = {
    "seats": lambda space, t: delivery.seat_delivery_report(t.scan("bidstream", DAYS)),
    "impressions": lambda space, t: reports.impressions_and_conversions(t, PIXELS, DAYS, DAYS, DAYS, COUNTRY)[0],
    "conversions": lambda space, t: reports.impressions_and_conversions(t, PIXELS, DAYS, DAYS, DAYS, COUNTRY)[1],
    "device_match": lambda space, t: reports.device_match(space, t, PIXELS, DAYS),
    "utm_conversions": lambda space, t: reports.utm_conversions(space, t, PIXELS, DAYS, DAYS, DAYS, COUNTRY),
    "overlap": lambda space, t: reports.overlap_report(space, t, PIXELS, DAYS, DAYS, COUNTRY),
    "placed_seats": lambda space, t: reports.placed_seats(space, t, DAYS, DAYS, DAYS, COUNTRY)[0],
    "cascade_people": lambda space, t: reports.cascade_people(space, t, DAYS, DAYS, DAYS, COUNTRY),
    "root_events": lambda space, t: reports.root_events(t, DAYS, DAYS, CREATIVE_CHARACTERS),
    "nested_root": lambda space, t: reports.nested_root(space, t, DAYS, DAYS, CREATIVE_CHARACTERS),
    "pixel_matches": lambda space, t: reports.pixel_matches(t, DAYS),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_opens_its_days_only(spark, derived, tables, name):
    with Workspace(spark) as space:
        expected = rows_of(REPORTS[name](space, derived))
        assert expected
        assert rows_of(REPORTS[name](space, tables)) == expected


def test_scan_keeps_the_declared_columns(derived, tables):
    assert sorted(tables.scan("bidstream", DAYS).columns) == sorted(derived.bidstream().columns)
    with pytest.raises(Exception, match="is not a Parquet file|CANNOT_READ_FILE_FOOTER"):
        tables.scan("bidstream", Period(DAYS.start - timedelta(days=1), DAYS.end)).collect()


def test_listing_reads_no_column(spark, tmp_path):
    folder = f"{tmp_path}/log"
    rows = spark.range(5_000).select("id", F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 7).cast("int")).alias("day"))
    rows = rows.withColumn("ts", F.col("day").cast("timestamp"))
    expected = rows_of(partition_days(rows))
    stored = save_table(rows, folder, ["day"])
    listing = partition_days(stored, partition="day")
    for file in Path(folder).rglob("*.parquet"):  # leave the footer, spoil the pages
        content = bytearray(file.read_bytes())
        pages = len(content) - 8 - int.from_bytes(content[-8:-4], "little")
        content[4:pages] = bytes(pages - 4)
        file.write_bytes(content)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert rows_of(listing) == expected and len(expected) == 7
    with pytest.raises(Exception):
        spark.read.parquet(folder).agg(F.sum("id")).collect()


@pytest.fixture
def blocks(spark, tmp_path):
    folder = f"{tmp_path}/facts"
    rows = spark.range(20_000).select("id", (F.col("id") % 40).alias("part"))
    save_table(rows.repartition(40, "part"), folder, ["part"])
    return folder, rows


@pytest.mark.parametrize("whole_folders", [False, True])
def test_blocks_that_are_not_chosen_stay_closed(spark, blocks, whole_folders):
    folder, rows = blocks
    chosen = sample_blocks(spark.read.schema(rows.schema).parquet(folder), folder, 0.3, 1, whole_folders)
    found = rows_of(chosen)
    parts = {r[1] for r in found}
    assert 4 <= len(parts) <= 20
    assert len(found) == 500 * len(parts)  # blocks are whole
    for part in set(range(40)) - parts:
        assert spoil(f"{folder}/part={part}")
    again = sample_blocks(spark.read.schema(rows.schema).parquet(folder), folder, 0.3, 1, whole_folders)
    assert rows_of(again) == found
    with pytest.raises(Exception):
        sample_blocks(spark.read.schema(rows.schema).parquet(folder), folder, 0.3, 2, whole_folders).collect()


def test_blocks_do_not_depend_on_the_writer(spark, blocks, tmp_path):
    folder, rows = blocks
    other = f"{tmp_path}/copy/facts"
    save_table(spark.read.schema(rows.schema).parquet(folder).repartition(40, "part"), other, ["part"])
    pick = lambda place, share: rows_of(sample_blocks(spark.read.schema(rows.schema).parquet(place), place, share, 4))
    assert pick(other, 0.4) == pick(folder, 0.4)
    assert pick(folder, 0.0) == [] and len(pick(folder, 1.0)) == 20_000
    assert set(pick(folder, 0.2)) <= set(pick(folder, 0.4))


def test_sample_of_a_partitioned_table(spark, tables):
    """The partition column is not part of what a sample gives."""
    few = tables.sample("ip_prefix", 1.0)
    assert few.columns == ParquetTables(spark, tables.folder).read("ip_prefix").columns


def test_a_large_day_is_stored_by_several_tasks(spark, tmp_path):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        derived = Derived(spark, FOLDER)
        stored = stored_by_day(derived, str(tmp_path), ("win_log",)).read("win_log")
        assert rows_of(stored.drop("day")) == rows_of(derived.win_log())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    days = [day for day in (tmp_path / "win_log").iterdir() if day.name.startswith("day=")]
    assert len(days) == 30 and any(len(list(day.glob("*.parquet"))) > 1 for day in days)
