"""Tables kept by day against tables built whole."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adlytics.params import Period
from adlytics.plans import reports
from adlytics.sources.daily import DailyTable
from adlytics.sources.derived import CREATIVE_CHARACTERS, Derived
from adlytics.sources.tables import ParquetTables, save_table
from adlytics.workspace import Workspace
from checks.queries import stored_by_day
from helpers import rows_of

FOLDER = "/root/testdata/sf0.001"
JANUARY = Period(date(2024, 1, 1), date(2024, 1, 6))


def day(n):
    return date(2024, 1, n)


class Log(ParquetTables):
    """A log by day and a lookup without days, of free schemas."""

    def read(self, table):
        return self.spark.read.parquet(f"{self.folder}/{table}")


@pytest.fixture
def log(spark, tmp_path):
    save_table(numbers(spark, range(1, 7), 1), f"{tmp_path}/log", ["day"])
    save_table(spark.createDataFrame([(0, "even"), (1, "odd")], "k long, name string"), f"{tmp_path}/names")
    return Log(spark, str(tmp_path), partitions={"log": "day"})


def numbers(spark, days, times):
    rows = [(n, n * times * 10 + k, day(n)) for n in days for k in range(5)]
    return spark.createDataFrame(rows, "n long, v long, day date").repartition("day")


def daily(log, tmp_path, settings="", seen=None):
    def build(days):
        if seen is not None:
            seen.append((days.start, days.end))
        rows = log.read("log").filter(days.covers_date(F.col("day")) & (F.col("n") != 4))
        return rows.join(log.read("names"), F.col("v") % 2 == F.col("k")).select(F.col("day").alias("date"), "v", "name")

    return DailyTable(log, f"{tmp_path}/kept", build, {"log": 0}, {"names": None}, settings)


def test_only_changed_days_are_built(spark, log, tmp_path):
    table = daily(log, tmp_path)
    with pytest.raises(ValueError, match="not built"):
        table.read(JANUARY)
    assert table.refresh(Period(day(2), day(3))) == [day(2), day(3)]
    assert table.refresh(JANUARY) == [day(1), day(4), day(5), day(6)]
    assert table.refresh(JANUARY) == []
    whole = rows_of(table.build(JANUARY), "date", "v", "name")
    assert rows_of(table.read(JANUARY), "date", "v", "name") == whole and len(whole) == 25  # the 4th has no rows

    # A changed day is built again, alone; nothing of the old one stays.
    numbers(spark, [5], 3).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{log.folder}/log")
    assert table.refresh(JANUARY) == [day(5)]
    assert rows_of(table.read(JANUARY), "date", "v", "name") == rows_of(table.build(JANUARY), "date", "v", "name") != whole
    assert table.refresh(Period(day(6), day(7))) == [day(7)]  # a day without input has no rows

    # A changed lookup or setting changes every day.
    save_table(spark.createDataFrame([(0, "EVEN"), (1, "odd")], "k long, name string"), f"{log.folder}/names")
    assert table.refresh(JANUARY) == [day(n) for n in range(1, 7)]
    assert {r[0] for r in rows_of(table.read(JANUARY), "name")} == {"EVEN", "odd"}
    assert daily(log, tmp_path, "other").refresh(Period(day(1), day(1))) == [day(1)]


def test_emptied_day_loses_its_rows(spark, log, tmp_path):
    table = daily(log, tmp_path)
    table.refresh(JANUARY)
    for file in Path(log.folder, "log", f"day={day(2)}").glob("*"):
        file.write_bytes(b"") if file.suffix == ".crc" else file.unlink()
    assert table.refresh(JANUARY) == [day(2)]
    assert day(2) not in {r[0] for r in rows_of(table.read(JANUARY), "date")}


def test_failed_build_leaves_days_to_be_built_again(spark, log, tmp_path):
    table, seen = daily(log, tmp_path), []
    table.refresh(Period(day(1), day(2)))
    numbers(spark, [2], 7).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{log.folder}/log")
    good, table.build = table.build, lambda days: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.refresh(JANUARY)
    with pytest.raises(ValueError):
        table.read(Period(day(1), day(2)))
    table = daily(log, tmp_path, seen=seen)
    assert table.refresh(JANUARY) == [day(n) for n in range(2, 7)] and seen == [(day(2), day(6))]
    assert rows_of(table.read(JANUARY), "v") == rows_of(good(JANUARY), "v")


def test_root_by_day_equals_the_whole_root(spark, tmp_path):
    derived, days = Derived(spark, FOLDER), Period(day(9), day(14))
    tables = stored_by_day(derived, str(tmp_path / "tables"), ("pages", "win_log", "attention", "site_sessions", "ip_prefix"))
    save_table(derived.line_items(), f"{tables.folder}/line_items")
    # A session that goes on after midnight: its clicks and conversions belong to the next day.
    late = derived.site_sessions().withColumn(
        "date", F.when(F.hash("site_user_id", "site_pages") % 3 == 0, F.date_sub("date", 1)).otherwise(F.col("date"))
    )
    save_table(late.repartition("date"), f"{tables.folder}/site_sessions", ["date"])
    lookup = Period(day(12), day(12))
    root = reports.daily_root(tables, str(tmp_path / "root"), lookup, CREATIVE_CHARACTERS)
    for part in (Period(day(11), day(11)), Period(day(9), day(12)), days):
        root.refresh(part)
    whole = reports.root_events(tables, days, lookup, CREATIVE_CHARACTERS, session_margin=1)
    found = root.read(days)
    assert rows_of(found, *whole.columns) == rows_of(whole)
    assert found.filter("conversion is not null").count() > 0 and found.filter("delivery.tracker_click > 0").count() > 0
    assert root.refresh(days) == []
    with Workspace(spark):
        assert rows_of(reports.campaign_attribution(found)) == rows_of(reports.campaign_attribution(whole))
