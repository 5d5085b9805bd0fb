"""Derived tables kept by day: only days whose inputs changed are built again."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlytics.params import Period
from adlytics.sources.tables import ParquetTables


class DailyTable:
    """A table with a ``date`` column, stored by day below ``path/data``, with a record per day below ``path/record``.

    ``build`` gives the rows of a period; the rows of a day must be the same whatever period they are
    built in. ``inputs`` names the partitioned tables it reads, with the number of days before and
    after a day whose files count for it, too. ``lookups`` names tables whose files count for every
    day: those of a period, or all. ``settings`` names all else the rows depend on. A day's record
    holds a hash of the names, sizes and times of its input files and of the settings.

    A record is removed before its day is written and put back after, so a run that fails leaves
    days to be built again, never wrong ones. One writer at a time.
    """

    def __init__(
        self,
        tables: ParquetTables,
        path: str,
        build: Callable[[Period], DataFrame],
        inputs: Mapping[str, int],
        lookups: Mapping[str, Period | None] | None = None,
        settings: str = "",
    ):
        self.tables, self.spark, self.build = tables, tables.spark, build
        self.inputs, self.lookups, self.settings = dict(inputs), dict(lookups or {}), settings
        self.root = path.rstrip("/")

    def _path(self, part: str, day: date | None = None):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}" + (f"/date={day}" if day else ""))

    def _exists(self, part: str) -> bool:
        path = self._path(part)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _remove(self, part: str, day: date) -> None:
        path = self._path(part, day)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def states(self, days: Period) -> dict[date, int]:
        """Per day, a hash of all that its rows are made from; one row a day comes to the driver."""
        wanted = self.spark.sql(f"SELECT explode(sequence(DATE'{days.start}', DATE'{days.end}')) AS date")
        for name, margin in sorted(self.inputs.items()):
            near = self.tables.files(name).filter(
                F.col("day").between(F.lit(days.start - timedelta(days=margin)), F.lit(days.end + timedelta(days=margin)))
            )
            spread = F.sequence(F.date_sub("day", margin), F.date_add("day", margin))
            state = near.select(F.explode(spread).alias("date"), "*").groupBy("date").agg(_state().alias(name))
            wanted = wanted.join(state, "date", "left")
        looked_up = []
        for name, when in sorted(self.lookups.items()):
            files = self.tables.files(name)
            looked_up.append(F.lit((files if when is None else files.filter(when.covers_date(F.col("day")))).agg(_state()).first()[0]))
        state = F.xxhash64(F.lit(self.settings), *looked_up, *[F.coalesce(F.col(name), F.lit(0)) for name in sorted(self.inputs)])
        return {r["date"]: r["state"] for r in wanted.select("date", state.alias("state")).collect()}

    def built(self, days: Period) -> dict[date, int]:
        """States recorded for the days that are stored."""
        if not self._exists("record"):
            return {}
        record = self.spark.read.schema("state long, date date").parquet(f"{self.root}/record")
        return {r["date"]: r["state"] for r in record.filter(days.covers_date(F.col("date"))).collect()}

    def refresh(self, days: Period) -> list[date]:
        """Build the days that are missing or whose inputs changed; gives these days."""
        states, built = self.states(days), self.built(days)
        stale = sorted(day for day, state in states.items() if built.get(day) != state)
        for day in stale:
            self._remove("record", day)
            self._remove("data", day)  # a day without rows is not overwritten
        for run in _runs(stale):
            rows = self.build(run).filter(run.covers_date(F.col("date"))).hint("rebalance", "date")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/data")
        if stale:
            values = ", ".join(f"(DATE'{day}', {states[day]})" for day in stale)
            record = self.spark.sql(f"SELECT CAST(col2 AS BIGINT) AS state, col1 AS date FROM VALUES {values}")
            record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/record")
        return stale

    def read(self, days: Period) -> DataFrame:
        """Rows of a period; days that were never built are an error. Call ``refresh`` for new inputs."""
        every = {days.start + timedelta(days=k) for k in range((days.end - days.start).days + 1)}
        missing = sorted(every - set(self.built(days)))
        if missing:
            raise ValueError(f"not built: {missing[0]} and {len(missing) - 1} more days of {self.root}")
        form = self.build(days).schema
        return self.spark.read.schema(form).parquet(f"{self.root}/data").filter(days.covers_date(F.col("date")))

    def fresh(self, days: Period) -> DataFrame:
        """Rows of a period, from inputs as they are now."""
        self.refresh(days)
        return self.read(days)


def _state() -> Column:
    """Hash of a set of files, in any order."""
    return F.xxhash64(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.count(F.lit(1)))


def _runs(days: list[date]) -> list[Period]:
    """Sorted days as periods without gaps."""
    found: list[Period] = []
    for day in days:
        if found and day - found[-1].end == timedelta(days=1):
            found[-1] = Period(found[-1].start, day)
        else:
            found.append(Period(day, day))
    return found
