"""Reading input tables and saving intermediate ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from adlytics.params import Period, Window
from adlytics.schemas import prune, schema


def read_table(spark: SparkSession, path: str, table: str, fields: Iterable[str] | None = None) -> DataFrame:
    """Parquet table with its declared schema, cut down to the dotted field paths given."""
    wanted = schema(table)
    return spark.read.schema(prune(wanted, fields) if fields else wanted).parquet(path)


def with_names(table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename a warehouse's columns (key) to the names the operators use (value)."""
    return table.withColumnsRenamed(dict(names))


def scan(
    table: DataFrame, when: Period | Window, ts: str = "ts", country: str | None = None, partition: str | None = None
) -> DataFrame:
    """Rows of a period or clock window, optionally of one country.

    The bounds are literals on the raw column, so they skip row groups. ``partition`` names the
    date column a table is partitioned by; its bounds keep files of other days from being opened.
    """
    rows = table.filter(when.covers_ts(F.col(ts)))
    if partition is not None:
        rows = rows.filter(when.covers_date(F.col(partition)))
    return rows if country is None else rows.filter(F.col("user_country") == country)


def scan_days(table: DataFrame, when: Period | Window, column: str = "date", partition: str | None = None) -> DataFrame:
    """Rows of a period in a table that has its day in a column, which may be the partition itself."""
    rows = table.filter(when.covers_date(F.col(column)))
    return rows if partition in (None, column) else rows.filter(when.covers_date(F.col(partition)))


def _place(name: Column) -> Column:
    """Where a name falls in [0, 1): 32 bits of its md5, the same in any engine."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample_rows(table: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Rows whose key has a hash in the first `fraction` of its range; all from a fraction of 1 on.

    The hash is 32 bits of the md5 of seed and key, so the same rows are taken under any
    partitioning and by any engine. Rows of one key are taken together; a null key is the empty text.
    """
    if fraction >= 1.0:
        return table
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return table.filter(_place(text) < F.lit(fraction))


def block_name(folder: str, whole_folders: bool = False) -> Column:
    """Name of the block a row is stored in: its file below the table's folder.

    A file is named by its partition folders and its part number, without the writer's random
    suffix, so a table that is copied or written again in the same layout has the same blocks. With
    ``whole_folders`` the partition folder is the block.
    """
    inside = F.substring_index(F.col("_metadata.file_path"), f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    if whole_folders:
        return F.regexp_replace(inside, "/?[^/]*$", "")
    return F.regexp_replace(inside, r"(part-\d+)[^/]*$", "$1")


def sample_blocks(table: DataFrame, folder: str, fraction: float, seed: int = 0, whole_folders: bool = False) -> DataFrame:
    """Rows of about `fraction` of a stored table's blocks; all from a fraction of 1 on.

    ``table`` is read from ``folder``. Blocks are chosen by a hash of seed and name, from the list of
    files: those that are not chosen are never opened, so a hundredth of the table costs a
    hundredth of its bytes. Rows of a block are taken together, so a sample is as good as rows are
    dealt over blocks.
    """
    if fraction >= 1.0:
        return table
    return table.filter(_place(F.concat(F.lit(f"{seed}:"), block_name(folder, whole_folders))) < F.lit(fraction))


def partition_days(table: DataFrame, ts: str = "ts", partition: str | None = None) -> DataFrame:
    """Days present with their row counts, in order.

    ``partition`` names the date column a stored table is partitioned by: then folder names and the
    row counts in file footers answer, and no column is read.
    """
    day = F.to_date(ts) if partition is None else F.col(partition)
    days = table.groupBy(day.alias("partition_date")).agg(F.count(F.lit(1)).alias("total"))
    return days.orderBy("partition_date")


def save_table(table: DataFrame, path: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write a table as parquet, replacing it, and return it as read back."""
    table.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


#: Identifier kinds that have a lookup table of their own.
ID_KINDS = ("login_hash", "anonymous_hash", "maid", "pubcid", "site_user")


class ParquetTables:
    """Tables kept as parquet below one folder, each read with the nested fields it is read for.

    ``fields`` names the dotted field paths per table (see ``schemas.BID_FIELDS``); tables without
    an entry are read whole. ``partitions`` names the date column a table is partitioned by.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        fields: Mapping[str, Iterable[str]] | None = None,
        partitions: Mapping[str, str] | None = None,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fields, self.partitions = dict(fields or {}), dict(partitions or {})

    def read(self, table: str) -> DataFrame:
        wanted = schema(table)
        cut = prune(wanted, self.fields[table]) if table in self.fields else wanted
        day = self.partitions.get(table)
        if day and day not in cut.names:
            cut = StructType([*cut.fields, StructField(day, DateType())])
        return self.spark.read.schema(cut).parquet(f"{self.folder}/{table}")

    def _declared(self, table: str, rows: DataFrame) -> DataFrame:
        """Without a partition column that the table's schema does not declare."""
        day = self.partitions.get(table)
        return rows if day is None or day in schema(table).names else rows.drop(day)

    def scan(self, table: str, when: Period | Window, ts: str = "ts", country: str | None = None) -> DataFrame:
        """Rows of a period or clock window; of a partitioned table only the files of its days are opened."""
        return self._declared(table, scan(self.read(table), when, ts, country, self.partitions.get(table)))

    def scan_days(self, table: str, when: Period | Window, column: str = "date") -> DataFrame:
        return self._declared(table, scan_days(self.read(table), when, column, self.partitions.get(table)))

    def sample(self, table: str, fraction: float, seed: int = 0, whole_folders: bool = False) -> DataFrame:
        """About that share of a table's blocks (see ``sample_blocks``)."""
        rows = sample_blocks(self.read(table), f"{self.folder}/{table}", fraction, seed, whole_folders)
        return self._declared(table, rows)

    def days(self, table: str, ts: str = "ts") -> DataFrame:
        """Days present with their row counts; from folders and footers where the table is partitioned."""
        return partition_days(self.read(table), ts, self.partitions.get(table))

    def files(self, table: str) -> DataFrame:
        """Rows (day, path, length, modificationTime) of a table's files, whose content is not read.

        The day is null where the table is not partitioned.
        """
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{table}")
        day = F.col(self.partitions[table]) if table in self.partitions else F.lit(None)
        return found.select(day.cast("date").alias("day"), "path", "length", "modificationTime")

    def bidstream(self) -> DataFrame:
        return self.read("bidstream")

    def site_events(self) -> DataFrame:
        return self.read("site_events")

    def site_sessions(self) -> DataFrame:
        return self.read("site_sessions")

    def pages(self) -> DataFrame:
        return self.read("pages")

    def win_log(self) -> DataFrame:
        return self.read("win_log")

    def attention(self) -> DataFrame:
        return self.read("attention")

    def line_items(self) -> DataFrame:
        return self.read("line_items")

    def ip_prefix(self) -> DataFrame:
        return self.read("ip_prefix")

    def ip_prefix_mapping(self) -> DataFrame:
        return self.read("ip_prefix_mapping")

    def id_mapping(self) -> Mapping[str, DataFrame]:
        """One table per identifier kind, in folders below ``id_mapping``."""
        return {
            kind: self.spark.read.schema(schema("id_mapping")).parquet(f"{self.folder}/id_mapping/{kind}")
            for kind in ID_KINDS
        }
