"""CSV exports written by the executors, in parallel.

No export goes through the driver or a single task; a single CSV object is the
concatenation, in name order, of the part files of one write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART_ROWS = 1_000_000
RANK_BUCKETS = 4096
# Headers of the written manifest. Fixed values.
MANIFEST_HEADERS = {"export_date": "Date", "partition": "Partition", "filename": "Filename", "row_count": "Row Count"}
_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text_columns(rows: DataFrame) -> list[Column]:
    """Timestamps as plain text, everything else as it is."""
    return [
        F.date_format(name, _TS_FORMAT).alias(name) if kind == "timestamp" else F.col(name)
        for name, kind in rows.dtypes
    ]


def export_ordered_csv(rows: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """Globally ordered CSV: the files, taken in name order, hold the rows in order, without headers.

    Ties are broken by the other columns, so one instant holding most rows is still dealt over
    several files.
    """
    ordered = rows.orderBy(*_total_order(rows, order_by)).select(*_text_columns(rows))
    ordered.write.mode("overwrite").csv(path, header=False)


def _total_order(rows: DataFrame, order_by: Sequence[str]) -> list[str]:
    return [*order_by, *[c for c in rows.columns if c not in order_by]]


def export_single_header_csv(rows: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """CSV text whose files concatenate, in name order, to one file with one header.

    The header is a row of its own that sorts before all others.
    """
    names, order = rows.columns, _total_order(rows, order_by)
    header = ",".join(names)
    lines = rows.select(
        F.lit(1).alias("after_header"), *order, F.to_csv(F.struct(*_text_columns(rows))).alias("line")
    )
    first = (
        rows.sparkSession.range(1)
        .select(F.lit(0).alias("after_header"), F.lit(header).alias("line"))
        .select("after_header", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], "line")
    )
    ordered = first.unionByName(lines).orderBy("after_header", *order)
    ordered.select("line").write.mode("overwrite").text(path)


def _date_text(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def _file_name(prefix: str, day: Column, part: Column, parts: Column) -> Column:
    return F.concat(
        F.lit(f"{prefix}_"), _date_text(day), F.lit("_part"), part.cast("string"), F.lit("of"),
        parts.cast("string"), F.lit(".csv"),
    )


def export_manifest(rows: DataFrame, prefix: str, part_rows: int = PART_ROWS, ts: str = "ts") -> DataFrame:
    """Day, partition, file name and row count of every export part."""
    limit = F.lit(part_rows)
    days = rows.groupBy(F.to_date(ts).alias("export_date")).agg(F.count(F.lit(1)).alias("total"))
    parts = F.ceil(F.col("total") / limit).cast("bigint")
    listed = days.withColumn("parts", parts).withColumn(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("parts")))
    )
    start = (F.col("part") - 1) * limit
    return listed.select(
        "export_date",
        F.concat(F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string")).alias("partition"),
        _file_name(prefix, F.col("export_date"), F.col("part"), F.col("parts")).alias("filename"),
        (F.least(F.col("part") * limit, F.col("total")) - start).alias("row_count"),
    ).orderBy("export_date", "filename")


def export_parts(rows: DataFrame, prefix: str, part_rows: int = PART_ROWS, ts: str = "ts") -> DataFrame:
    """Rows with the file each belongs to; every part but a day's last is full.

    Rows are numbered without sorting a day in one task: equal rows are counted once, a
    hash spreads them over buckets, and a bucket's first number comes from the sizes of
    the buckets before it. The numbering depends on the rows alone, so a recomputed task
    gives the same files.
    """
    columns = rows.columns
    limit = F.lit(part_rows)
    counted = (
        rows.groupBy(F.to_date(ts).alias("export_date"), *columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(RANK_BUCKETS)))
    )
    before = W.partitionBy("export_date").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole_day = W.partitionBy("export_date")
    sizes = (
        counted.groupBy("export_date", "bucket")
        .agg(F.sum("n").alias("size"))
        .withColumns({"bucket_start": F.coalesce(F.sum("size").over(before), F.lit(0)), "total": F.sum("size").over(whole_day)})
        .drop("size")
    )
    earlier = W.partitionBy("export_date", "bucket").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        counted.withColumn("in_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(sizes, ["export_date", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("in_bucket"))
    )
    first_part = F.floor(F.col("start") / limit)
    last_part = F.floor((F.col("start") + F.col("n") - 1) / limit)
    pieces = ranked.withColumn("part", F.explode(F.sequence(first_part, last_part)))
    low = F.greatest(F.col("start"), F.col("part") * limit)
    high = F.least(F.col("start") + F.col("n"), (F.col("part") + 1) * limit)
    parts = F.ceil(F.col("total") / limit).cast("bigint")
    return (
        pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), high - low)))
        .withColumn("filename", _file_name(prefix, F.col("export_date"), F.col("part") + 1, parts))
        .select("filename", *columns)
    )


def export_daily_csv(
    rows: DataFrame, path: str, prefix: str, part_rows: int = PART_ROWS, ts: str = "ts"
) -> None:
    """Write each part as CSV under ``filename=<name>/`` and the manifest under ``INDEX.csv``."""
    parts = export_parts(rows, prefix, part_rows, ts)
    text = parts.select("filename", *_text_columns(rows))
    text.repartition("filename").write.mode("overwrite").partitionBy("filename").csv(f"{path}/parts", header=True)
    manifest = export_manifest(rows, prefix, part_rows, ts).withColumnsRenamed(MANIFEST_HEADERS)
    manifest.coalesce(1).write.mode("overwrite").csv(f"{path}/INDEX.csv", header=True)
