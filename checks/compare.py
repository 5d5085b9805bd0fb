"""Compare registered queries with their SQL on a data folder.

python -m checks.compare FOLDER [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks import oracles
from checks.queries import registered


def _value(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return value


def _bag(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return Counter(tuple(_value(row[at]) for at in order) for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


def compare(spark: SparkSession, base: duckdb.DuckDBPyConnection, folder: str, name: str) -> str:
    return difference(registered()[name](spark, folder), base, name)


def difference(result: DataFrame, base: duckdb.DuckDBPyConnection, name: str) -> str:
    """Empty when the result holds the rows its SQL gives, else what differs."""
    found = _bag(result.columns, [tuple(r) for r in result.collect()])
    answer = base.execute(oracles.all_sql()[name])
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(result.columns):
        return f"columns differ: {sorted(set(names) ^ set(result.columns))}"
    expected = _bag(names, answer.fetchall())
    if found == expected:
        return ""
    extra, missing = found - expected, expected - found
    return (
        f"{sum(found.values())} rows, {sum(expected.values())} expected; columns {sorted(names)}\n"
        f"  extra {sum(extra.values())}: {list(extra)[:2]}\n  missing {sum(missing.values())}: {list(missing)[:2]}"
    )


def main(folder: str, only: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = connect(folder)
    failed = 0
    for name in registered():
        if (only and name not in only) or name not in oracles.all_sql():
            continue
        start = time.time()
        try:
            found = compare(spark, base, folder, name)
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(found)
        print(f"{name:36s} {'DIFFERS' if found else 'ok'} {time.time() - start:.1f}s", flush=True)
        if found:
            print("  " + found[:3000], flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
