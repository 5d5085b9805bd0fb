"""Intermediate tables: one owned folder below the shared one, removed on close."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adlytics.session import shared_folder


class Workspace:
    """Writes intermediate tables as parquet and hands back the tables as read again.

    A written table cuts the lineage, survives lost executors and is computed once. The results
    of operators read these tables lazily, so close the workspace after using the results.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.root = f"{(folder or shared_folder(spark)).rstrip('/')}/work-{uuid.uuid4().hex}"
        self._shared: dict[str, DataFrame] = {}
        self._made = 0

    def path(self, name: str) -> str:
        """A new path of this workspace."""
        self._made += 1
        return f"{self.root}/{self._made:04d}-{name}"

    def save(self, table: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def share(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, built and saved at its first use."""
        if name not in self._shared:
            self._shared[name] = self.save(build(), name)
        return self._shared[name]

    def close(self) -> None:
        """Remove every table of this workspace."""
        self._shared.clear()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
