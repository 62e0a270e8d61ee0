"""Versioned Parquet tables in one folder: a new version is complete before it is read, old ones can be removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables under a root that all executors share. A version is a folder v<number>; the highest one with a _SUCCESS
    mark is current, so readers never see half a table and a failed write leaves nothing behind that is read. Rows can be
    added to a version in segments, folders s<version>_<number>, without writing it anew."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def segments(self, name: str, version: int) -> list[int]:
        """Numbers of the complete segments of a version."""
        found = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{name}"))]
        start = f"s{version}_"
        return sorted(int(p.getName()[len(start):]) for p in found if p.getName().startswith(start) and self._fs.exists(self._path(f"{p}/_SUCCESS")))

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version with its segments, or an empty table."""
        versions = self.versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        current = versions[-1]
        more = [f"{self.root}/{name}/s{current}_{n}" for n in self.segments(name, current)]
        return self.spark.read.parquet(f"{self.root}/{name}/v{current}", *more)

    def append(self, name: str, table: DataFrame) -> None:
        """Adds a segment to the current version; without one, the first version is written."""
        versions = self.versions(name)
        if not versions:
            self.write(name, table)
            return
        number = max(self.segments(name, versions[-1]), default=0) + 1
        table.write.mode("overwrite").parquet(f"{self.root}/{name}/s{versions[-1]}_{number}")

    def write(self, name: str, table: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        versions = self.versions(name)
        to = f"{self.root}/{name}/v{(versions[-1] if versions else 0) + 1}"
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(to)
        return self.spark.read.parquet(to)

    def prune(self, name: str, keep: int = 2) -> None:
        for v in self.versions(name)[:-keep]:
            for n in self.segments(name, v):
                self._fs.delete(self._path(f"{self.root}/{name}/s{v}_{n}"), True)
            self._fs.delete(self._path(f"{self.root}/{name}/v{v}"), True)

    def purge(self) -> None:
        self._fs.delete(self._path(self.root), True)
