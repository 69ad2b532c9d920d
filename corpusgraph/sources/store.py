"""Versioned tables on any Hadoop file system: a new version is written whole, then named current.

A table that is being read is never overwritten; readers keep the version that they began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        """Versions whose write was committed, in order."""
        fs, p = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{table}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self.versions(table)
        if not known:
            raise LookupError(table)
        return self.spark.read.parquet(f"{self.path}/{table}/v{version or known[-1]}")

    def write(self, table: str, df: DataFrame, sort_by: str | None = None, keep: int = 2) -> int:
        """Writes a new version, sorted within files so that their statistics prune, and drops old ones."""
        known = self.versions(table)
        version = (known[-1] if known else 0) + 1
        own = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by) if sort_by else df
        own.write.mode("overwrite").parquet(f"{self.path}/{table}/v{version}")
        for old in [*known, version][:-keep]:
            fs, p = self._fs(f"{self.path}/{table}/v{old}")
            fs.delete(p, True)
        return version
