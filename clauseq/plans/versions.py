"""What the sinks do to a keyed table, as DataFrames of its next state, and a folder of versions to keep it in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the greatest by the other columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows take the place of those with their key."""
    new = _once(new, key)
    return current.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def insert_absent(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows are added where their key is not there yet."""
    new = _once(new, key)
    return current.unionByName(new.join(current.select(*key), key, "left_anti").select(*current.columns))


def increment(current: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    """The counts of new are added to those with their key."""
    return current.select(*key, count).unionByName(new.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def delete(current: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return current.join(ids.select(*key).distinct(), key, "left_anti").select(*current.columns)


class VersionedTable:
    """A folder with a sub-folder for each version; the last complete one is the table. A failed write leaves the table as it was, and a rerun goes on from there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")

    def versions(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def rows(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.folder}/{done[-1]}") if done else None

    def write(self, rows: DataFrame) -> None:
        done = self.versions()
        rows.write.parquet(f"{self.folder}/v{len(done) and int(done[-1][1:9]) + 1:08d}-{uuid.uuid4().hex[:8]}")

    def clear(self) -> None:
        self.write(self.rows().limit(0))
