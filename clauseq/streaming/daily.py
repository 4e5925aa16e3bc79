"""Daily counters that a stream adds to in a store, a batch at a time, and that are let go after some days."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseq.plans.folders import names_in, remove

#: Fixed value: days after which counters go.
RETENTION = 90


class DailyCounters:
    """A folder of increments, batch=n/day=d, so that a batch writes only the days that it touches, and once only.

    A batch that is run again after a failure replaces what it left, so nothing is
    counted twice. compact() sums batches into sum=n, which from then on stands for all up to n.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str]) -> None:
        self.spark, self.folder, self.key = spark, folder, key

    def _done(self, kind: str) -> list[int]:
        names = [n for n in names_in(self.spark, self.folder) if n.startswith(f"{kind}=")]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in names_in(self.spark, f"{self.folder}/{n}"))

    def _parts(self, upto: int | None = None) -> list[str]:
        """The folders that count: the last sum, and the batches after it."""
        last = max(self._done("sum"), default=-1)
        return ([f"sum={last}"] if last >= 0 else []) + [f"batch={n}" for n in self._done("batch") if n > last and (upto is None or n <= upto)]

    def _write(self, counts: DataFrame, name: str) -> None:
        counts.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/{name}")

    def add(self, events: DataFrame, n: int) -> None:
        """events: the key's columns and ts; rows without ts are of no day. A batch that a sum stands for is left out."""
        if n > max(self._done("sum"), default=-1):
            counts = events.groupBy(*self.key, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))
            self._write(counts.where("day IS NOT NULL"), f"batch={n}")

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """The key, day and used; None before the first count."""
        parts = [f"{self.folder}/{p}" for p in self._parts(upto)]
        parts = [self.spark.read.parquet(p) for p in parts if any(x.startswith("day=") for x in names_in(self.spark, p))]
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy(*self.key, "day").agg(F.sum("used").alias("used"))

    def compact(self, upto: int) -> None:
        """The batches up to `upto`, all done, become one sum. It is complete before any part of it goes."""
        rows = self.rows(upto)
        if rows is not None:
            old = self._parts(upto)
            self._write(rows, f"sum={upto}")
            for name in old:
                if name != f"sum={upto}":
                    remove(self.spark, f"{self.folder}/{name}")

    def retain(self, today: datetime.date, days: int = RETENTION) -> list[str]:
        """Deletes the days that are more than `days` before today, folder by folder, and names them. No row is read."""
        first, gone = today - datetime.timedelta(days=days), set()
        for part in self._parts():
            for name in names_in(self.spark, f"{self.folder}/{part}"):
                if name.startswith("day=") and datetime.date.fromisoformat(name[4:]) < first:
                    remove(self.spark, f"{self.folder}/{part}/{name}")
                    gone.add(name[4:])
        return sorted(gone)

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Adds the batches of a stream and ends with the input; a restart goes on where the checkpoint stands."""
        return events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
