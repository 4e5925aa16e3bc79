"""Counters over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseq.plans.versions import VersionedTable, increment


def daily_counters(events: DataFrame, bucket: str, late: str = "25 hours") -> DataFrame:
    """bucket, day, used: events of a bucket and day (column ts). On a stream, state of days older than `late` is let go, and later rows of them are dropped."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(bucket, day.alias("w")).agg(F.count(F.lit(1)).alias("used")).select(bucket, F.to_date("w.start").alias("day"), "used")


def rolling_reports(events: DataFrame, bucket: str, late: str = "1 day") -> DataFrame:
    """bucket, until, n: events of the seven days up to each day."""
    w = F.window("ts", "7 days", "1 day")
    return events.withWatermark("ts", late).groupBy(bucket, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(bucket, F.to_date("w.end").alias("until"), "n")


def keep_counters(events: DataFrame, key: list[str], table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Adds each batch's counts to a stored table and ends with the input; a restart goes on where the checkpoint stands.

    A batch that was written before a failure is known by its number and not added again.
    """

    def add(batch: DataFrame, n: int) -> None:
        done = table.rows()
        if done is not None and not done.where(F.col("batch") >= n).isEmpty():
            return
        new = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("used"))
        table.write((new if done is None else increment(done, new, key, "used")).withColumn("batch", F.lit(n).cast("long")))

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
