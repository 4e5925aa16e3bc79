"""Rows as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """The rows of a file or folder; none where it is missing. tolerant: lines that are no JSON of this schema are skipped, else they are an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)
