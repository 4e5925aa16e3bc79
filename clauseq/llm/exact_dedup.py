"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.staging import staged, unstage

#: Fixed by the contract: what counts as white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Batches in which rows without a prior index go through it, by ranges of doc_id.
BATCHES = 4
#: A text with more than this share of the rows is joined apart; there are fewer than 1 / HOT of them.
HOT = 1e-3
#: Rows that share doc_id and text are given back in blocks of so many, each in a task of its own.
COPIES = 1 << 16


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space as one space; null is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256))


class DigestIndex:
    """A table of (sha, keep_id), bucketed and sorted by sha.

    The bucketed side of a join needs no exchange, so adding a batch shuffles the
    batch's digests and never the index. Rows of the index don't change: the
    first batch that brings a text fixes the id that stays.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None) -> None:
        self.spark, self.table = spark, table
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def append(self, digests: DataFrame) -> None:
        """Adds the texts that the index lacks: a sort-merge anti-join, then an append to the buckets.

        digests: columns doc_id, sha. Copies within the batch meet in the map-side part of min().
        """
        batch = digests.groupBy("sha").agg(F.min("doc_id").alias("keep_id"))
        if (known := self.rows()) is not None:
            batch = batch.hint("merge").join(known.select("sha"), "sha", "left_anti")
        (
            batch.repartition(self.buckets, "sha")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "sha").sortBy("sha").saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _batches(digests: DataFrame) -> list[DataFrame]:
    """digests by ascending ranges of doc_id, so that the first batch with a text has its least id; rows without doc_id come last."""
    cuts = digests.agg(F.percentile_approx("doc_id", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    parts = [(F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi) for lo, hi in bounds]
    return [digests.where(p & F.col("doc_id").isNotNull()) for p in parts] + [digests.where("doc_id IS NULL")]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and empty texts are one group. Of rows that
    share doc_id and text one is kept. A null doc_id never beats another id. Without
    an index, a new one is filled from docs in BATCHES batches, each of which meets
    in the anti-join what those before it have left. With an index that already
    holds a text, its id stays and every row of docs with that text is dropped, but
    the row of that id. group_size counts the rows of docs. Other columns are ignored.

    Texts are read and hashed once. Rows of a frequent text (HOT) get their group by a
    broadcast of fewer than 1 / HOT rows, all others by a join on the digest.
    """
    spark = docs.sparkSession
    digests = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha")))
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    for batch in [digests] if index else _batches(digests):
        own.append(batch)
    # Rows that share doc_id and text become one, with their number.
    rows = staged(digests.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("rows")))
    sizes = rows.groupBy("sha").agg(F.sum("rows").alias("group_size"))
    groups = staged(sizes.join(own.rows(), "sha"))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    unstage(digests)
    if not index:
        own.drop()
    hot = groups.where(F.col("group_size") > HOT * total)
    named = rows.join(F.broadcast(hot), "sha", "left")
    light = named.where("group_size IS NULL").select("sha", "doc_id", "rows").join(groups, "sha")
    every = named.where("group_size IS NOT NULL").unionByName(light)
    few = every.where(F.col("rows") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {COPIES}")))
    many = every.where(F.col("rows") > COPIES).withColumn("block", blocks).repartition("sha", "doc_id", "block")
    copies = F.sequence(F.col("block") * COPIES + 1, F.least(F.col("rows"), (F.col("block") + 1) * COPIES))
    of = few.unionByName(many.withColumn("copy", F.explode(copies)).drop("block"))
    return of.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """docs with only the row of least doc_id of each text; all columns stay.

    Rows that share this doc_id and the text are the same document given twice: one of them stays.
    A text none of whose rows has a doc_id keeps one of them. Only digests and ids are grouped;
    the texts are shuffled once, by digest and id, so copies don't meet in one task.
    """
    sha, key = (f"_{uuid.uuid4().hex}" for _ in range(2))  # no column of docs has these names
    kept = exact_dedup(docs).where("kept").select(F.unhex("text_sha256").alias(sha), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key))
    rows = docs.withColumn(sha, digest(docs["text"])).withColumn(key, F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")))
    return rows.join(kept, [sha, key], "left_semi").dropDuplicates([sha, key]).drop(sha, key)


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
