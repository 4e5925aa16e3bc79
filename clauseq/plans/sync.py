"""Keeping a store in step with its source: what to embed again, what has drifted, and uploads that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseq.plans.folders import names_in, remove

#: Fixed value: rows of an upload's batch.
BATCH = 100


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)


def embed_plan(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, action, hash: `new`, `changed` or `keep` for each chunk (id, text), `delete` for what is stored (id, hash) but no chunk any more.

    Ids do not tell of a text's change, so hashes are compared, in one full join that
    carries no text. A stored row without hash is kept, as nothing says that it changed. An id stands once on either side.
    """
    now = chunks.select("id", text_hash(F.col("text")).alias("now"))
    both = done.select("id", F.col("hash").alias("then"), F.lit(True).alias("_stored")).join(now, "id", "full")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("_stored").isNull(), "new").when(F.col("then") != F.col("now"), "changed").otherwise("keep")
    return both.select("id", action.alias("action"), F.col("now").alias("hash"))


def drift(pins: DataFrame, current: DataFrame) -> DataFrame:
    """key, state: how each source stands against its pin; both have key, source_hash, items.

    `never indexed`, `gone`, `moved` (another hash), `count moved`, or `current`.
    """
    p = pins.select("key", F.col("source_hash").alias("_h"), F.col("items").alias("_n"), F.lit(True).alias("_p"))
    c = current.select("key", "source_hash", "items", F.lit(True).alias("_c"))
    both = p.join(c, "key", "full")
    state = (
        F.when(F.col("_p").isNull(), "never indexed").when(F.col("_c").isNull(), "gone").when(~F.col("source_hash").eqNullSafe(F.col("_h")), "moved")
        .when(~F.col("items").eqNullSafe(F.col("_n")), "count moved").otherwise("current")
    )
    return both.select("key", state.alias("state"))


def upload(rows: DataFrame, send: Callable[[DataFrame, int], None], state: str, key: str = "id", size: int = BATCH) -> int:
    """Sends rows in batches and returns how many it sent now; a rerun after a failure leaves out those that were done.

    A row's batch is a hash of its key, so it is the same in every run over the same
    rows; a batch is marked in the folder `state` when `send` has returned, and the
    folder goes with the last one. `send` must bear a batch that it has seen in part, as an upsert does.
    """
    spark = rows.sparkSession
    marks = names_in(spark, state)
    known = [int(n[8:]) for n in marks if n.startswith("batches-")]
    batches = known[0] if known else max(1, -(-rows.count() // size))
    mark = lambda name: spark.range(0).write.mode("overwrite").parquet(f"{state}/{name}")
    if not known:
        mark(f"batches-{batches}")
    dealt, sent = rows.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches))), 0
    for b in range(batches):
        if f"done-{b}" not in marks:
            send(dealt.where(F.col("_batch") == b).drop("_batch"), b)
            mark(f"done-{b}")
            sent += 1
    remove(spark, state)
    return sent
