"""Repeated strings by merging the transforms of shards: the method dealt for repeats.py, kept to measure it.

A shard (a Spark partition) sorts its windows of LENGTH bytes on its own and keeps its
transform: for each step the eight bytes that stand before each suffix, in the order
of that step. The merge never sorts suffixes anew. It refines one interleave of all
shards' entries: a step brings the entries into the order of the bytes before
them, ties in the order so far, so that after k steps suffixes are in order by 8 k
bytes. Entries that were equal so far and have equal bytes have that prefix in common;
after LENGTH / 8 steps the intervals of equal entries are the repeated strings.

Each step is a join and a sort of one row per byte of the corpus. README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseq.llm.staging import staged, unstage
from clauseq.llm.textkit import U64, text_bytes

#: Bytes that a step adds.
STEP = 8


def _transforms(length: int):
    """(k, shard, i, digit, after): entry i of step k, the bytes before it, and its place in the order after the step. Of the last step: the entry's document and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = [], []
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            held += [raw[s:e].copy() for s, e in zip(at[:-1], at[1:], strict=True)]
            docs += batch.column("doc").to_pylist()
        sizes = [max(0, len(x) - length + 1) for x in held]
        if not sum(sizes):
            return
        raw = np.concatenate(held)
        starts = np.cumsum([0] + [len(x) for x in held[:-1]])
        window = np.concatenate([np.arange(n) for n in sizes])
        doc, base = np.repeat(np.arange(len(held)), sizes), np.repeat(starts, sizes) + window
        shard, order = TaskContext.get().partitionId(), np.arange(len(base))
        for k in range(length // STEP):
            digit = np.zeros(len(base), U64)
            for j in range(STEP):
                digit = (digit << U64(8)) | raw[base[order] + length - STEP * (k + 1) + j]
            new = np.argsort(digit, kind="stable")
            after = np.empty(len(new), np.int64)
            after[new] = np.arange(len(new))
            yield _batch(k, shard, (digit ^ U64(1 << 63)).view(np.int64), after)
            order = order[new]
        yield _batch(length // STEP, shard, np.array(docs, np.int64)[doc[order]], window[order])

    return run


def _batch(k: int, shard: int, digit: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    n = len(digit)
    arrays = [np.full(n, k), np.full(n, shard), np.arange(n), digit, after]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], ["k", "shard", "i", "digit", "after"])


def _interleave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New ranks, and classes of entries that are equal so far, over one range of the sorted entries."""
    at, last, name = TaskContext.get().partitionId() << 40, None, 0
    for batch in batches:
        digit, cls = batch.column("digit").to_numpy(), batch.column("cls").to_numpy()
        if not len(digit):
            continue
        first = np.ones(len(digit), bool)
        first[1:] = (digit[1:] != digit[:-1]) | (cls[1:] != cls[:-1])
        first[0] = last != (digit[0], cls[0])
        rank = at + np.arange(len(digit))
        new = np.maximum.accumulate(np.where(first, rank, -1))
        new = np.where(new < 0, name, new)
        last, name, at = (digit[-1], cls[-1]), int(new[-1]), at + len(digit)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("after"), pa.array(rank), pa.array(new)], ["shard", "i", "rank", "cls"])


def repeated_windows(docs: DataFrame, length: int = 200, shards: int = 4) -> DataFrame:
    """(doc, pos) of every string of `length` bytes (a multiple of STEP) that also starts elsewhere. docs: doc (long, distinct), text; null text is empty."""
    ranges = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = staged(docs.select("doc", "text").repartition(shards, "doc").mapInArrow(_transforms(length), "k long, shard long, i long, digit long, after long"))
    z = kept.where("k = 0").select("shard", "i", (F.col("shard") * (1 << 40) + F.col("i")).alias("rank"), F.lit(0).cast("long").alias("cls"))
    for k in range(length // STEP):
        step = z.join(kept.where(F.col("k") == k).select("shard", "i", "digit", "after"), ["shard", "i"])
        step = step.repartitionByRange(ranges, "digit", "cls").sortWithinPartitions("digit", "rank")
        before, z = z, staged(step.select("shard", "after", "digit", "cls").mapInArrow(_interleave, "shard long, i long, rank long, cls long"))
        if k:
            unstage(before)
    equal = z.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    names = kept.where(F.col("k") == length // STEP).select("shard", "i", F.col("digit").alias("doc"), F.col("after").alias("pos"))
    return z.join(equal, "cls", "left_semi").join(names, ["shard", "i"]).select("doc", "pos")
