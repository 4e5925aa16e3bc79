"""Cosine search, exact, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block: what is broadcast has this many rows at most.
BLOCK = 20_000


#: Queries and vectors that are compared at once in a task, whose scores are all that it holds beside its best; digits of a score, and one step of them.
TILE, DECIMALS = 512, 6
STEP = 10.0**-DECIMALS


def _merge(score: np.ndarray, near: np.ndarray, row: np.ndarray, new: np.ndarray, vec: np.ndarray) -> None:
    """Puts the new scores of the rows among their best, in place: by score, then by vector."""
    k = score.shape[1]
    touched, local = np.unique(row, return_inverse=True)
    old_row, old_place = np.nonzero(score[touched] > -np.inf)
    rows = np.concatenate([old_row, local])
    scores, vecs = np.concatenate([score[touched][old_row, old_place], new]), np.concatenate([near[touched][old_row, old_place], vec])
    order = np.lexsort((vecs, -scores, rows))
    rows, scores, vecs = rows[order], scores[order], vecs[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, scores, vecs, place = (x[place < k] for x in (rows, scores, vecs, place))
    score[touched[rows], place], near[touched[rows], place] = scores, vecs


def cosine_topk(vectors: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score (6 decimals), rank; the query itself is left out. Null and zero vectors are in no result.

    Each task keeps the k best of each query, so k rows for each task and query are shuffled.
    It holds these and one tile of scores, however many vectors it reads.
    """
    spark = vectors.sparkSession
    number = asked.count()
    out = []
    for part in range(max(1, -(-number // BLOCK))):
        chosen = asked.where("embedding IS NOT NULL")
        if number > BLOCK:
            chosen = chosen.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-number // BLOCK))) == part)
        rows = chosen.collect()  # about BLOCK rows
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([r["embedding"] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            # The best of each query, score and vector: arrays of queries times k, filled from the left.
            score, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            norm = np.sqrt((q * q).sum(1)) if len(q) else q
            for batch in batches:
                for lo in range(0, batch.num_rows if len(q) else 0, TILE):
                    tile = batch.slice(lo, TILE)
                    vec = tile.column("vec_id").to_numpy(zero_copy_only=False)
                    x = np.array(tile.column("embedding").to_pylist(), np.float64)
                    length = np.sqrt((x * x).sum(1))
                    for at in range(0, len(ids), TILE):
                        part = slice(at, at + TILE)
                        with np.errstate(invalid="ignore", divide="ignore"):
                            s = (q[part] @ x.T) / (norm[part, None] * length[None, :])
                        # What is a step of rounding below the k-th best is no candidate.
                        row, col = np.nonzero((s >= score[part, -1:] - STEP) & (ids[part, None] != vec[None, :]))
                        sound = np.isfinite(s[row, col])
                        row, col = row[sound], col[sound]
                        if len(row):
                            _merge(score[part], near[part], row, np.round(s[row, col], DECIMALS), vec[col])
            row, place = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near[row, place]), pa.array(score[row, place])], ["query_id", "vec_id", "score"])

        out.append(vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
