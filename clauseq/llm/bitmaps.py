"""Maps of hashed ids with a fixed number of bits, by which tasks drop rows before a shuffle.

A map says "surely not" or "perhaps"; an exact join or count follows. Its size does
not depend on the corpus: where it fills up, it only spares less of a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseq.llm.textkit import U64, mix

#: 16 MB, whatever the size of the corpus.
BITS = 27


def _place(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(U64) ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - BITS)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _place(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U64(1) << (at & 63).astype(U64)).view(np.int64))], ["word", "bits"])


def map_of(ids: DataFrame) -> Broadcast:
    """The map of the first column of ids (long, no null). At most 2^(BITS-6) rows reach the driver."""
    words = ids.mapInArrow(_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, U64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return ids.sparkSession.sparkContext.broadcast(out)


def perhaps(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id, whether it may be in the map."""
    at = _place(ids)
    return (bits[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)
