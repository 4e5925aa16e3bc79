"""Removal of long repeated byte strings, by anchors that the content defines.

The method named for this operator merges the Burrows-Wheeler transforms of
shards. `shard_bwt.py` does that, with the same result; README gives its figures and
why this query does not use it. Anchors give the same exact result with work and
memory that split over tasks.

Each window of LENGTH bytes has an anchor: the leftmost of the least hashes of its
KMER-byte strings. It depends on the window's content only, so equal windows have
equal anchors at equal offsets. Successive windows with the same anchor are a
block; about every 70 bytes a new one begins. A block that occurs twice has all its
windows repeated. Only where one anchor has several different blocks (at the edges
of repeated passages) are single windows compared. 128 bits stand for a block
or a window: the hash of its anchor and one of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.bitmaps import map_of, perhaps
from clauseq.llm.staging import staged, unstage
from clauseq.llm.textkit import U64, PrefixHasher, mix, pieces, text_bytes

LENGTH, KMER = 200, 64
#: Windows whose starts lie in one cell of this many share a core of LENGTH - CELL + 1 bytes.
CELL = 8
#: Windows for which anchors are found at a time: 2^24, as an anchor's place takes the low 24 bits of its hash.
STRETCH = (1 << 24) - LENGTH
#: Rows of an emitted batch at most, so that long texts don't grow a task's memory.
BATCH = 200_000
_LOW = U64((1 << 24) - 1)


def anchored_blocks(hasher: PrefixHasher) -> tuple[np.ndarray, ...]:
    """For the hasher's text: (anchor hash, anchor's place, first window, last window) of each block."""
    n, span, parts = hasher.size - LENGTH + 1, LENGTH - KMER + 1, []
    for at in range(0, max(n, 0), STRETCH):
        size = min(STRETCH, n - at)
        small = hasher.windows(at, size + span - 1, KMER)
        best, done = (small & ~_LOW) | np.arange(len(small), dtype=U64), 1
        while done < span:
            step = min(done, span - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        place = (best[first] & _LOW).astype(np.int64)
        parts.append((small[place], place + at, first + at, np.append(first[1:], len(best)) - 1 + at))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(U64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _id(key: pa.Array) -> np.ndarray:
    """The first 8 of each key's 16 bytes."""
    return np.frombuffer(b"".join(k.as_py() for k in key), np.int64).reshape(-1, 2)[:, 0].copy()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = PrefixHasher()
    for batch in pieces(batches):
        raw, at = text_bytes(batch.column("text"))
        held, rows = [np.empty(0, U64)], 0
        for r in range(batch.num_rows):
            held.append(anchored_blocks(hasher.of(raw[at[r] : at[r + 1]]))[0])
            rows += len(held[-1])
            if rows >= BATCH or r == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["anchor"])
                held, rows = [np.empty(0, U64)], 0


def _blocks(anchors, copies):
    """Blocks whose anchor may occur elsewhere. Of texts with copies, a task tells its first two only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = PrefixHasher(), {}
        for batch in pieces(batches):
            raw, at = text_bytes(batch.column("text"))
            keys = batch.column("key")
            copied = perhaps(copies.value, _id(keys))
            held, rows = [], 0
            for r in range(batch.num_rows):
                if copied[r]:
                    key = keys[r].as_py()
                    seen[key] = seen.get(key, 0) + 1
                if not copied[r] or seen[key] <= 2:
                    anchor, place, first, last = anchored_blocks(hasher.of(raw[at[r] : at[r + 1]]))
                    known = perhaps(anchors.value, anchor.view(np.int64))
                    anchor, place, first, last = anchor[known], place[known], first[known], last[known]
                    with np.errstate(over="ignore"):
                        block = mix(hasher.at(first, LENGTH) * U64(0x9E3779B97F4A7C15) + mix(hasher.at(last, LENGTH) + (last - first).astype(U64)))
                    held.append((np.full(len(anchor), r), anchor.view(np.int64), block.view(np.int64), place, first, last))
                    rows += len(anchor)
                if held and (rows >= BATCH or r == batch.num_rows - 1):
                    of, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(of)), pa.array(copied[of]), *(pa.array(c) for c in cols)], ["key", "copied", "anchor", "block", "place", "first", "last"]
                    )
                    held, rows = [], 0

    return run


def _packed(asked, names: list[str]):
    """Rows whose key may be asked for, with compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = pa.array(np.flatnonzero(perhaps(asked.value, _id(batch.column("key")))))
            batch = batch.take(keep)
            raw, at = text_bytes(batch.column("text"))
            texts = [zlib.compress(raw[s:e].tobytes(), 1) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary())], [*names, "packed"])

    return run


def _asked(batch: pa.RecordBatch, hasher: PrefixHasher) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """For each row its asked blocks (place, first, last, anchor, n), with the hasher on its text."""
    texts, lists = batch.column("packed"), batch.column("asked")
    for r in range(batch.num_rows):
        hasher.of(np.frombuffer(zlib.decompress(texts[r].as_py()), np.uint8))
        yield r, tuple(lists[r].values.field(i).to_numpy() for i in range(5))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash for each cell of windows of an asked block: of the bytes that all of them share."""
    hasher = PrefixHasher()
    for batch in pieces(batches, "packed", 1 << 18):
        held = [np.empty(0, U64)]
        for _, (place, first, last, anchor, _) in _asked(batch, hasher):
            low, counts = (place - last) // CELL, (place - first) // CELL - (place - last) // CELL + 1
            cell = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            held.append(_core(hasher, np.repeat(place, counts) - CELL * cell, np.repeat(anchor, counts)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["core"])


def _core(hasher: PrefixHasher, start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hasher.at(start, LENGTH - CELL + 1) + anchor.view(U64))


def _windows(cores):
    """The windows of asked blocks whose cell's core may occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PrefixHasher()
        for batch in pieces(batches, "packed", 1 << 18):
            keys, held, rows = batch.column("key"), [], 0
            for r, (place, first, last, anchor, n) in _asked(batch, hasher):
                counts = last - first + 1
                pos = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                of, anchor, n = np.repeat(place, counts), np.repeat(anchor, counts), np.repeat(n, counts)
                known = perhaps(cores.value, _core(hasher, of - CELL * ((of - pos) // CELL), anchor).view(np.int64))
                pos, anchor, n = pos[known], anchor[known], n[known]
                held.append((np.full(len(pos), r), anchor, hasher.at(pos, LENGTH).view(np.int64), pos, n))
                rows += len(pos)
                if rows >= BATCH or r == batch.num_rows - 1:
                    row, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *(pa.array(c) for c in cols)], ["key", "anchor", "window", "pos", "n"])
                    held, rows = [], 0

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(doc_ids: pa.Array, rows: list[tuple[bytes, np.ndarray | None]], with_text: bool) -> pa.RecordBatch:
    """rows: a text and which of its bytes go (None: none)."""
    out: list[list] = [[], [], [], [], []]
    for text, gone in rows:
        kept = text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[0].append(len(text))
        out[1].append(len(text) - len(kept))
        out[2].append(0 if gone is None else int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)))
        out[3].append(hashlib.sha256(kept).hexdigest())
        out[4].append(kept if with_text else None)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(v, t) for v, t in zip(out, types, strict=True))], [f.split()[0] for f in OUT.split(", ")])


def _untouched(touched, with_text: bool):
    """Rows whose text surely has no repeated string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.take(pa.array(np.flatnonzero(~perhaps(touched.value, _id(batch.column("key"))))))
            raw, at = text_bytes(batch.column("text"))
            yield _result(batch.column("doc_id"), [(raw[s:e].tobytes(), None) for s, e in zip(at[:-1], at[1:], strict=True)], with_text)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text in order, those that follow each other as one."""
    for batch in batches:
        out = []
        for row in batch.column("runs"):
            first, last = (row.values.field(i).to_numpy() for i in range(2))
            order = np.argsort(first, kind="stable")
            first, last = first[order], np.maximum.accumulate(last[order])
            begins = np.concatenate([[True], first[1:] > last[:-1] + 1])
            ends = np.append(np.flatnonzero(begins)[1:] - 1, len(first) - 1)
            out.append([{"first": f, "last": e} for f, e in zip(first[begins].tolist(), last[ends].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], ["key", "runs"])


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", 1 << 18):
            rows, sizes, lists = [], batch.column("size").to_pylist(), batch.column("runs")
            for r, packed in enumerate(batch.column("packed")):
                text = zlib.decompress(packed.as_py())
                gone = np.zeros(len(text) + 1, np.int32)
                if (sizes[r] or 1) > 1 and len(text) >= LENGTH:
                    gone[0], gone[-1] = 1, -1
                elif lists[r].is_valid:
                    runs = lists[r].values
                    np.add.at(gone, runs.field(0).to_numpy(), 1)
                    np.add.at(gone, runs.field(1).to_numpy() + LENGTH, -1)
                rows.append((text, np.cumsum(gone[:-1]) > 0))
            yield _result(batch.column("doc_id"), rows, with_text)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for).

    Null text is empty; texts under LENGTH bytes lose nothing. A text of LENGTH
    bytes or more that another row has too is removed whole, as each of its strings
    also starts there. Repeated and null doc_ids are separate rows. Other columns are ignored.

    Anchors, blocks and windows are counted by hash with map-side partial sums, so a
    passage that a third of the rows share is a row or two for each task. No key's
    rows are ever gathered; the lists that are gathered belong to one text. Of the
    texts, only those that have something to compare or to cut are shuffled, compressed.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    copies = staged(d.where(F.octet_length("text") >= LENGTH).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))

    def ids(keyed: DataFrame) -> DataFrame:
        """The 64-bit form of 16-byte keys that maps take."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_id(batch.column("key")))], ["id"])

        return keyed.select("key").mapInArrow(run, "id long")

    again = d.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    blocks = staged(
        d.select("key", "text").mapInArrow(
            _blocks(map_of(again), map_of(ids(copies))), "key binary, copied boolean, anchor long, block long, place long, first long, last long"
        )
    )
    one = F.struct("key", "place", "first", "last")
    distinct = staged(blocks.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("at")))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    unclear = distinct.join(several, "anchor", "left_semi").select("at.key", F.struct("at.place", "at.first", "at.last", "anchor", "n").alias("x"))
    asked = staged(unclear.groupBy("key").agg(F.collect_list("x").alias("asked")))
    # One row of each text: equal ones have the same blocks.
    texts = d.select("key", "text").mapInArrow(_packed(map_of(ids(asked)), ["key"]), "key binary, packed binary")
    texts = staged(asked.join(texts.groupBy("key").agg(F.first("packed").alias("packed")), "key"))
    unstage(asked)
    cores = texts.mapInArrow(_cores, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core")
    windows = staged(texts.mapInArrow(_windows(map_of(cores)), "key binary, anchor long, window long, pos long, n long"))
    unstage(texts)
    common = windows.groupBy("anchor", "window").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "window")
    run = lambda first, last: F.struct(F.col(first).alias("first"), F.col(last).alias("last")).alias("run")
    single = windows.where("n = 1").join(common, ["anchor", "window"], "left_semi").select("key", run("pos", "pos"))
    whole = blocks.join(distinct.where("n > 1").select("anchor", "block"), ["anchor", "block"], "left_semi").select("key", "copied", run("first", "last"))
    # The rows of a text with copies tell the same runs.
    whole = whole.where("NOT copied").drop("copied").unionByName(whole.where("copied").drop("copied").distinct())
    runs = whole.unionByName(single).groupBy("key").agg(F.collect_list("run").alias("runs")).mapInArrow(_merged, "key binary, runs array<struct<first: long, last: long>>")
    known = staged(
        runs.withColumn("size", F.lit(None).cast("long")).unionByName(copies.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)))
        .groupBy("key").agg(F.max("size").alias("size"), F.first("runs", ignorenulls=True).alias("runs"))
    )
    unstage(copies, blocks, distinct, windows)
    touched = map_of(ids(known))
    cut = d.mapInArrow(_packed(touched, ["doc_id", "key"]), "doc_id long, key binary, packed binary").join(known, "key", "left").drop("key")
    out = d.mapInArrow(_untouched(touched, with_text), OUT).unionByName(cut.select("doc_id", "packed", "size", "runs").mapInArrow(_cut(with_text), OUT))
    return out if with_text else out.drop("kept")


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
