"""Hierarchical packing of token streams into windows of several lengths."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from clauseq.llm.textkit import blocks, text_bytes

TIERS = (2048, 1024, 512, 256)
#: Tokens of one training step; a step group holds STEP_TOKENS / tier windows of one tier.
STEP_TOKENS = 16_384
END_ID = 1
_READY: dict[tuple, object] = {}


def byte_bpe(rank_path: str, pattern: str):
    """The byte-level BPE of a rank file; its ids are those of the same vocabulary in the tokenizers library (tests compare them)."""
    key = (rank_path, pattern)
    if key not in _READY:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        _READY[key] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _READY[key]


def byte_encoder(rank_path: str, pattern: str, tokenizer_path: str):
    """text -> ids. Texts whose runs of white space are too long for the one library's patterns go to the other, which gives the same ids."""
    fast = byte_bpe(rank_path, pattern)

    def slow(text: str) -> np.ndarray:
        if tokenizer_path not in _READY:
            from tokenizers import Tokenizer

            tok = _READY[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
            tok.no_truncation()
            tok.no_padding()
        return np.array(_READY[tokenizer_path].encode(text, add_special_tokens=False).ids, "<u4")

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return slow(text)

    return encode


class TierPacker:
    """Packs what one task sees. Holds one block of documents, and at most one open window and one step group a tier.

    Each document gives full windows of the longest tier; its rest is routed to
    the smallest tier that holds it. From the longest tier down, each rest opens
    a window. Its gap is filled by whole rests of shorter tiers, largest first,
    and then by cutting one (a shorter one if there is, else one of this tier).
    So windows are full but for the last of a task.

    A step group is released when it is full. As the tiers divide each other, what is
    left of the groups at the end fills mixed ones, longest windows first, so
    that only the last group of a task may be short.
    """

    def __init__(self, base: int) -> None:
        self.base, self.next_id, self.next_group = base, 0, 0
        self.open: dict[int, list] = {}
        self.held: dict[int, list] = {t: [] for t in TIERS}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        """pieces: (document, start, length) in order."""
        self.held[tier].append(pieces)
        if len(self.held[tier]) * tier >= STEP_TOKENS:
            self.release([(tier, p) for p in self.held[tier]])
            self.held[tier] = []

    def release(self, windows: list[tuple[int, list]]) -> None:
        for tier, pieces in windows:
            seq, at = self.base + self.next_id, 0
            self.next_id += 1
            for doc, start, length in pieces:
                self.rows.append((doc, start, length, seq, at, tier, self.base + self.next_group))
                at += length
        self.next_group += 1

    def waiting(self) -> set[int]:
        """Documents with pieces not yet released."""
        return {p[0] for pieces, _ in self.open.values() for p in pieces} | {p[0] for windows in self.held.values() for pieces in windows for p in pieces}

    def add(self, docs: list[tuple[int, int]]) -> None:
        """docs: (document, tokens)."""
        longest, rests = TIERS[0], {t: [] for t in TIERS}
        for doc, n in docs:
            whole = n // longest * longest
            for start in range(0, whole, longest):
                self.emit([(doc, start, longest)], longest)
            if n > whole:
                self.route(rests, n - whole, doc, whole)
        for k, tier in enumerate(TIERS):
            shorter, own = TIERS[k + 1 :], rests[tier]
            pieces, used = self.open.pop(tier, ([], 0))
            while True:
                if used == tier:
                    self.emit(pieces, tier)
                    pieces, used = [], 0
                if not pieces:
                    if not own:
                        break
                    n, doc, start = own.pop()
                    pieces, used = [(doc, start, n)], n
                    continue
                gap = tier - used
                pool = next((rests[t] for t in shorter if rests[t] and rests[t][0][0] <= gap), None)
                if pool is not None:
                    n, doc, start = pool.pop(bisect_right(pool, (gap, float("inf"))) - 1)
                else:
                    pool = next((rests[t] for t in shorter if rests[t]), own)
                    if not pool:
                        break
                    n, doc, start = pool.pop(0)
                    if n > gap:
                        self.route(rests, n - gap, doc, start + gap)
                        n = gap
                pieces.append((doc, start, n))
                used += n
            if pieces:
                self.open[tier] = (pieces, used)

    @staticmethod
    def route(rests: dict[int, list], n: int, doc: int, start: int) -> None:
        insort(rests[min(t for t in TIERS if t >= n)], (n, doc, start))

    def close(self) -> None:
        """What is still open goes into full windows of the tiers, and the last few ids into one padded window."""
        left = [p for tier in TIERS if tier in self.open for p in self.open[tier][0]]
        self.open = {}
        total = sum(p[2] for p in left)
        while total:
            size = next((t for t in TIERS if t <= total), total)
            window, need = [], size
            while need:
                doc, start, n = left.pop(0)
                take = min(n, need)
                window.append((doc, start, take))
                if take < n:
                    left.insert(0, (doc, start + take, n - take))
                need -= take
            total -= size
            self.emit(window, size if size in TIERS else TIERS[0])
        group, used = [], 0
        for tier in TIERS:
            for pieces in self.held[tier]:
                group.append((tier, pieces))
                used += tier
                if used == STEP_TOKENS:
                    self.release(group)
                    group, used = [], 0
            self.held[tier] = []
        if group:
            self.release(group)


def pack(docs: DataFrame, rank_path: str, pattern: str, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids if asked for).

    A document's ids are its text's byte-BPE ids and then END_ID; null text has
    END_ID only. Each id lies in exactly one piece. A sequence has exactly `tier`
    ids, so needs no padding; only the last one of a task may have fewer, and is
    padded to 2048. Each step group has the same number of ids (STEP_TOKENS), but the
    last of a task may have fewer. Repeated and null doc_ids are separate documents.
    Other columns are ignored. rank_path and tokenizer_path hold one vocabulary, each
    in a file that every executor has.

    Each task packs its own rows as they stream by, so there is no shuffle, and
    sequence ids are made unique by the task's partition number. Write the result
    once: a second evaluation over a shuffled input may pack differently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(rank_path, pattern, tokenizer_path)
        packer = TierPacker(TaskContext.get().partitionId() << 40)
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        serial = 0

        def flush() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            parts = [ids[d][s : s + n] for d, s, n in zip(*cols[:3], strict=True)]
            arrays = [
                pa.array([names[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([len(ids[d]) for d in cols[0]], pa.int64()),
                pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64()),
            ]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                fields.append("ids")
            waiting = packer.waiting()
            for d in [d for d in ids if d not in waiting]:
                del ids[d], names[d]
            return pa.RecordBatch.from_arrays(arrays, fields)

        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in blocks(at):
                data, rows = raw[at[lo] : at[hi]].tobytes(), (at[lo : hi + 1] - at[lo]).tolist()
                new = []
                for r in range(hi - lo):
                    got = encode(data[rows[r] : rows[r + 1]].decode())
                    ids[serial] = np.append(got, np.uint32(END_ID)).astype("<u4", copy=False)
                    names[serial] = doc_ids[lo + r]
                    new.append((serial, len(ids[serial])))
                    serial += 1
                packer.add(new)
                yield flush()
        packer.close()
        yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def pack_default(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"), with_ids)


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_default(spark.read.parquet(f"{sf_dir}/documents.parquet"))
