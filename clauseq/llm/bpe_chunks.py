"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clauseq.llm.textkit import blocks, text_bytes

#: A chunk ends where the hash of the last 32 bytes has MASK's bits at 0: 512 bytes on average.
WINDOW, MASK = 32, np.uint32(0x1FF << 20)
_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of content-defined chunks: a rolling (gear) hash of the last 32 bytes decides, so equal passages get equal cuts wherever they stand. A code point is never split."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cut = (h & MASK) == 0
    cut[: WINDOW - 1] = False
    if len(raw) > 1:
        cut[:-1] &= (raw[1:] & 0xC0) != 0x80
    return np.flatnonzero(cut) + 1


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk that was met before is not encoded again.

    A chunk is cut anywhere, so its first and last word may go on in its
    neighbours. Its entry holds the ids of the whole words within, and the two
    open ends as text. A join is repaired by encoding again what stands between
    the nearest white space on either side. As no pre-token of this vocabulary
    spans white space, the ids from there on agree exactly with those of the
    whole text; where a side has no white space, the repair grows over further
    chunks until it has.

    Both memories are bounded: they are emptied when they reach their limit.
    """

    def __init__(self, path: str, max_chunks: int = 60_000, max_words: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.names = {i: t.encode() for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes, bytes] | None] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.max_chunks, self.max_words = max_chunks, max_words
        self.reused = self.encoded = self.repairs = 0

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes the words not yet known, in one call."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        for w, e in zip(new, self.tok.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.words[w] = (np.array(e.ids, "<u4").tobytes(), b"".join(b" " + self.names[i] for i in e.ids))

    def piece(self, words: list[bytes]) -> tuple[bytes, bytes]:
        try:
            got = [self.words[w] for w in words]
        except KeyError:
            self.learn(words)
            got = [self.words[w] for w in words]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def chunk(self, key: bytes) -> tuple[bytes, bytes, bytes, bytes] | None:
        """(open head, ids, decoded, open tail); None if the chunk has no white space."""
        if key in self.chunks:
            self.reused += 1
            return self.chunks[key]
        self.encoded += 1
        parts = key.replace(b"\n", b" ").split(b" ")
        entry = None if len(parts) == 1 else (parts[0], *self.piece(parts[1:-1]), parts[-1])
        self.chunks[key] = entry
        return entry

    def encode(self, chunks: list[bytes]) -> tuple[bytes, bytes]:
        """The ids of the whole text as little-endian 32-bit integers, and its decoded text."""
        ids, said, held = [], [], b""
        for key in chunks:
            got = self.chunk(key)
            if got is None:
                held += key
                continue
            self.repairs += 1
            for x, to in zip(self.piece([held + got[0]]), (ids, said), strict=True):
                to.append(x)
            ids.append(got[1])
            said.append(got[2])
            held = got[3]
        for x, to in zip(self.piece([held]), (ids, said), strict=True):
            to.append(x)
        return b"".join(ids), b"".join(said)[1:]

    def forget(self) -> None:
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
        if len(self.words) > self.max_words:
            self.words.clear()


_READY: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, which keeps its memory from task to task."""
    if path not in _READY:
        _READY[path] = ChunkEncoder(path)
    return _READY[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked for).

    Ids are those of the tokenizers library for the whole text; decoded is its
    decode() of them. Null text is empty: no ids, empty decoded text. Rows keep
    their doc_id as it is, null and repeated ones too. Other columns are ignored.
    There is no shuffle: each task encodes its rows, and shares a worker's memory.
    tokenizer_path must be a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            ids_of = batch.column("doc_id")
            for lo, hi in blocks(at):
                enc.forget()
                part = raw[at[lo] : at[hi]]
                data, rows = part.tobytes(), (at[lo : hi + 1] - at[lo]).tolist()
                cuts = cut_points(part).tolist() if len(part) else []
                out: list[list] = [[], [], [], [], []]
                k = 0
                for r in range(hi - lo):
                    start, end, chunks = rows[r], rows[r + 1], []
                    while k < len(cuts) and cuts[k] <= start:
                        k += 1
                    while k < len(cuts) and cuts[k] < end:
                        chunks.append(data[start : cuts[k]])
                        start = cuts[k]
                        k += 1
                    chunks.append(data[start:end])
                    ids, said = enc.encode(chunks)
                    out[0].append(len(ids) // 4)
                    out[1].append(hashlib.sha256(ids).hexdigest())
                    out[2].append(hashlib.sha256(said).hexdigest())
                    if with_ids:
                        out[3].append(np.frombuffer(ids, "<u4").astype(np.int32))
                        out[4].append(said.decode())
                arrays = [ids_of.slice(lo, hi - lo), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)


def op2_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
