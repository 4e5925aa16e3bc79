"""Byte-level BPE by ranks: overlapping chunks are split into pre-tokens apart and stitched where their boundaries meet again."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.textkit import pieces

#: Code points of a chunk, and of the stretch that it shares with the next one at least.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A pre-token's end is settled only if the text goes on; an apostrophe's also needs the two letters after it.
LOOK_AHEAD = 3
#: Pre-tokens longer than this are not kept in a worker's memory.
KEEP = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class PieceEncoder:
    """Splits texts into pre-tokens as the library does and merges each by the ranks; a pre-token met before is looked up.

    The splitting runs on another regular-expression engine, whose Unicode
    version differs from the library's. So the library is asked once for the class
    of every code point, and code points that the two engines class differently are
    replaced by one of the library's class, of the same length, before splitting.
    """

    def __init__(self, path: str, max_words: int = 500_000) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        ranks = read_ranks(path)
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocab = {i: token for token, i in ranks.items()}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.hard = regex.compile(r"\p{L}\P{L}|\p{N}\P{N}|\S\s")
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        raw = {bytes([i]): i for i in range(256)}
        odd: dict[int, str] = {}
        for kind, stand_in in ((r"\p{L}", "x"), (r"\p{N}", "0"), (r"\s", "\n")):
            theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=raw, special_tokens={}).encode_ordinary(every)).decode())
            ours = set(regex.findall(kind, every))
            odd |= {ord(c): stand_in for c in theirs - ours} | {ord(c): odd.get(ord(c), "!") for c in ours - theirs}
        self.odd = odd
        self.first_odd = min(odd, default=0x110000)
        self.suspect = regex.compile(f"[{regex.escape(chr(self.first_odd))}-\U0010ffff]") if odd else None
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.max_words = max_words

    def known(self, text: str) -> str:
        """The text with code points of the library's classes only, at the same places."""
        if text.isascii() or self.suspect is None or not self.suspect.search(text):
            return text
        return text.translate(self.odd)

    def pre_tokens(self, text: str) -> list[str]:
        known = self.known(text)
        found = self.split.findall(known)
        if known is text or known == text:
            return found
        out, at = [], 0
        for token in found:
            out.append(text[at : at + len(token)])
            at += len(token)
        return out

    def merge(self, token: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and what they decode to."""
        ids = self.bpe._encode_single_piece(token)
        return np.array(ids, "<u4").tobytes(), b"".join([self.vocab[i] for i in ids])

    def encode(self, tokens: list[str]) -> list[tuple[bytes, bytes]]:
        try:
            return [self.words[t] for t in tokens]
        except KeyError:
            if len(self.words) > self.max_words:
                self.words.clear()
            own = {}
            for t in set(tokens):
                if t not in self.words:
                    own[t] = self.merge(t)
                    if len(t) <= KEEP:
                        self.words[t] = own[t]
            return [self.words.get(t) or own[t] for t in tokens]

    def cuts(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
        """(start, end) of chunks; each shares `overlap` code points or more with the next.

        Wherever a letter, digit or visible sign is followed by another kind, any
        splitting ends a pre-token, so a shared stretch that holds such a place is
        where two chunks meet again. Where a run of one kind is longer than the
        stretch, the chunk grows past its end and the next starts shortly before.
        """
        known, start = self.known(text), 0
        while len(text) - start > size + overlap:
            meet = self.hard.search(known, start + size)
            if meet is None or meet.start() + 1 + LOOK_AHEAD >= len(text):
                break
            place = meet.start() + 1
            after = max(start + size, place - overlap)
            yield start, max(after + overlap, place + 1 + LOOK_AHEAD)
            start = after
        yield start, len(text)


_READY: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, which keeps its memory from task to task."""
    if path not in _READY:
        _READY[path] = PieceEncoder(path)
    return _READY[path]


def sums(ids: list[bytes], said: list[bytes]) -> tuple[int, str, str]:
    a, b = hashlib.sha256(), hashlib.sha256()
    for part in ids:
        a.update(part)
    for part in said:
        b.update(part)
    return sum(map(len, ids)) // 4, a.hexdigest(), b.hexdigest()


def encode_whole(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """Texts of one chunk: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                got = enc.encode(enc.pre_tokens(text or ""))
                ids, said = b"".join([g[0] for g in got]), b"".join([g[1] for g in got])
                for column, value in zip(out, (*sums([ids], [said]), np.frombuffer(ids, "<i4"), said), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_arrays(out, with_ids)], ["doc_id", *_names(with_ids)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + _schema(with_ids))


def _names(with_ids: bool) -> list[str]:
    return ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])


def _schema(with_ids: bool) -> str:
    return "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")


def _arrays(out: list[list], with_ids: bool) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
    return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 5 if with_ids else 3]


_CHUNK = "text_key string, chunk int, start long, shared_until long, next_start long, piece string"
_CODED = "text_key string, chunk int, ids binary, said binary, head array<long>, head_ids array<long>, head_said array<long>, tail array<long>, tail_ids array<long>, tail_said array<long>"


def cut_chunks(texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """texts (text_key, text) as overlapping chunks, with the end of the one before and the start of the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = [f.split()[0] for f in _CHUNK.split(", ")]
        for batch in pieces(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                until, spans = 0, list(enc.cuts(text, size, overlap))
                for k, (start, end) in enumerate(spans):
                    after = spans[k + 1][0] if k + 1 < len(spans) else -1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([k], pa.int32()), pa.array([start]), pa.array([until]), pa.array([after]), pa.array([text[start:end]])], names
                    )
                    until = end

    return texts.select("text_key", "text").mapInArrow(run, _CHUNK)


def encode_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Each chunk's ids, decoded bytes, and the settled boundaries in the stretches that it shares, with the ids and bytes before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in pieces(batches, "piece"):
            rows = []
            for r in batch.to_pylist():
                tokens = enc.pre_tokens(r["piece"])
                ends = np.cumsum([len(t) for t in tokens])
                if r["next_start"] >= 0:
                    starts, size = ends - [len(t) for t in tokens], len(r["piece"])
                    loose = np.flatnonzero((ends >= size) | (starts + LOOK_AHEAD > size))
                    tokens = tokens[: loose[0]] if len(loose) else tokens
                got = enc.encode(tokens)
                at = r["start"] + np.concatenate([[0], ends[: len(tokens)]]).astype(np.int64)
                before = [np.concatenate([[0], np.cumsum([len(g[k]) for g in got])]).astype(np.int64) for k in (0, 1)]
                head, tail = at < r["shared_until"], (at >= r["next_start"]) & (r["next_start"] >= 0)
                row = {"text_key": r["text_key"], "chunk": r["chunk"], "ids": b"".join([g[0] for g in got]), "said": b"".join([g[1] for g in got])}
                for name, part in (("head", head), ("tail", tail)):
                    row |= {name: at[part], f"{name}_ids": before[0][part], f"{name}_said": before[1][part]}
                rows.append(row)
            longs = pa.list_(pa.int64())
            kinds = [("text_key", pa.string()), ("chunk", pa.int32()), ("ids", pa.binary()), ("said", pa.binary())]
            kinds += [(f"{side}{part}", longs) for side in ("head", "tail") for part in ("", "_ids", "_said")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return chunks.mapInArrow(run, _CODED)


def stitch(coded: DataFrame, with_ids: bool) -> DataFrame:
    """Each text's ids and bytes: chunk by chunk, from the first boundary that it has in common with the one before to that with the next.

    The chunks of a text follow each other in one task, as its SHA-256 needs; the task holds one chunk at a time unless ids are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, said_from, ids_from = None, None, 0, 0
        total, a, b, kept = 0, hashlib.sha256(), hashlib.sha256(), ([], [])

        def add(ids: bytes, said: bytes) -> None:
            nonlocal total
            total += len(ids) // 4
            a.update(ids)
            b.update(said)
            if with_ids:
                kept[0].append(ids)
                kept[1].append(said)

        def done() -> pa.RecordBatch:
            add(held["ids"][ids_from:], held["said"][said_from:])
            row = [[total], [a.hexdigest()], [b.hexdigest()], [np.frombuffer(b"".join(kept[0]), "<i4")], [b"".join(kept[1])]]
            return pa.RecordBatch.from_arrays([pa.array([key]), *_arrays(row, with_ids)], ["text_key", *_names(with_ids)])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if r["text_key"] != key:
                    if held is not None:
                        yield done()
                    key, ids_from, said_from = r["text_key"], 0, 0
                    total, a, b, kept = 0, hashlib.sha256(), hashlib.sha256(), ([], [])
                else:
                    both = np.intersect1d(held["tail"], r["head"])
                    if not len(both):
                        raise RuntimeError(f"chunks {held['chunk']} and {r['chunk']} of {key} do not meet")
                    last, first = held["tail"].index(both[0]), r["head"].index(both[0])
                    add(held["ids"][ids_from : held["tail_ids"][last]], held["said"][said_from : held["tail_said"][last]])
                    ids_from, said_from = r["head_ids"][first], r["head_said"][first]
                held = r
        if held is not None:
            yield done()

    return coded.repartition("text_key").sortWithinPartitions("text_key", "chunk").mapInArrow(run, "text_key string, " + _schema(with_ids))


def encode_decode_ranks(docs: DataFrame, ranks_path: str, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked for).

    Ids are those of the library for the whole text, each match of its pattern
    merged by itself; decoded is the concatenated bytes of their tokens. Null text
    is empty. Rows keep their doc_id as it is, null and repeated ones too; other
    columns are ignored.

    Texts of up to `chunk` code points are one chunk and need no shuffle. Longer
    ones, of any length, become rows of overlapping chunks, equal texts once, that
    are dealt out by text and chunk, split and merged apart, and stitched at the
    first boundary that two neighbours have in common; both ways give the same ids.
    ranks_path must be a file that every executor has.
    """
    d = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    longer = d.where(is_long).withColumn("text_key", F.sha2("text", 256))
    chunks = cut_chunks(longer, ranks_path, chunk, overlap).dropDuplicates(["text_key", "chunk"])
    found = stitch(encode_chunks(chunks, ranks_path), with_ids)
    whole = encode_whole(d.where(~is_long), ranks_path, with_ids)
    return whole.unionByName(longer.select("doc_id", "text_key").join(found, "text_key").drop("text_key"))


def op11_overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_ranks(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
