"""Runs of repeated words in a text: rare words split it until nothing changes, and what is left is scanned lag by lag."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clauseq.llm.textkit import pieces

#: A run has this many words at least, and its period this many times.
LEAST, TIMES = 6, 4
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at a time, and words that are joined at a time.
SLICE, JOIN = 1 << 22, 1 << 17


class Words:
    """Words as numbers; the same for all texts of a slice."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.word: list[bytes] = []

    def of(self, text: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                gap = _SPACE.search(text, end)
                end = gap.start() if gap else len(text)
            words = text[at:end].split()
            for w in words:
                if w not in self.number:
                    self.number[w] = len(self.word)
                    self.word.append(w)
            out.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def digest(self, words: np.ndarray) -> str:
        """SHA-256 of the words joined by one space."""
        h = hashlib.sha256()
        for at in range(0, len(words), JOIN):
            part = [self.word[i] for i in words[at : at + JOIN].tolist()]
            h.update((b" " if at else b"") + b" ".join(part))
        return h.hexdigest()


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words with the periodic tail that the contract puts into one text in ten; a text without id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


def split_segments(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segment of each) of the words that rare words do not rule out.

    In a run each word stands TIMES times or more. A word that its segment has
    less often is in no run, so the segment is split there; the parts have their own
    counts, and are split again until none loses a word. bounds are the n + 1
    starts of the texts, the first segments.
    """
    place = np.arange(len(words), dtype=np.int64)
    segment = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    width = int(words.max()) + 1 if len(words) else 1
    while len(place):
        _, which, count = np.unique(segment * width + words[place], return_inverse=True, return_counts=True)
        keep = count[which] >= TIMES
        before = len(place)
        place, segment = place[keep], segment[keep]
        if len(place):
            new = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(segment) > 0)])
            segment = np.cumsum(new) - 1
            size = np.bincount(segment)
            keep = size[segment] >= LEAST
            place, segment = place[keep], segment[keep]
        if len(place) == before:
            break
    return place, segment


def lag_scan(words: np.ndarray, place: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the segments, by start, then period.

    The segments stand one after another, the longest first, so that for each
    lag only those that are long enough are looked at. A run of period q has equal
    words q apart in at least (TIMES - 1) * q places in a row, so at least TIMES - 1
    of every q-th place match; such places are followed in both directions. A find
    within a run whose period divides q repeats that run and is passed over.
    """
    if not len(place):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(segment) > 0]))
    size = np.diff(np.append(first, len(place)))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    index = np.concatenate([np.arange(f, f + s) for f, s in zip(first[order], size, strict=True)])
    end = np.repeat(np.cumsum(size), size)
    seq = words[place[index]]
    total = np.cumsum(size)
    reach, period = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)
    runs = []
    for q in range(1, int(size[0]) // TIMES + 1):
        stop = int(total[np.searchsorted(-size, -TIMES * q, "right") - 1])
        at = np.arange(0, stop - q, q)
        hit = (seq[at] == seq[at + q]) & (at + q < end[at])
        hit &= ~((reach[at] > at + q) & (q % period[at] == 0))
        need = TIMES - 1
        if len(hit) < need:
            continue
        row = hit[: len(hit) - need + 1].copy()
        for k in range(1, need):
            row &= hit[k : len(hit) - need + 1 + k]
        done = -1
        for i in at[np.flatnonzero(row)].tolist():
            if i < done or (reach[i] > i + q and q % period[i] == 0):
                continue
            last = int(end[i])
            begin = last - int(size[np.searchsorted(total, i, "right")])
            lo, hi = follow(seq, i, q, begin, last)
            done = hi - q
            if hi - lo < max(LEAST, TIMES * q) or not smallest(seq[lo : lo + 2 * q], q):
                continue
            runs.append((int(place[index[lo]]), hi - lo, q))
            further = reach[lo:hi] < hi
            reach[lo:hi][further], period[lo:hi][further] = hi, q
    return sorted(runs, key=lambda r: (r[0], r[2]))


def smallest(twice: np.ndarray, q: int) -> bool:
    """Whether a stretch that begins with these two periods of q words has no smaller one; as it has four, such a one would divide q."""
    rest, d = q, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            r = q // d
            if np.array_equal(twice[:q], twice[r : r + q]):
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def follow(seq: np.ndarray, i: int, q: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch round i within [begin, end) whose words q apart are equal, looked at in parts that double."""
    hi, step = i, 64
    while hi < end - q:
        top = min(hi + step, end - q)
        differ = seq[hi:top] != seq[hi + q : top + q]
        if differ.any():
            hi += int(np.argmax(differ))
            break
        hi, step = top, step * 2
    lo, step = i, 64
    while lo > begin:
        low = max(lo - step, begin)
        differ = (seq[low:lo] != seq[low + q : lo + q])[::-1]
        if differ.any():
            lo -= int(np.argmax(differ))
            break
        lo, step = low, step * 2
    return lo, hi + q


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli of its longest run, runs_sha256, collapsed_sha256, n_words, n_dropped, runs.

    runs lists every run as (start, length, period); the digests are of the runs and of
    the text without the repetitions, words joined by one space. Null, empty and
    blank texts have no words and no runs; the four values of the longest run are
    then null. Rows keep their doc_id as it is, null and repeated ones too; other
    columns are ignored. plant puts a periodic tail into one text in ten by its id.

    No shuffle: a text is scanned whole in its task. Words are numbers of four
    bytes, and only the segments that rare words leave are scanned: by every lag up
    to a quarter of a segment, at each lag's multiples only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            known = Words()
            ids = batch.column("doc_id").to_pylist()
            texts = [planted(k, w) if plant else w for k, w in zip(ids, (known.of((t.as_py() or "").encode()) for t in batch.column("text")), strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            words = np.concatenate(texts) if texts else np.empty(0, np.int32)
            place, segment = split_segments(words, bounds)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, q in lag_scan(words, place, segment):
                doc = int(np.searchsorted(bounds, start, "right")) - 1
                runs[doc].append((start - int(bounds[doc]), length, q))
            rows = []
            for k, w, found in zip(ids, texts, runs, strict=True):
                keep = np.ones(len(w), bool)
                for s, n, q in found:
                    keep[s + q : s + n] = False
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((
                    k, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    hashlib.sha256(said.encode()).hexdigest(), known.digest(w[keep]), len(w), int(len(w) - keep.sum()),
                    [{"start": s, "length": n, "period": q} for s, n, q in found],
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT) if rows else pa.RecordBatch.from_pylist([], _OUT)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, SCHEMA)


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "n_words long, n_dropped long, runs array<struct<start: long, length: long, period: long>>"
)
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")] + [(c, pa.int64()) for c in ("n_words", "n_dropped")] + [("runs", _RUN)]
)


def op13_frequency_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("runs")
