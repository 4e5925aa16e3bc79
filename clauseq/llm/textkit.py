"""Helpers shared by the operators that work on Arrow batches.

Everything here is a small vectorised kernel; Spark does the partitioning,
the shuffles and the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that cover all rows; each has at most `limit` bytes or is one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most `limit` bytes or that are one row, so that little is held at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(sizes)]), limit):
            yield batch.slice(lo, hi - lo)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class PrefixHasher:
    """Hashes of any byte strings of one text after another, from sums over its prefixes."""

    def __init__(self) -> None:
        self.up = self.down = self.total = np.empty(0, U64)
        self.size = 0

    def of(self, raw: np.ndarray) -> PrefixHasher:
        self.size = len(raw)
        if len(self.up) <= len(raw):
            size = max(len(raw) + 1, 1 << 16)
            self.up, self.down = powers(_P, size), powers(pow(_P, -1, 1 << 64), size)
        self.total = np.zeros(len(raw) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[raw] * self.up[: len(raw)], out=self.total[1:], dtype=U64)
        return self

    def windows(self, start: int, count: int, width: int) -> np.ndarray:
        """Of the strings of `width` bytes at start, start + 1, ..."""
        end = start + count
        with np.errstate(over="ignore"):
            return mix((self.total[start + width : end + width] - self.total[start:end]) * self.down[start:end])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[starts + width] - self.total[starts]) * self.down[starts])


class WordHasher:
    """64-bit hashes of white-space separated words, A-Z lower-cased."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up, self.down = powers(_P, size), powers(pow(_P, -1, 1 << 64), size)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in reading order, and for each row the index of its first word (n + 1 values)."""
        low = _LOWER[raw]
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
        first = word.copy()
        if len(raw):
            first[1:] &= ~word[:-1]
            at = offsets[:-1][(offsets[:-1] < len(raw)) & (np.diff(offsets) > 0)]
            first[at] = word[at]
        last = word.copy()
        if len(raw):
            last[:-1] &= ~word[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, U64)
            np.cumsum(_TABLE[low] * self.up[: len(raw)], out=total[1:], dtype=U64)
            h = mix((total[ends] - total[starts]) * self.down[starts] + U64(1) * (ends - starts).astype(U64))
        return h, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `width` words.

    A row with fewer words has its whole sequence as one; one without words, none.
    """
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), U64)
        for j in range(width):
            rolled = rolled * U64(_P) + words[j : j + len(rolled)]
        rolled = mix(rolled)
        out = []
        for i, n in enumerate(counts):
            lo = at[i]
            if n >= width:
                s = rolled[lo : lo + n - width + 1].copy()
                s.sort()
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s if keep.all() else s[keep])
            elif n:
                h = U64(int(n))
                for x in words[lo : lo + n]:
                    h = h * U64(_P) + x
                out.append(mix(np.array([h], U64)))
            else:
                out.append(np.empty(0, U64))
    return out


def char_index(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte position, len(raw) + 1 values."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
