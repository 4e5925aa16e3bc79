"""Secret scans with one deterministic automaton for all rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.textkit import blocks, char_index, text_bytes

# A rule is built of these: a set of bytes, a sequence, a choice, a repetition (least, then without end or not).
ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def one(chars: bytes) -> tuple:
    return ("set", frozenset(chars))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def either(*parts: tuple) -> tuple:
    return ("alt", parts)


def times(part: tuple, least: int, endless: bool = False, most: int | None = None) -> tuple:
    """least copies, then any number (endless) or up to `most`."""
    extra = (("star", part),) if endless else (("opt", part),) * ((most or least) - least)
    return ("seq", (part,) * least + extra)


def word(text: str, any_case: bool = False) -> tuple:
    return seq(*(one((c.lower() + c.upper()).encode() if any_case else c.encode()) for c in text))


_QUOTE, _SPACES = times(one(b"\"'"), 0, most=1), times(one(b" "), 0, endless=True)
_VALUE = one(ALNUM + b"+/_.=-")
_UPPER = ALNUM[:26] + ALNUM[52:]
_KEYWORDS = either(*(word(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
#: name, rule, least characters of the span, least characters of its last repetition. The first three are the contract's.
RULES = (
    ("assign", seq(_KEYWORDS, _QUOTE, _SPACES, one(b":="), _SPACES, _QUOTE, times(_VALUE, 1, True)), 0, 6),
    ("access", seq(word("AKIA"), times(one(_UPPER), 1, True)), 20, 0),
    ("hex", times(one(b"0123456789abcdef"), 24, True), 24, 0),
    ("github", seq(word("gh"), one(b"pousr"), word("_"), times(one(ALNUM), 1, True)), 40, 0),
    ("google", seq(word("AIza"), times(one(ALNUM + b"_-"), 1, True)), 39, 0),
    ("private_key", seq(word("-----BEGIN "), times(one(ALNUM[:26] + b" "), 0, True), word("PRIVATE KEY-----")), 0, 0),
)
BASE = 3
#: A segment of more than four times this many bytes is read in pieces.
PIECE = 2048
_BASE64, _BLANK = ALNUM + b"+/=", b" \t\r\n\\"
_BODY = one(_BASE64 + _BLANK + b":,\"'")
#: What follows the private_key rule's line: headers and key to the END line, none of it with two dashes running; without an END line, runs of 16 characters or more.
KEY_REST = either(
    seq(times(either(_BODY, seq(one(b"-"), _BODY)), 0, True), word("-----END "), times(one(ALNUM[:26] + b" "), 0, True), word("PRIVATE KEY-----")),
    times(seq(times(one(_BLANK), 0, True), times(one(_BASE64), 16, True)), 0, True),
)


class Automaton(NamedTuple):
    step: np.ndarray  # states x 256, state 0 is the start
    accepts: np.ndarray  # bit k: rule k may end here


def _reversed(rule: tuple) -> tuple:
    if rule[0] == "seq":
        return ("seq", tuple(_reversed(r) for r in reversed(rule[1])))
    if rule[0] == "alt":
        return ("alt", tuple(_reversed(r) for r in rule[1]))
    return rule if rule[0] == "set" else (rule[0], _reversed(rule[1]))


def compile_rules(rules: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction over the rules' positions, then minimisation by refining classes of states.

    anywhere: a rule may begin at any byte, else at the first only.
    """
    sets: list[frozenset[int]] = []
    follow: list[set[int]] = []
    ends: dict[int, int] = {}

    def place(rule: tuple) -> tuple[bool, set[int], set[int]]:
        """Whether it matches nothing, its first and its last positions."""
        kind, body = rule
        if kind == "set":
            sets.append(body)
            follow.append(set())
            return False, {len(sets) - 1}, {len(sets) - 1}
        if kind in ("star", "opt"):
            _, first, last = place(body)
            if kind == "star":
                for p in last:
                    follow[p] |= first
            return True, first, last
        parts = [place(r) for r in body]
        if kind == "alt":
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        empty, first, last = True, set(), set()
        for e, f, l in parts:
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return empty, first, last

    begin: set[int] = set()
    for k, rule in enumerate(rules):
        _, first, last = place(rule)
        begin |= first
        for p in last:
            ends[p] = ends.get(p, 0) | 1 << k
    alike: dict[tuple, list[int]] = {}
    for b in range(256):
        alike.setdefault(tuple(b in s for s in sets), []).append(b)
    start: frozenset[int] = frozenset()
    found, todo, table = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        reach = begin.copy() if anywhere or state == start else set()
        for p in state:
            reach |= follow[p]
        row = np.empty(256, np.int32)
        for same in alike.values():
            to = frozenset(p for p in reach if same[0] in sets[p])
            if not anywhere and not to:
                to = frozenset({-1})
            if to not in found:
                found[to] = len(found)
                todo.append(to)
            row[same] = found[to]
        table.append(row)
        follow.append(set())  # of position -1, the dead end
        follow[-1] = set()
    step = np.stack(table)
    accepts = np.array([np.bitwise_or.reduce([ends.get(p, 0) for p in s] or [0]) for s in found], np.uint8)
    group = np.unique(accepts, return_inverse=True)[1].astype(np.int32)
    while True:
        new = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel().astype(np.int32)
        if new.max() == group.max():
            break
        group = new
    order = np.full(group.max() + 1, -1, np.int32)  # classes in order of their first state; the start stays 0
    heads = []
    for s, g in enumerate(group):
        if order[g] < 0:
            order[g] = len(heads)
            heads.append(s)
    return Automaton(order[group[step[heads]]], accepts[heads])


@lru_cache(None)
def automata() -> tuple[Automaton, list[Automaton], Automaton]:
    """The automaton of all rules, of each rule read backwards from its end, and of a private key after its first line."""
    return compile_rules([r[1] for r in RULES], True), [compile_rules([_reversed(r[1])], False) for r in RULES], compile_rules([KEY_REST], False)


class Scanner:
    def __init__(self) -> None:
        forward, self.back, self.rest = automata()
        self.key = [r[0] for r in RULES].index("private_key")
        self.table, self.accepts = forward.step.ravel(), forward.accepts
        self.rows = forward.step.tolist()
        #: Bytes that bring each state to the start: the bytes between two of them can be read on their own.
        self.resets = (forward.step == 0).all(axis=0)

    def flags(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each segment, the rules that end within; segments are read side by side, each byte once."""
        out = np.zeros(len(starts), np.uint8)
        for c in np.flatnonzero(lengths > 4 * PIECE):
            out[c] = self.long_flags(raw[starts[c] : starts[c] + lengths[c]])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= 4 * PIECE]
        for lo in range(0, len(order), 16384):
            rows = order[lo : lo + 16384]
            at, size = starts[rows], lengths[rows]
            state, seen = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.uint8)
            alive = len(rows) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
            for j, n in enumerate(alive):
                state[:n] = self.table[(state[:n] << 8) | raw[at[:n] + j]]
                seen[:n] |= self.accepts[state[:n]]
            out[rows] = seen
        return out

    def long_flags(self, raw: np.ndarray) -> int:
        """The rules that end within one long segment.

        Its pieces are read side by side, each as if at the start state. Then, from
        left to right, a piece whose true first state is another is read again from
        that, up to where both readings are in the same state; from there on they agree.
        """
        n = -(-len(raw) // PIECE)
        bytes_ = np.zeros(n * PIECE, np.uint8)
        bytes_[: len(raw)] = raw
        bytes_ = bytes_.reshape(n, PIECE)
        states, state = np.zeros((PIECE, n), np.int32), np.zeros(n, np.int32)
        for j in range(PIECE):
            state = states[j] = self.table[(state << 8) | bytes_[:, j]]
        states[(len(raw) - 1) % PIECE + 1 :, -1] = 0
        seen, last = int(np.bitwise_or.reduce(self.accepts[states], axis=None)), 0
        for i in range(n):
            true = last
            for j in range(PIECE if i + 1 < n else len(raw) - i * PIECE):
                true = self.rows[true][bytes_[i, j]]
                if true == states[j, i]:
                    true = int(states[-1, i])
                    break
                seen |= int(self.accepts[true])
            last = true
        return seen

    def spans(self, data: bytes, k: int) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping spans of rule k in bytes; those that are too short are used up and dropped."""
        _, _, least, tail = RULES[k]
        out, pos, n, bit, back = [], 0, len(data), 1 << k, self.back[k]
        while pos < n:
            state, i = 0, pos
            while i < n:
                state = self.rows[state][data[i]]
                i += 1
                if self.accepts[state] & bit:
                    break
            else:
                break
            first = i - 1
            while i < n:
                state = self.rows[state][data[i]]
                if not self.accepts[state] & bit:
                    break
                i += 1
            start, s = i, 0
            for j in range(i - 1, pos - 1, -1):
                s = back.step[s, data[j]]
                if back.accepts[s]:
                    start = j
            if i - start >= least and i - first >= tail:
                out.append((start, i))
            pos = i
        return out

    def key_end(self, raw: np.ndarray, i: int) -> int:
        """Where the private key ends whose first line ends at i; no byte is read after the first that no key goes on with."""
        step, accepts = self.rest
        state, end = 0, i
        while i < len(raw) and (accepts[state := step[state, raw[i]]] or not (step[state] == state).all()):
            i += 1
            end = i if accepts[state] else end
        return end

    def scan(self, raw: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each row with any: (start, rule, end) in bytes, sorted."""
        if not len(raw):
            return {}
        cuts = np.unique(np.concatenate([np.flatnonzero(self.resets[raw]) + 1, at[:-1]]))
        cuts = cuts[cuts < len(raw)]
        ends = np.append(cuts[1:], len(raw))
        flags = self.flags(raw, cuts, ends - cuts)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for c in np.flatnonzero(flags):
            row = int(np.searchsorted(at, cuts[c], "right")) - 1
            data, shift = raw[cuts[c] : ends[c]].tobytes(), int(cuts[c] - at[row])
            for k in range(len(RULES)):
                if flags[c] >> k & 1:
                    found = [(s + shift, k, e + shift) for s, e in self.spans(data, k)]
                    if k == self.key:
                        found = [(s, k, self.key_end(raw[at[row] : at[row + 1]], e)) for s, _, e in found]
                    out.setdefault(row, []).extend(found)
        return {r: sorted(v) for r, v in out.items() if v}


_READY: list[Scanner] = []


def scanner() -> Scanner:
    if not _READY:
        _READY.append(Scanner())
    return _READY[0]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end in code points, by start and then kind as in
    RULES; it is empty where nothing is found, as for null and empty text. Kinds
    may overlap each other. Repeated and null doc_ids keep their rows. Other
    columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            n = batch.num_rows
            counts, base, spans = np.zeros((BASE, n), np.int64), [nothing] * n, [""] * n
            for lo, hi in blocks(at):
                part, rows = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                for r, found in scan.scan(part, rows).items():
                    chars = char_index(part[rows[r] : rows[r + 1]])
                    said = [(k, f"{RULES[k][0]}:{chars[s]}:{chars[e]}") for s, k, e in found]
                    for k, _ in said:
                        if k < BASE:
                            counts[k, lo + r] += 1
                    base[lo + r] = hashlib.sha256(",".join(x for k, x in said if k < BASE).encode()).hexdigest()
                    spans[lo + r] = ",".join(x for _, x in said)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret (overlapping spans as one) replaced by [REDACTED]; all rows and columns stay. n_chars, if there, follows the text."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner()
        for column in texts:
            raw, at = text_bytes(column)
            changed: dict[int, str] = {}
            for lo, hi in blocks(at):
                part, rows = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                for r, found in scan.scan(part, rows).items():
                    data, kept, done = part[rows[r] : rows[r + 1]].tobytes(), [], 0
                    for s, _, e in found:
                        if s > done or not kept:
                            kept += [data[done:s], b"[REDACTED]"]
                        done = max(done, e)
                    changed[lo + r] = b"".join([*kept, data[done:]]).decode()
            values = column.to_pylist() if changed else None
            for r, text in changed.items():
                values[r] = text
            yield pa.array(values, pa.string()) if changed else column

    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)

    column.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn("text", F.arrow_udf(column, "string")("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def op5_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
