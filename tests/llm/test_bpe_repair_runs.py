"""Byte-level BPE, conversation repair and periodic runs against the library and plain Python."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from clauseq.llm import byte_bpe, periodic_runs, turn_repair

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, ids string, text_key int, chunk int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    parts = ["don't", "'s", "'re", "we'll", " '", "''", "12", "345", " 6", "été", "中文字", " ", "　", "\x1c", "\x85", "﻿", "é", "࢏", "\U00011de0", "՘", "😀", "  ", "\n\n", " \n", "\t", "x", "!", "...", "<|endoftext|>"]
    out = [None, "", " ", "\n", "'", "'r", "a" * 5000, " " * 3000 + "x", "\n" * 700, "'" * 900, "ab " * 2000, "1" * 1500, "中" * 1200 + "。" + "文" * 900]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    return out + out[-3:]


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (64, 8), (7, 1)])
def test_ranks_as_the_library(spark, library, chunk, overlap):
    path, enc = library
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i % 11 else None, t, "clash", 1, 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = byte_bpe.encode_decode_ranks(docs, path, True, chunk, overlap).collect()
    want = []
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want.append((i if i % 11 else -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(enc.decode_bytes(ids)), ids, (t or "").encode()))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"]), bytes(r["decoded"])) for r in got) == sorted(want)


def test_ranks_of_very_long_and_no_texts(spark, library):
    path, enc = library
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    long = " ".join(rng.choice(["alpha", "l'été", "42", "Wort,"]) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, word), (3, long), (3, long), (4, long + word)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in byte_bpe.encode_decode_ranks(docs, path).collect())
    hashes = [sha(np.array(enc.encode_ordinary(t), "<u4").tobytes()) for t in (long, word, long, long, long + word)]
    assert got == sorted(zip([1, 2, 3, 3, 4], hashes, strict=True))
    empty = byte_bpe.encode_decode_ranks(docs.limit(0), path)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# --- conversations

TURNS = "conv_id long, turn long, role string, text string, step int, audit string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """All of one conversation's rows after damage, by cheapest (cost, audit) over all edit sequences."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        t = text.rstrip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    target = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for row, fault in zip(reversed(rows), reversed(faults), strict=True):
        own = {}
        for s in target:
            ways = [(2 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (s, row[2][:1]) in fits:
                    to = best[fits[s, row[2][:1]]]
                    ways.append((extra + to[0], "K" + to[1]))
                to = best[target[s]]
                ways.append((extra + 1 + to[0], "R" + to[1]))
            own[s] = min(ways)
        for _ in range(4):
            own = {s: min(own[s], (5 + own[target[s]][0], "I" + own[target[s]][1])) for s in own}
        best = own
    cost, audit = best[""]
    state, at, said = "", 0, []
    names = {"u": "user", "a": "assistant"}
    for edit in audit:
        if edit == "I":
            state = target[state]
            said.append(f"{names[state]}:")
            continue
        row, at = rows[at], at + 1
        if edit == "K":
            state = fits[state, row[2][:1]]
            said.append(f"{row[2]}:{row[3]}")
        elif edit == "R":
            state = target[state]
            said.append(f"{names[state]}:{row[3]}")
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)), "\n".join(said)


def conversations():
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Hello.", "What?", "no end", "", " \n", None, "One! ", "Two.\t", "été.", "x" * 3000 + "."]
    out = []
    for conv in range(160):
        usual = rng.random() < 0.5
        for turn in range(rng.randint(0, 14)):
            role = ("user", "assistant")[turn % 2] if usual and rng.random() < 0.8 else rng.choice(roles)
            text = f"Turn {turn}." if usual and rng.random() < 0.7 else rng.choice(texts)
            out.append((conv if conv % 40 else None, rng.choice([turn, turn + 1, None]) if rng.random() < 0.2 else turn, role, text))
    return out


def repaired(spark, rows, parts):
    turns = spark.createDataFrame([(*r, 1, "clash") for r in rows], TURNS).repartition(3)
    return turn_repair.played(turn_repair.damage(turns), turns, parts, False).collect(), turn_repair.played(turn_repair.damage(turns), turns, parts, True).collect()


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_repair_as_all_edit_sequences(spark, parts):
    rows = conversations() + [(900, t, r, x) for t, (r, x) in enumerate([("user", "Same."), ("assistant", "Other.")] * 40)]
    rows += [(901, 0, "user", "All equal.")] * 50 + [(902, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]
    byconv = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        byconv[r[0]].append(r)
    report, turns = repaired(spark, rows, parts)
    assert len(report) == len(byconv)
    said = {}
    for r in sorted(turns, key=lambda r: r["position"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in report:
        *want, text = plain_repair(byconv[r["conv_id"]])
        assert list(r)[1:] == want
        assert "\n".join(said.get(r["conv_id"], [])) == text


def test_repair_of_no_and_lost_turns(spark):
    lost = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    report, turns = repaired(spark, [(lost, 0, "user", "Gone.")], 3)
    assert [tuple(r) for r in report] == [(lost, 0, 0, 0, 0, 0, 0, "", sha(""))] and turns == []
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_report(none).count() == 0 and turn_repair.repair_turns(none).count() == 0


# --- runs


def plain_runs(w):
    """Every run by its definition: for each period, the longest stretches; then those without a smaller period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def run_texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "a", "a " * 6, "a " * 5, "ab ab ab ab", "a b " * 4, "A a " * 9, "  x y " * 5, "x " * 4000]
    for _ in range(300):
        few = rng.choice([1, 2, 3, 8, 60])
        t = []
        while len(t) < rng.randint(1, 160):
            piece = [f"w{rng.randint(1, few)}" for _ in range(rng.randint(1, 12))]
            t += piece * rng.choice([1, 1, 2, 4, 5, 9])
        out.append(rng.choice([" ", "\n", "  \t"]).join(t))
    return out + out[-2:]


@pytest.mark.parametrize("plant", [True, False])
def test_runs_by_definition(spark, plant):
    rows = [(i if i % 50 else None, t, "clash", 1, 2) for i, t in enumerate(run_texts())]
    got = sorted(periodic_runs.find_runs(spark.createDataFrame(rows, DOCS).repartition(4), plant).collect(), key=str)
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = planted(i, w) if plant and i is not None else w
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)), len(w), len(gone)))
    assert sorted(str(tuple(r)[:-1]) for r in got) == sorted(map(str, want))
    assert all(len(r["runs"]) == r["n_runs"] for r in got)


def test_runs_of_long_and_no_texts(spark):
    rng = random.Random(1)
    period = " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(20_000)) + " "
    docs = spark.createDataFrame([(1, "lead " + period * 6 + "end"), (2, "z " * 300_000), (3, "p q " * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodic_runs.find_runs(docs).collect()}
    assert got == {1: (1, 1, 120_000, 20_000), 2: (1, 0, 300_000, 1), 3: (1, 0, 200_000, 2)}
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
