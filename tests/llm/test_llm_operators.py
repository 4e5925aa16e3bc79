"""The operators against plain Python on small tables with nulls, empty, repeated and long texts."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from clauseq.llm import bpe_chunks, exact_dedup, fingerprints, language_id, ngram_join, packing, repeats, secret_scan, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"


def corpus():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "été", "naïve", "x1", "secret:", "abcdef12", "token=qwerty99"]
    texts = [None, "", " \n ", "one", "One", "a b c", "A  b\tc", "\u2028 ß 中文", "AKIA" + "B" * 20, "f" * 40 + " password = 'hunter22'"]
    base = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(120))
    texts += [base, base, base.upper(), base.replace(" ", "  "), base + " tail", "head " + base, base[: len(base) // 2], "y" * 900, base * 20]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [(i, t, "en" if i % 3 else "fr", "s", len(t or ""), "k", 1) for i, t in enumerate(texts)] + [(None, "orphan text here now ok", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in corpus()}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 40)])
def test_ngram_join(docs, width, percent):
    sets = {k: shingles(t, width) for k, t in TEXTS.items() if k is not None}
    least = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs, width, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == {k: (len(sets[k]), least[k]) for k in sets}


def test_bpe(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    for r in bpe_chunks.encode_decode(docs, path).collect():
        ids = tok.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    pieces, windows = {}, {}
    for r in packing.pack_default(docs).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(TEXTS)
    for k, rows in pieces.items():
        ids, at = np.array([*tok.encode(TEXTS[k], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for rows in windows.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def test_secrets(docs):
    for r in secret_scan.find_secrets(docs).collect():
        t = TEXTS[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_redaction_keeps_rows_and_columns(docs):
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "hunter22" not in "".join(r["text"] or "" for r in out.collect())


def test_repeats(docs):
    rows = [(k, t.encode()) for k, t in TEXTS.items()]
    seen = {}
    for _, b in rows:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[k]["n_removed"], got[k]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest())


def test_exact_dedup(docs):
    groups = {}
    for k, t in TEXTS.items():
        if k is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(k)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
    for same in groups.values():
        for k in same:
            assert got[k] == (min(same), len(same), k == min(same))
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) + 1


def test_index_drops_what_it_knows(spark, docs):
    index = exact_dedup.DigestIndex(spark, "known_digests", 4)
    exact_dedup.exact_dedup(docs, index).count()
    again = docs.selectExpr("doc_id + 1000 AS doc_id", "text").where("doc_id IS NOT NULL")
    assert exact_dedup.exact_dedup(again, index).where("kept").count() == 0


def test_exact_dedup_of_repeated_rows_and_clashing_columns(spark):
    rows = [(3, "a b"), (1, "a  b"), (1, "a b"), (1, "a b"), (None, "a b"), (None, None), (None, ""), (7, "z"), (7, "z"), (7, "y")] + [(i, "hot") for i in range(100, 130)]
    t = spark.createDataFrame([(d, x, "s", "h", 1) for d, x in rows], "doc_id long, text string, sha string, _digest string, _id int").repartition(3)
    got = exact_dedup.exact_dedup(t).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["group_size"]) for r in got if r["kept"] and r["doc_id"] is not None) == [(1, 5), (7, 1), (7, 2), (100, 30)]
    assert [r["group_size"] for r in got if r["kept"] and r["doc_id"] is None] == [2]
    kept = exact_dedup.keep_first_copies(t)
    assert kept.columns == t.columns and {r["_id"] for r in kept.collect()} == {1}
    assert sorted((r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in kept.collect()) == [(0, ""), (1, "a b"), (7, "y"), (7, "z"), (100, "hot")]


def test_copies_of_one_row_come_back_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    t = spark.createDataFrame([(None, None)] * 50 + [(1, "x")] * 14 + [(2, "x")], "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(t).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 50, True)] + [(None, 50, False)] * 49 + [(1, 15, True)] + [(1, 15, False)] * 13 + [(2, 15, False)]))


def test_fingerprints(docs):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    ids = sorted((k for k in TEXTS if k is not None), reverse=True) + [None]
    for n, k in enumerate(ids):
        text, after = TEXTS[k], TEXTS[ids[(n + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text, 5), shingles(edited, 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[k]["near_edited"] - true) < 0.25
    assert rows[10]["fingerprint"] == rows[11]["fingerprint"]


def plain_fingerprint(text):
    """One-permutation MinHash in plain Python: the same hashes, one pass, then each empty bin's own series."""

    def h64(seed, *values):
        for v in values:
            raw = v.encode() if isinstance(v, str) else v
            seed = xxhash.xxh64(raw, seed=seed & (2**64 - 1)).intdigest()
        return seed - 2**64 if seed >= 2**63 else seed

    long, int_ = (lambda v: struct.pack("<q", v)), (lambda v: struct.pack("<i", v))
    words = [h64(42, w) for w in re.split(r"[\x20\x09-\x0D]+", text.lower().strip(" \t\n\x0b\x0c\r")) if w]
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = h64(42, *map(long, words[i : i + 5]))
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(128):
        tries = [least.get(b)] + [least.get(h64(42, int_(b), int_(k)) % 128) for k in range(16)]
        found = next((h for h in tries if h is not None), None)
        if found is None:
            found = min((h64(42, int_(b), int_(x)), h) for x, h in least.items())[1]
        out.append(f"{found & 255:02X}")
    return "".join(out)


def plain_likeness(a, b):
    if a == b or "" in (a, b):
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max(0.0, (same - 2**-8) / (1 - 2**-8))


def test_fingerprints_bin_by_bin(spark):
    texts = [*TEXTS.values(), "w " * 50_000, "same text twice", "same text twice"]
    rows = [(i // 2 * 2 if i % 9 == 0 else i, t, "clash", 5, "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, range int, key string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0], r[1].encode()), reverse=True)
    want = []
    for k, (doc_id, text, *_) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new = plain_fingerprint(text), plain_fingerprint(edited)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, round(plain_likeness(own, new), 9), round(plain_likeness(own, plain_fingerprint(after)), 9)))
    got = [(*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.fingerprint_documents(docs).collect()]
    assert sorted(got) == sorted(want)


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_language_without_letters(docs):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert [got[k] for k in (0, 1, 2)] == ["und"] * 3 and got[7] != "und"


def test_url_rules(spark):
    urls = [None, "none", "http://A.Example.net/en/1?x", "http://b.net", "http://b.net/", "https://example.com/de/#t", "http://notexample.com/de/", "x://o.org/fr/9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert [got[i]["rule"] for i in range(8)] == [None, None, "example.net/en/", None, "net/", "example.com/de/", None, "org/fr/"]
    assert (got[0]["host"], got[2]["host"], got[2]["path"]) == ("", "a.example.net", "/en/1")
    assert {got[i]["verdict"] for i in (4, 5)} == {"block"} and got[2]["verdict"] == got[7]["verdict"] == "allow"


def test_repeated_labelled_rows_train_once(spark):
    rows = [(i % 7, "the house and the garden " * (i % 3 + 1), "en") for i in range(60)] + [(100 + i, "ja talo joka on siellä", "fi") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.fit(docs.repartition(n)) for n in (1, 5)]
    assert len(models[0].landmarks) == 12 and np.array_equal(models[0].landmarks, models[1].landmarks) and np.allclose(models[0].weights, models[1].weights)


def test_more_empty_tables(spark, empty):
    import public_tokenizers as P

    assert bpe_chunks.encode_decode(empty, P.path("word_bpe_49k.json")).count() == 0
    assert secret_scan.find_secrets(empty).count() == 0 and secret_scan.redact_secrets(empty).count() == 0
    assert exact_dedup.keep_first_copies(empty).count() == 0 and ngram_join.keep_one_of_each(empty).count() == 0


def test_empty_tables(spark, empty):
    assert ngram_join.link_components(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert language_id.identify(empty).count() == 0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert packing.pack_default(empty).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
