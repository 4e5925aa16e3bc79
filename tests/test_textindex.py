"""The stemmed index against a full-text engine of the standard library, and against a rebuild."""

import random
import sqlite3

import pytest

from clauseq.functions.porter import porter
from clauseq.operators.textindex import TextIndex

ENDS = "s es ies sses ed eed ing y ational tional enci anci izer logi bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize e ll".split()


def words():
    rng = random.Random(3)
    roots = "run fli hop fall agre plast motor conflat trouble siz tann hiss fizz fil happ sky rel condition ration valenc hesit digit conform radical differ vil analog vietnam predic oper feudal decis hope callous formal sensit sensib triplic form electr good reviv allow infer airlin gyroscop adjust defens irrit replac depend adopt homolog communis activ angular effect bowdl prob rat ceas control roll y yy syzyg ay toy".split()
    made = {r + a for r in roots for a in ENDS} | {r + a + b for r in roots for a in rng.sample(ENDS, 12) for b in rng.sample(ENDS, 6)}
    made |= {"".join(rng.choice("aeioubcdlstyz") for _ in range(rng.randint(1, 9))) for _ in range(4000)}
    return sorted(made | {"ab", "x", "3rd", "x2ing", "ßing", "straße", "a" * 63, "b" * 64 + "ing", "яing", "caresses", "ponies"})


@pytest.fixture(scope="module")
def engine():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    return db


def test_stems(engine):
    w = words()
    engine.execute("CREATE VIRTUAL TABLE s USING fts5(x, tokenize='porter unicode61')")
    engine.execute("CREATE VIRTUAL TABLE v USING fts5vocab(s, 'instance')")
    engine.executemany("INSERT INTO s(rowid, x) VALUES (?, ?)", list(enumerate(w)))
    want = dict(engine.execute("SELECT doc, term FROM v"))
    assert {x: porter(x) for x in w} == {x: want[i] for i, x in enumerate(w)}


def corpus(seed, n):
    rng = random.Random(seed)
    some = "measure measuring measured test tests testing instrument instruments electrical relation relational naïve Été error_limit load-cell cell load the of 42 class classes".split()
    texts = [None, "", "  ", "the of"] + [" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) + rng.choice([".", "", " load-cell"]) for _ in range(n)]
    return dict(enumerate(texts))


ASKED = ["measuring the instruments", "load-cell error_limit", "relational TEST tests", "été naive", "unknown", "", None, "__ of the", "cell load class 42"]


def ranked(engine, docs):
    engine.execute("DELETE FROM t")
    engine.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(k, v or "") for k, v in docs.items()])
    from clauseq.functions.tokens import STOP
    import re

    out = []
    for q, text in enumerate(ASKED):
        terms = [t for t in re.sub(r"[^\w\s-]", " ", (text or "").lower()).split() if 2 <= len(t) <= 40 and t not in STOP]
        match = " OR ".join(f'"{t}"' for t in list(dict.fromkeys(terms))[:12])
        rows = engine.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall() if match else []
        rows = sorted(((round(b, 6), d) for d, b in rows))[:10]
        out += [(q, d, b, i + 1) for i, (b, d) in enumerate(rows)]
    return out


def searched(index, spark, **kw):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")
    return sorted((r["query_id"], r["doc_id"], r["bm25"], r["rank"]) for r in index.search(asked, 10, **kw).collect())


def close(got, want):
    key = lambda r: (r[0], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    return len(got) == len(want) and all(a[:2] + a[3:] == b[:2] + b[3:] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_rank_update_and_compaction(spark, engine, tmp_path):
    docs = corpus(1, 150)
    frame = lambda d: spark.createDataFrame([(k, v, "clash") for k, v in d.items()] + [(None, "no id", "x")], "doc_id long, text string, term string").repartition(3)
    index = TextIndex(spark, str(tmp_path / "index"), slots=4)
    assert searched(index, spark) == [] and index.documents().count() == 0
    index.upsert(frame(docs))
    assert close(searched(index, spark), ranked(engine, docs))
    changed = {k: f"{v} measures" for k, v in corpus(2, 40).items() if k % 2} | {900: "a relational load-cell"}
    index.upsert(frame(changed))
    index.delete(spark.createDataFrame([(3,), (10,), (11,), (11,), (5000,)], "doc_id long"))
    docs |= changed
    docs = {k: v for k, v in docs.items() if k not in (3, 10, 11)}
    want = ranked(engine, docs)
    assert close(searched(index, spark), want) and index.documents().count() == len(docs)
    index.compact()
    assert len(index.generations()) == 1 and close(searched(index, spark), want) and index.documents().count() == len(docs)
    index.upsert(frame({10: "measuring again"}))
    docs[10] = "measuring again"
    assert close(searched(index, spark), ranked(engine, docs))
    few = spark.createDataFrame([(10,), (12,), (12,)], "doc_id long")
    assert {r[1] for r in searched(index, spark, within=few)} <= {10, 12}
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")
    assert {r["score"] for r in index.search(asked, constant=True).collect()} == {1.0}


def test_an_unfinished_generation_counts_for_nothing(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "broken"), slots=2)
    index.upsert(spark.createDataFrame([(1, "measure")], "doc_id long, text string"))
    (tmp_path / "broken" / "touched" / "gen=2").mkdir()
    spark.createDataFrame([(1, 1, "other", 1, [0], 0)], "doc_id long, dl long, term string, tf long, places array<int>, slot int").write.partitionBy("slot").parquet(str(tmp_path / "broken" / "postings" / "gen=2"))
    assert [(r[0], r[1]) for r in searched(index, spark)] == [(0, 1)]
    index.upsert(spark.createDataFrame([(2, "measures")], "doc_id long, text string"))
    assert index.generations() == [1, 3] and {r[1] for r in searched(index, spark)} == {1, 2}


def test_only_the_slots_of_asked_terms_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "slots"), slots=8)
    index.upsert(spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "doc_id long, text string"))
    plan = index.postings(["common"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,common)" in plan.replace("In(term, [common])", "EqualTo(term,common)")


def test_sql_stems_as_the_stemmer_does():
    """A y behind a consonant is a vowel before a vowel too, a y at the start never."""
    import duckdb

    from clauseq.fulltext import _stems_sql

    db = duckdb.connect()
    made = [w for w in words() if w.isascii()] + ["lyone", "thlyating", "lyedes", "ynciiue", "ygaue", "ynieuell", "yyones"]
    db.execute("CREATE TABLE every (word VARCHAR)")
    db.executemany("INSERT INTO every VALUES (?)", [[w] for w in made])
    got = dict(db.execute(f"WITH {_stems_sql('every')} SELECT word, stem FROM stem").fetchall())
    assert {w: s for w, s in got.items() if s != porter(w)} == {}


def test_search_and_search_in_sets_from_one_scoring(spark, tmp_path, monkeypatch):
    docs = corpus(11, 300)
    index = TextIndex(spark, f"{tmp_path}/both", slots=3)
    index.upsert(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")
    numbers = spark.createDataFrame([(d, f"n{d % 5}") for d in docs if d % 9], "doc_id long, number string")
    sets = spark.createDataFrame([(q, f"n{q % 3}") for q in range(6)] + [(0, "n4"), (0, "n4"), (1, "none")], "query_id long, number string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for k, of_sets in ((4, 12), (12, 3)):
        scored, calls = TextIndex.scored, []
        monkeypatch.setattr(TextIndex, "scored", lambda self, a: calls.append(1) or scored(self, a))
        near, within = index.search_both(asked, numbers, sets, k, of_sets)
        assert len(calls) == 1
        monkeypatch.undo()
        assert rows(near) == rows(index.search(asked, k)) and rows(within) == rows(index.search_sets(asked, numbers, sets, of_sets)) and within.count() > of_sets


def test_postings_stay_where_they_are_made_and_pairs_are_not_shuffled(spark, tmp_path):
    """A load writes a document's postings by the task that read it; a search moves hits once, by document."""
    from pyspark.sql import functions as F

    index = TextIndex(spark, f"{tmp_path}/near", slots=4)
    index.upsert(spark.createDataFrame([(i, f"word{i} common measure{i % 7}") for i in range(60)], "doc_id long, text string").repartition(3, "doc_id"))
    by = spark.read.parquet(f"{tmp_path}/near/postings/gen=1").withColumn("task", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1))
    assert by.groupBy("doc_id").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0 and by.count() == 180
    asked = spark.createDataFrame([(1, "common word3"), (2, "measure2 load-cell")], "query_id long, text string")
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("hashpartitioning(query_id" in line and "doc_id" in line for line in plan.splitlines())


def test_a_batch_is_taken_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from clauseq.operators import textindex

    monkeypatch.setattr(textindex, "PIECE", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["abcd", "efgh", None, "i" * 50, "", "jk", "lmnopqrst"]})
    got = [p.column("doc_id").to_pylist() for p in textindex.pieces(batch)]
    assert sum(got, []) == list(range(7)) and len(got) > 2 and [p.num_rows for p in textindex.pieces(batch.slice(0, 0))] == []
