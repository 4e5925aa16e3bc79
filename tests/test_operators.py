"""Operators whose rules are folds, stores and streams, against plain Python."""

import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from clauseq.operators import chunking, evaluate, stages
from clauseq.plans.versions import VersionedTable
from clauseq.sources import asciidoc, jsonl
from clauseq.streaming import counters


def pool(spark, hits):
    """hits: (query_id, pos, id, doc, anchor, score, text)."""
    return stages.as_pool(spark.createDataFrame(hits, "query_id long, pos int, id string, doc string, anchor string, score double, text string"))


def test_chain_dedup(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta".split()
    hits = []
    for q in range(40):
        for pos in range(1, rng.randint(2, 9)):
            anchor = rng.choice(["1", "1.2", "1.2.3", "2", "2.1", "overview", None])
            hits.append((q, pos, f"h{pos}", rng.choice("ab"), anchor, rng.random(), " ".join(rng.sample(words, rng.randint(1, 5)))))
    want = set()
    for q in range(40):
        mine, gone = [h for h in hits if h[0] == q], set()
        for i, a in enumerate(mine):
            if a[4] in (None, "overview") or i in gone:
                continue
            for j in range(i + 1, len(mine)):
                b = mine[j]
                if b[4] in (None, "overview") or j in gone or a[3] != b[3]:
                    continue
                x, y = set(a[6].split()), set(b[6].split())
                if (b[4].startswith(a[4] + ".") or a[4].startswith(b[4] + ".")) and len(x & y) / len(x | y) >= 0.5:
                    gone.add(j if a[5] >= b[5] else i)
        want |= {(h[0], h[1]) for i, h in enumerate(mine) if i not in gone}
    got = {(r["query_id"], r["pos"]) for r in stages.chain_dedup(pool(spark, hits)).collect()}
    assert got == want and len(want) < len(hits)


def test_runner_keeps_the_order_of_the_registry(spark):
    hits = [(1, 1, "a", "x", "overview", 1.0, ""), (1, 2, "b", "x", "1", 0.9, ""), (1, 3, "c", "y", "2", 0.1, "")]
    p = pool(spark, hits).withColumn("family", F.col("doc"))
    got = stages.run_stages(p, {"window-floor": {}, "rerank": {"scored": F.col("score")}, "overview-demote": {}}).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["b", "a"]
    with pytest.raises(ValueError, match="unknown stages: nothing"):
        stages.run_stages(p, {"nothing": {}})
    assert stages.license_scope(p.withColumn("standard_key", F.when(F.col("id") == "a", "k")), []).count() == 2
    assert stages.run_stages(p.limit(0), {"diversity": {}, "edition-steer": {}, "dedup": {}, "structural-propagate": {}}).count() == 0


def test_split_long(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("x" * rng.randint(0, 60) + " " for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["y" * 205, ""]
    want = {}
    for k, t in enumerate(texts):
        parts = []
        for p in (p.strip(" ") for p in t.split("\n\n")):
            for piece in [p[i : i + 50] for i in range(0, len(p), 50)]:
                if parts and len(parts[-1]) + 2 + len(piece) <= 50:
                    parts[-1] += "\n\n" + piece
                else:
                    parts.append(piece)
        want[k] = parts
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert {r["k"]: r["p"] for r in rows.select("k", chunking.split_long(F.col("t"), 50).alias("p")).collect()} == want


def test_compress(spark):
    text = "First one stays. The torque is 5 Nm. Nothing here at all! Torque and speed matter; speed only.\nLast line of speed 7"
    terms = {"torque", "speed"}
    sentences = [s.strip() for s in re.split(r"(?<=[.!?;])\s+|\n+", text) if s.strip()]

    def worth(s):
        w = [x for x in re.split("[^a-z0-9]+", s.lower()) if x]
        return len(set(w) & terms) / math.sqrt(len(w)) + (0.35 if re.search("[0-9]", s) else 0)

    order, used, kept = sorted(range(1, len(sentences)), key=lambda i: (-worth(sentences[i]), i)), len(sentences[0]), {0}
    for i in order:
        if used + len(sentences[i]) <= 60:
            used += len(sentences[i])
            kept.add(i)
    row = spark.createDataFrame([(text,), ("",)], "t string").select(chunking.compress(F.col("t"), F.array(*map(F.lit, sorted(terms))), 60).alias("c")).collect()
    assert row[0]["c"] == " ".join(sentences[i] for i in sorted(kept)) and row[1]["c"] == ""


def test_flip_point_and_bands(spark):
    r = spark.createDataFrame([(2.0,), (70.0,)], "v double").select(evaluate.flip_point(F.col("v"), lambda v: 10 - v).alias("f"), evaluate.decision_band(F.col("v") / 100).alias("b")).collect()
    assert abs(r[0]["f"] - 10) < 0.02 and r[1]["f"] is None and [x["b"] for x in r] == ["not-met", "unclear"]


def test_versioned_table_and_jsonl(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert table.rows() is None
    table.write(spark.createDataFrame([(1, "a")], "k long, v string"))
    table.write(table.rows().union(spark.createDataFrame([(2, "b")], "k long, v string")))
    assert len(table.versions()) == 2 and table.rows().count() == 2
    table.clear()
    assert table.rows().count() == 0
    assert jsonl.read_jsonl(spark, f"{tmp_path}/none", "k long").count() == 0
    (tmp_path / "x.jsonl").write_text('{"k": 1}\nnot json\n' + json.dumps({"k": 3}) + "\n")
    assert [r["k"] for r in jsonl.read_jsonl(spark, f"{tmp_path}/x.jsonl", "k long", tolerant=True).orderBy("k").collect()] == [1, 3]
    jsonl.write_jsonl(spark.range(3), f"{tmp_path}/y")
    jsonl.write_jsonl(spark.range(2), f"{tmp_path}/y", append=True)
    assert jsonl.read_jsonl(spark, f"{tmp_path}/y", "id long").count() == 5


def test_asciidoc(spark):
    text = "= My title\n:Edition: 2\n:lang: en\n:edition: 3\n\nintro\n== Scope\nIt covers.\n\n== Terms\n|===\n|a |b\n|1 |2\n|===\n"
    d = spark.createDataFrame([(1, text), (2, "plain")], "k long, t string")
    r = d.select(asciidoc.title(F.col("t")).alias("title"), asciidoc.attributes(F.col("t")).alias("a")).collect()
    assert (r[0]["title"], r[0]["a"], r[1]["title"], r[1]["a"]) == ("My title", {"edition": "3", "lang": "en"}, None, {})
    assert [(x["k"], x["pos"], x["title"]) for x in asciidoc.sections(d, "k", "t").orderBy("pos").collect()] == [(1, 1, "Scope"), (1, 2, "Terms")]
    assert [x["cells"] for x in asciidoc.tables(d, "k", "t").orderBy("row").collect()] == [["a", "b"], ["1", "2"]]


def test_stream_counters_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    table = VersionedTable(spark, f"{tmp_path}/counts")
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("day", F.to_date("ts"))
        counters.keep_counters(stream, ["user_id", "day"], table, f"{tmp_path}/ck").awaitTermination()
    want = {(r["user_id"], r["day"]): r["used"] for r in counters.daily_counters(events, "user_id").collect()}
    assert {(r["user_id"], r["day"]): r["used"] for r in table.rows().collect()} == want
    week = {(r["user_id"], r["until"]): r["n"] for r in counters.rolling_reports(events, "user_id").collect()}
    user, day = min(week)
    assert week[user, day] == sum(n for (u, d), n in want.items() if u == user and day - datetime.timedelta(7) <= d < day)


def test_words_of_a_language_sample_are_made_once(spark):
    from pyspark.sql import functions as F

    from clauseq.operators import language

    t = spark.createDataFrame([("the cat and the dog in the house of " * 30,), ("der Hund und das Haus ist von " * 40,), (None,)], "text string")
    got = t.select(language.stopword_language(F.col("text")).alias("d"), language.unit_language(F.col("text")).alias("u"))
    assert [tuple(r) for r in got.collect()] == [("en", "en"), ("de", "de"), (None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[a-zà-öø-ÿ]+") == 2


def test_an_order_pool_is_grouped_and_ranked_where_its_order_is(spark):
    from clauseq import retrieval

    plan = retrieval.pool(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_two_rankings_make_the_frequencies_of_terms_once(spark):
    from clauseq.operators import lexical

    docs = spark.createDataFrame([(i, f"red steel w{i % 7} of w{i % 3} red") for i in range(40)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red w2"), (2, "the steel w1 w6")], "query_id long, text string")
    got = lexical.rrf([lexical.bm25_topk(docs, asked), lexical.overlap_topk(docs, asked)])
    assert got.count() == 20
    df = got.groupBy("query_id").count()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") + final.count("ReusedQueryStage") >= 1 and final.count("Generate explode(filter(") <= 2, final.count("Generate explode(filter(")
