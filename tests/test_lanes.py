"""The lanes against plain Python."""

import hashlib
import random
import re

from clauseq.operators import lanes, stages

HITS = "query_id long, id string, score double, rank long, number string, identifier string, edition string"


def in_scope(number, identifier, scope):
    if number == scope:
        return True
    if "-" not in scope or number != scope.split("-")[0]:
        return False
    bare = re.sub(r":\d+$", "", re.sub(r"\s*\([A-Z]\)\s*$", "", identifier or "")).strip()
    return bare.split()[-1].lower() == scope.lower() if bare else False


def plain_dense(hits, scope, pin, near=50, keep=10):
    hits = sorted(hits, key=lambda h: h[3])
    top = [h for h in hits if h[3] <= near]
    if not scope:
        return [h[1] for h in top], "plain"
    ours = [h for h in top if in_scope(h[4], h[5], scope) and (not pin or not h[6] or h[6] == pin)]
    way = "scoped"
    if not ours:
        ours, way = [h for h in hits if h[3] <= 100 and in_scope(h[4], h[5], scope)], "deep"
    if pin and len(ours) < 3:
        both = [h for h in top if in_scope(h[4], h[5], scope)]
        if len(both) > len(ours):
            ours, way = both, "dropped"
    got = [h[1] for h in ours]
    return got + ([h[1] for h in top if h[1] not in got] if len(got) < keep else []), way


def test_dense_takes_each_way(spark):
    rng = random.Random(5)
    hits, filters, want = [], [], {}
    for q in range(200):
        ranks = list(range(1, rng.choice([0, 3, 40, 100, 100]) + 1))
        rare = rng.random() < 0.5
        mine = []
        for r in ranks:
            number = rng.choice(["60", "76", "134"]) if not rare or r > 50 else "60"
            part = rng.choice(["", "-1", "-2", "-A"])
            mine.append((q, f"h{r}", 1.0 / r, r, number if rng.random() > 0.02 else None, rng.choice([f"Std R {number}{part}:2001 (E)", f"R {number}{part} (F) ", None, "", f"r {number}{part.lower()}"]), rng.choice([None, "", "1992", "2006"])))
        scope, pin = rng.choice([None, "", "60", "76", "134-2", "60-a", "99"]), rng.choice([None, "", "1992", "1800"])
        hits += mine
        filters.append((q, scope, pin))
        want[q] = plain_dense(mine, scope, pin)
    rng.shuffle(hits)
    got = {}
    out = lanes.dense(spark.createDataFrame(hits, HITS).repartition(5), spark.createDataFrame(filters, "query_id long, scope string, pin string")).collect()
    for r in sorted(out, key=lambda r: r["pos"]):
        got.setdefault(r["query_id"], ([], r["way"]))[0].append(r["id"])
        assert r["edition_dropped"] == (r["way"] == "dropped")
    assert got == {q: v for q, v in want.items() if v[0]}
    assert {w for _, w in want.values()} == {"plain", "scoped", "deep", "dropped"}


def test_lanes_count_their_first_hits_before_the_known_ones_go(spark):
    pool = spark.createDataFrame([(1, f"p{i}", float(9 - i), i) for i in range(1, 4)], "query_id long, id string, score double, pos int")
    lane = spark.createDataFrame([(1, x, 8.0, i) for i, x in enumerate(["p1", "a", "p2", "b", "c", "d"], 1)] + [(2, "z", 4.0, 1)], "query_id long, id string, score double, pos int")
    got = sorted(tuple(r) for r in stages.run_stages(pool, {"graph-ppr": {"lane": lane}}).where("pos > 3 OR query_id = 2").collect())
    assert got == [(1, "a", 3.0, 4), (1, "b", 3.0, 5), (1, "c", 3.0, 6), (2, "z", 1.5, 1)]
    assert [r["id"] for r in stages.run_stages(pool, {"concept-graph": {"lane": lane}}).where("pos > 3").collect()] == ["a"]


def test_federation_keeps_every_hit(spark):
    pool = spark.createDataFrame([(1, "p", 1.0, 1)], "query_id long, id string, score double, pos int")
    lane = spark.createDataFrame([(1, f"x{i}", 1.0, i) for i in range(1500)], "query_id long, id string, score double, pos int")
    got = stages.run_stages(pool, {"federate": {"lane": lane}})
    assert got.count() == 1501 and got.agg({"pos": "max"}).first()[0] == 1501


def test_glossary_spellings_and_floor(spark):
    rows = [(1, 1, 0.9, 0.2, "Weigh labeler", "Weigh labeler — a machine — that labels"), (1, 2, 0.8, 0.9, "weigh  Labeller!", "x — second"), (1, 3, 0.7, 0.5, "actual quantity", "actual quantity — what is there"), (1, 4, 0.4, 0.9, "low", "low — below the floor"), (1, 5, 0.6, -0.1, "neg", "neg — no"), (2, 6, 0.9, 0.9, "sixth", "sixth — too far"), (2, 1, 0.9, 0.9, "bare", "without a definition"), (2, 2, 0.9, 0.9, None, "a — b")]
    got = lanes.glossary(spark.createDataFrame(rows, "query_id long, rank int, cosine double, score double, title string, text string")).collect()
    assert sorted((r["place"], r["term"], r["definition"]) for r in got) == [(1, "actual quantity", "what is there"), (2, "Weigh labeler", "a machine — that labels")]


def test_units_by_id(spark):
    units = spark.createDataFrame([("s", f"n{i:02}") for i in range(60)] + [("t", "n")], "standard string, node_id string")
    key = lambda s, n: "m" + hashlib.sha1(f"{s}|{n}".encode()).hexdigest()[:16]
    stored = spark.createDataFrame([(key("s", f"n{i:02}"), f"unit {i}") for i in range(0, 60, 2)], "id string, title string")
    pool = spark.createDataFrame([(1, key("s", "n02"), 7.0, 1, "here", None)], "query_id long, id string, score double, pos int, title string, rerank double")
    entitled = spark.createDataFrame([(1, "s"), (1, "s"), (2, "t"), (3, None)], "query_id long, standard string")
    got = lanes.licensed_lane(pool, entitled, units, stored).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["here"] + [f"unit {i}" for i in range(0, 40, 2) if i != 2] and {r["score"] for r in got[1:]} == {0.5}
    assert lanes.by_ids(stored, spark.createDataFrame([("x",), (key("s", "n00"),), (key("s", "n00"),)], "id string")).count() == 1


def test_cosine_search_compares_tiles_and_keeps_ties_in_order(spark):
    import numpy as np

    from clauseq.operators import vectors

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(vectors.TILE + 40, 3)), rng.normal(size=(20, 3)).repeat(9, 0), np.zeros((2, 3))])
    ids = rng.permutation(len(x))
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)] + [(-1, None)], "vec_id long, embedding array<double>").coalesce(1)
    got = vectors.cosine_topk(v, v.selectExpr("vec_id AS query_id", "embedding"), 4)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    with np.errstate(invalid="ignore"):
        s = np.round(x @ x.T / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((x * x).sum(1))), 6)
    assert len(found) == len(x) - 2
    for i, q in enumerate(ids):
        want = sorted((-s[i, j], ids[j]) for j in range(len(x)) if j != i and np.isfinite(s[i, j]))[:4]
        assert [found.get(int(q), {}).get(n + 1) for n in range(len(want))] == [(int(j), -float(p)) for p, j in want]
