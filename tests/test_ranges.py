"""Range joins against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauseq.operators import ranges

ENDS = "kind string, row_index long, low double, high double, open_low boolean, name string"


def holds(v, low, high, open_low):
    return v is not None and (low is None or v > low or (v == low and not open_low)) and (high is None or v <= high)


def tables(seed, few):
    rng = random.Random(seed)
    number = (lambda: float(rng.randint(0, 20))) if few else (lambda: round(rng.uniform(0, 1000), 2))
    ends = []
    for i in range(700):
        low = rng.choice([None, 5.0, number(), number(), number()]) if rng.random() < 0.3 else number()
        high = None if rng.random() < 0.05 else (low or 0.0) + rng.choice([0, 1, 30, 400]) * rng.random() if not few else number()
        ends.append((rng.choice(["a", "b", None]), rng.randint(0, 10**6), low, high, rng.choice([True, False, None]), f"n{i}"))
    values = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, 5.0, number(), number(), number(), -3.0, 2000.0])) for i in range(500)]
    return ends, values


@pytest.mark.parametrize("seed,few", [(1, False), (2, True)])
def test_first_and_all_intervals(spark, seed, few):
    ends, values = tables(seed, few)
    table, rows = spark.createDataFrame(ends, ENDS), spark.createDataFrame(values, "id long, kind string, v double")
    first = {r["id"]: r["name"] for r in ranges.first_interval(rows, "v", table, ["name"], ["kind"]).collect()}
    pairs = sorted((r["id"], r["name"]) for r in ranges.all_intervals(rows, "v", table.drop("row_index"), ["kind"]).collect())
    want_pairs = []
    for i, kind, v in values:
        fit = sorted((e[1], e[5]) for e in ends if kind is not None and e[0] == kind and holds(v, e[2], e[3], bool(e[4])))
        assert first[i] == (fit[0][1] if fit else None)
        want_pairs += [(i, name) for _, name in fit]
    assert len(first) == len(values) and pairs == sorted(want_pairs)


def test_an_end_that_all_intervals_share_stays_out_of_the_arrays(spark):
    ends = [("a", i, 0.0, float(i), False, "x") for i in range(3000)]
    table = spark.createDataFrame(ends, ENDS)
    axis = ranges.Axis(table)
    spans = ranges._spans(table, axis).selectExpr("explode(_part) AS s").groupBy("s").count()
    assert 0.0 in axis.cuts and spans.agg({"count": "max"}).first()[0] <= 4 * 2 * ranges.ENDS


def test_no_nested_loop_and_empty_tables(spark):
    ends, values = tables(3, False)
    table, rows = spark.createDataFrame(ends, ENDS), spark.createDataFrame(values, "id long, kind string, v double")
    plan = ranges.first_interval(rows, "v", table, ["name"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["name"] for r in ranges.first_interval(rows, "v", table.limit(0), ["name"], ["kind"]).collect()} == {None}
    assert ranges.all_intervals(rows, "v", table.limit(0).drop("row_index"), ["kind"]).count() == 0
    assert ranges.first_interval(rows.limit(0), "v", table, ["name"], ["kind"]).count() == 0


def test_sets_admit_all_that_they_name(spark):
    entries = spark.createDataFrame([("s", "temp", 20.0, 2.0), ("s", "hum", 50.0, 5.0), ("t", "temp", 23.0, 2.0), ("u", "other", 1.0, None)], "set_id string, kind string, centre double, tolerance double")
    stated = spark.createDataFrame([(1, "temp", 22.0), (1, "hum", 40.0), (2, "temp", 22.0), (3, "other", 1.0), (4, "temp", 90.0), (5, "temp", None)], "question long, kind string, value double")
    got = sorted(tuple(r) for r in ranges.admitted_sets(stated, entries).collect())
    assert got == [(1, "s", False), (1, "t", True), (2, "s", True), (2, "t", True), (3, "u", True)]


def test_repeated_intervals_are_not_sent_to_every_task_and_cuts_stay_out_of_plans(spark):
    ends = [("a", i, float(i), i + 500.0, False, "x") for i in range(3000)]
    table, rows = spark.createDataFrame(ends, ENDS), spark.createDataFrame([(1, "a", 700.5)], "id long, kind string, v double")
    pairs = ranges.all_intervals(rows, "v", table.drop("row_index"), ["kind"])
    plan = pairs._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and len(plan) < 50_000 and pairs.count() == 500


def test_nodes_cover_each_slot_of_a_span_once(spark):
    axis = ranges.Axis(spark.createDataFrame([("a", i, float(i), float(i), False, "x") for i in range(200)], ENDS))
    spans = [(a, z) for a in range(axis.last + 1) for z in range(a, axis.last + 1)]
    t = spark.createDataFrame(spans, "a int, z int")
    above = {r[0]: set(r[1]) for r in spark.range(axis.last + 1).select("id", axis.above(F.col("id"))).collect()}
    for a, z, nodes in t.select("a", "z", axis.nodes(F.col("a"), F.col("z"))).collect():
        assert [len(above[s] & set(nodes)) for s in above] == [int(a <= s <= z) for s in above] and len(nodes) == len(set(nodes))


def test_pairs_of_questions_and_sets_are_not_shuffled(spark):
    entries = spark.createDataFrame([(i, "temp", 20.0, float(i)) for i in range(50)] + [(7, "temp", 21.0, 9.0), (7, "hum", 1.0, 1.0)], "set_id long, kind string, centre double, tolerance double")
    stated = spark.createDataFrame([(1, "temp", 25.0), (1, "hum", 9.0), (2, "temp", 25.0), (None, "temp", 25.0)], "question long, kind string, value double")
    got = ranges.admitted_sets(stated, entries)
    assert sorted(map(tuple, got.collect())) == sorted([(q, s, (q, s) != (1, 7)) for q in (1, 2) for s in range(50) if s >= 5])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and not [x for x in plan.split("== Initial Plan ==")[0].splitlines() if re.search(r" Exchange hashpartitioning\(question.*set_id", x)]


def test_the_table_of_first_intervals_is_not_sent_to_every_task(spark, tmp_path):
    spark.createDataFrame([("a", i, float(i), i + 9.0, False, "x") for i in range(300)], ENDS).write.parquet(f"{tmp_path}/ends")
    spark.createDataFrame([(1, "a", 100.5)], "id long, kind string, v double").write.parquet(f"{tmp_path}/rows")
    got = ranges.first_interval(spark.read.parquet(f"{tmp_path}/rows"), "v", spark.read.parquet(f"{tmp_path}/ends"), ["name"], ["kind"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and [r["id"] for r in got.where("name = 'x'").collect()] == [1]


def test_first_intervals_are_looked_up_in_sections_not_in_lists(spark):
    # All ends lie in a few slots, and hundreds of intervals end in each.
    rng = random.Random(8)
    ends = [("a", rng.randint(0, 10**6), (x := rng.random() * 50), x + rng.random() * 9, rng.random() < 0.5, f"n{i}") for i in range(900)] + [("a", 5, 1e6, 2e6, False, "far")] * 2
    values = [(i, "a", rng.choice([e[2] for e in ends] + [e[3] for e in ends]) if i % 2 else rng.random() * 60) for i in range(600)]
    got = ranges.first_interval(spark.createDataFrame(values, "id long, kind string, v double"), "v", spark.createDataFrame(ends, ENDS), ["name"], ["kind"])
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: r["name"] for r in got.collect()}
    for i, _, v in values:
        fit = min(((e[1], e[5]) for e in ends if holds(v, e[2], e[3], e[4])), default=None)
        assert found[i] == (fit and fit[1])


def test_totals_of_bands_as_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ENDS", 2)
    for cuts in (1, 7, 4096):
        monkeypatch.setattr(ranges, "CUTS", cuts)
        rng = random.Random(cuts)
        bands = [(i, rng.choice("ab"), rng.choice([None, *(x / 4 for x in range(-40, 160))]), rng.choice([None, 0.0, 0.25, 1.0, 3.5, 20.0, -1.0])) for i in range(90)]
        bands += [(100 + i, *bands[i % 7][1:]) for i in range(40)] + [(999, None, 5.0, 100.0)]
        rows = [(rng.choice("abc"), rng.choice([None, rng.randint(-80, 300) / 8])) for _ in range(400)] + [("a", 10.0)] * 3 + [(None, 5.0)]
        want = {}
        for kind, x in rows:
            held = [(i, c) for i, k, c, t in bands if kind and x is not None and k == kind and c is not None and c - (t or 0.0) <= x <= c + (t or 0.0)]
            if held:
                want[kind, x] = (len(held), min(i for i, _ in held), min(abs(x - c) for _, c in held))
        got = ranges.band_totals(spark.createDataFrame(rows, "kind string, x double"), "x", spark.createDataFrame(bands, "band long, kind string, centre double, tolerance double"), ["kind"], "band").collect()
        assert len(got) == len(want) > 50 and {(r["kind"], r["x"]): (r["n"], r["band"], r["gap"]) for r in got} == want
    none = spark.createDataFrame([], "band long, kind string, centre double, tolerance double")
    assert ranges.band_totals(spark.createDataFrame(rows, "kind string, x double"), "x", none, ["kind"], "band").count() == 0


def test_bands_over_a_slot_are_counted_down_before_the_shuffle(spark):
    from clauseq import lookups

    lines = lookups.band_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    spread = [i for i, line in enumerate(lines) if "explode(sequence" in line]
    assert spread
    for i in spread:
        above = next(j for j in range(i, -1, -1) if "Exchange" in lines[j])
        assert any("HashAggregate" in line for line in lines[above:i])
