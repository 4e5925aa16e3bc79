"""Checks in tables against plain Python."""

import itertools
import math

from pyspark.sql import functions as F

from clauseq.operators import checks


def test_stated_values(spark):
    cases = [
        ("E_max 30000 v", "E_max", (30000.0, "v", None, None, None)), ("e_max = 30 000 ± 60 v", "cell.E_max", (30000.0, "v", 60.0, "± 60 v", False)),
        ("E_max of 30,000 v ± 60", "E_max", (30000.0, "v", 60.0, "± 60", False)), ("E_max 30000 ± 0.2 %", "E_max", (30000.0, "%", 60.0, "± 0.2 %", True)),
        ("d 1.500 mm pm 5 mm", "d", (1500.0, "mm", 5.0, "± 5 mm", False)), ("d 0.9 and e 4", "d", (0.9, "and", None, None, None)), ("d is 5 +/- 1 µm", "d", (5.0, "µm", 1.0, "± 1 µm", False)),
        ("d is about the height of 5", "d", (None,) * 5), ("ad 5", "d", (None,) * 5), ("d 1.2.3", "d", (None,) * 5), ("d 7", "d", (7.0, None, None, None, None)), (None, "d", (None,) * 5), ("a.b+ 3", "x.b+", (None,) * 5),
        ("d 20 °C", "d", (20.0, "°C", None, None, None)), ("d ± 5", "d", (5.0, None, None, None, None)),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, text string, symbol string")
    got = {r["i"]: (r["value"], r["unit"], r["tolerance"], r["stated"], r["relative"]) for r in checks.stated_values(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


OPS = {"<=": lambda m: m <= 0, "<": lambda m: m < 0, ">=": lambda m: m >= 0, ">": lambda m: m > 0, "=": lambda m: m == 0}


def plain(check, values, tols, dims):
    """(result, corners, void, safety) of one check whose symbols are all stated."""
    terms, op, limit = check
    names = list(dict.fromkeys(s for _, ss in terms for s in ss))
    if len({dims[s] for s in names if dims.get(s)}) > 1:
        return None, None, "mixed dimensions", None
    holds = lambda v: OPS[op](sum(f * math.prod(v[s] for s in ss) for f, ss in terms) - limit)
    result, bands = holds(values), [s for s in names if s in tols][:3]
    if not bands:
        return result, None, None, None
    corners = [holds(values | {s: values[s] + (tols[s] if mask >> i & 1 else -tols[s]) for i, s in enumerate(bands)}) for mask in range(1 << len(bands))]
    first = bands[0]
    if any(c != result for c in corners):
        return result, corners, f"tolerance of {first}", None
    flips = lambda x: any(holds(values | {first: values[first] + d * x * tols[first]}) != result for d in (1, -1))
    if not tols[first]:
        return result, corners, None, None
    if not flips(20.0):
        return result, corners, None, 10.0
    lo, hi = 1.0, 20.0
    for _ in range(12):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if flips(mid) else (mid, hi)
    return result, corners, None, hi / 2


def test_checks_with_products_corners_and_dimensions(spark):
    table = {
        (1, 1): ([(1.0, ["a"]), (-2.0, ["b"])], "<=", 2.0), (1, 2): ([(1.0, ["a", "b"]), (0.5, ["c"])], ">", 10.0), (2, 1): ([(1.0, ["a", "b", "c", "d"])], "<", 5000.0),
        (3, 1): ([(1.0, ["a"])], ">=", 5.0), (4, 1): ([(1.0, ["zz"])], "=", 4.0),
    }
    texts, states = [], []
    for i, (a, b, c, t) in enumerate(itertools.product((4, 9), (3, 7), (2, 40), range(5))):
        tols = [{}, {"a": 1}, {"a": 1, "b": 1, "c": 2, "d": 1}, {"b": 2}, {"a": 0}][t]
        unit = {"a": "kg", "b": "kg" if i % 3 else "m", "c": "kg", "d": "kg"}
        value = {"a": a, "b": b, "c": c, "d": 5}
        texts.append((i, "; ".join(f"{s} is {value[s]}" + (f" ± {tols[s]}" if s in tols else "") + f" {unit[s]}" for s in value)))
        states.append((value, tols, {s: {"kg": "mass", "m": "length"}[u] for s, u in unit.items()}))
    pairs = spark.createDataFrame([(i, t, n) for i, t in texts for n in (1, 2, 3, 4)], "query_id int, text string, node_id int")
    rules = spark.createDataFrame([(n, k, [{"factor": f, "symbols": s} for f, s in terms], op, limit) for (n, k), (terms, op, limit) in table.items()], "node_id int, check_no int, terms array<struct<factor: double, symbols: array<string>>>, op string, limit double")
    units = spark.createDataFrame([("KG", "mass"), ("m", "length")], "unit string, dimension string")
    judged = checks.judge_checks(pairs, rules, units)
    got = {(r["query_id"], r["node_id"], r["check_no"]): r for r in judged.collect()}
    assert len(got) == 40 * 5
    verdicts = {}
    for i, (value, tols, dims) in enumerate(states):
        for (n, k), check in table.items():
            r = got[i, n, k]
            if n == 4:
                assert r["missing"] == ["zz"] and r["result"] is None
                verdicts[i, n] = "void"
                continue
            result, corners, void, safety = plain(check, value, tols, dims)
            assert (r["result"], r["corners"], r["void_reason"]) == (result, corners, void)
            assert (r["safety"] is None) == (safety is None) and (safety is None or abs(r["safety"] - safety) < 1e-9)
            rank = {"pass": 0, "fail": 1, "void": 2}
            new = "void" if void else "pass" if result else "fail"
            verdicts[i, n] = max(verdicts.get((i, n), "pass"), new, key=rank.get)
    nodes = spark.createDataFrame([(1, "reject", "too heavy"), (2, None, "x")], "node_id int, on_violation string, violation_meaning string")
    rows = checks.judge_nodes(judged, nodes).collect()
    assert {(r["query_id"], r["node_id"]): r["verdict"] for r in rows} == verdicts and set(verdicts.values()) == {"pass", "fail", "void"}
    told = {(r["node_id"], r["on_violation"], r["violation_meaning"]) for r in rows if r["verdict"] == "fail"}
    assert told == {(1, "reject", "too heavy"), (2, "invalid", "x"), (3, "invalid", None)}


def test_quantities(spark):
    cases = {
        "at 40 °C and 93 % RH for 12 h": {"temperature": (40.0, "degC", 313.15), "relative_humidity": (93.0, "%", 0.93), "duration": (12.0, "h", 43200.0)},
        "313 K for 2 days": {"temperature": (313.0, "K", 313.0), "duration": (2.0, "d", 172800.0)}, "-5,5 C, 12 months": {"temperature": (-5.5, "degC", 267.65)}, "none": {}, "": {},
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, text string").select("i", checks.quantities(F.col("text")).alias("q"))
    got = {r["i"]: {k: (v["stated"], v["unit"], round(v["si"], 9)) for k, v in r["q"].items()} for r in rows.collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_a_flip_at_the_reach_itself_is_in_the_sql(spark, tmp_path):
    """Orders whose margin is 20 times their tolerance."""
    import duckdb

    from clauseq import catalogue, lookups

    db = duckdb.connect()
    db.execute("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, 'X' AS n_name FROM range(25) r(i)")
    db.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT)")
    db.executemany("INSERT INTO orders VALUES (?, ?)", [[28185, 5205], [39323, 271], [47623, 3271], [58723, 14271], [112231, 2134]])
    for t in ("nation", "orders"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = sorted((q, c, b, round(s, 6)) for q, c, b, s in db.execute(catalogue.SQL["check_safety"]).fetchall())
    got = sorted(tuple(r) for r in lookups.check_safety(spark, str(tmp_path)).collect())
    assert {r[0] for r in got if r[3] == 10.0} and [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_a_question_is_read_once_and_not_moved(spark, tmp_path):
    """Values, corners and results are made in the question's own row."""
    spark.createDataFrame([(1, "a is 4 ± 1 kg; b is 3 kg", 1), (2, "a 4; b 9 ± 2 m", 1)], "query_id int, text string, node_id int").write.parquet(f"{tmp_path}/pairs")
    rules = spark.createDataFrame([(1, 1, [{"factor": 1.0, "symbols": ["a"]}, {"factor": -2.0, "symbols": ["b"]}], "<=", 2.0)], "node_id int, check_no int, terms array<struct<factor: double, symbols: array<string>>>, op string, limit double")
    units = spark.createDataFrame([("KG", "mass"), ("m", "length")], "unit string, dimension string")
    judged = checks.judge_checks(spark.read.parquet(f"{tmp_path}/pairs"), rules, units)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "hashpartitioning(query_id" not in plan
    got = {r["query_id"]: (r["values"], r["result"], r["corners"]) for r in judged.collect()}
    assert got == {1: ({"a": 4.0, "b": 3.0}, True, [True, True]), 2: ({"a": 4.0, "b": 9.0}, True, [True, True])}


def test_stated_values_at_places_that_overlap(spark):
    cases = [
        ("a a a 5 ± 1 kg", "a a", (5.0, "kg", 1.0)), ("x2 x2 7 kg", "x2", (27.0, "kg", None)), ("d 5 d 7 ± 2 kg", "d", (7.0, "kg", 2.0)), ("d 5 kg, d 7 m ± 2", "d", (7.0, "m", 2.0)), ("d 5 °pm 3", "d", (5.0, "°", 3.0)),
        ("d and then a long way off d 1 000,5 pm 0.250 µm", "d", (10005.0, "µm", 250.0)), ("d 5 kilogramme ± 3", "d", (5.0, "kilogr", None)), ("d 5pm 3", "d", (5.0, "pm", None)),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, text string, symbol string")
    got = {r["i"]: (r["value"], r["unit"], r["tolerance"]) for r in checks.stated_values(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_a_filter_for_safety_does_not_make_the_corners_again(spark):
    """The filter stays behind what it reads; moved before it, it would make a check's values and corners again for each halving."""
    pairs = spark.createDataFrame([(1, "a is 4 ± 1 kg; b is 3 kg", 1), (2, "a 4; b 9 ± 2 m", 1), (3, "a 4; b 9 m", 1)], "query_id int, text string, node_id int")
    rules = spark.createDataFrame([(1, 1, [{"factor": 1.0, "symbols": ["a"]}, {"factor": -2.0, "symbols": ["b"]}], "<=", 2.0)], "node_id int, check_no int, terms array<struct<factor: double, symbols: array<string>>>, op string, limit double")
    judged = checks.judge_checks(pairs, rules, spark.createDataFrame([("kg", "mass")], "unit string, dimension string"))
    for column in ("safety", "bounded"):
        safe = judged.where(f"{column} IS NOT NULL")
        filters = [line for line in safe._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]
        assert any("transform_values" in f for f in filters) and not any("getbit" in f or "map_from_entries" in f for f in filters)
        assert sorted(r["query_id"] for r in safe.collect()) == [1, 2]
