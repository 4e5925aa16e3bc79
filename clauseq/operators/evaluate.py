"""Deterministic evaluators: condition sets, checks at the corners of tolerances, units, bands, matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bands of a decision, credits of an effort.
MET, NOT_MET = 0.8, 0.2
EFFORT = {"low": 1, "medium": 2, "high": 3}


def condition_sets(rows: DataFrame, stated: dict[str, str], sets: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """rows with the first set (name to kind to (SI value, tolerance)) all of whose stated kinds are in band, and the nearest set.

    stated: kind to column, null where a row does not state it. A set of which nothing is
    stated does not pass. Nearness is the sum of gaps, each over its tolerance or 1; ties go to the first set.
    """
    scores = []
    for k, (name, entries) in enumerate(sets.items()):
        gaps = [F.abs(F.col(stated[kind]) - si) for kind, (si, _) in entries.items() if kind in stated]
        tols = [tol for kind, (_, tol) in entries.items() if kind in stated]
        inside = F.lit(True)
        far, n = F.lit(0.0), F.lit(0)
        for g, tol in zip(gaps, tols, strict=True):
            inside = inside & F.coalesce(g <= tol, F.lit(True))
            far, n = far + F.coalesce(g / max(tol, 1.0), F.lit(0.0)), n + g.isNotNull().cast("int")
        scores.append(F.when(n > 0, F.struct(far.alias("far"), F.lit(k).alias("k"), F.lit(name).alias("name"), (inside & (n > 0)).alias("pass"))))
    every = F.array_compact(F.array(*scores))
    passed = F.filter(every, lambda s: s["pass"])
    return rows.withColumns({"passed": F.array_min(F.transform(passed, lambda s: F.struct(s["k"].alias("k"), s["name"].alias("name"))))["name"], "nearest": F.array_min(every)["name"]})


def corners(values: dict[str, tuple[Column, Column]], margin: Callable[[dict[str, Column]], Column]) -> tuple[Column, Column]:
    """The least and greatest margin of a check over the 2^k corners of its values' tolerances (symbol to (value, tolerance))."""
    names, all_of = list(values), []
    for bits in range(1 << len(names)):
        all_of.append(margin({n: values[n][0] + (values[n][1] if bits >> i & 1 else -values[n][1]) for i, n in enumerate(names)}))
    return F.least(*all_of) if len(all_of) > 1 else all_of[0], F.greatest(*all_of) if len(all_of) > 1 else all_of[0]


def verdict(low: Column, high: Column) -> Column:
    """pass where the check holds at every corner, fail where at none, else void: the tolerance decides."""
    return F.when(low.isNull() | high.isNull(), "void").when(low >= 0, "pass").when(high < 0, "fail").otherwise("void")


def flip_point(value: Column, margin: Callable[[Column], Column], steps: int = 12, reach: float = 20.0) -> Column:
    """Where between a value and `reach` times it a check that holds comes to fail, by bisection; null where it does not."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(margin(mid) >= 0, mid).otherwise(s["lo"]).alias("lo"), F.when(margin(mid) >= 0, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(value.cast("double").alias("lo"), (value * reach).cast("double").alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve)
    return F.when((margin(value) >= 0) & (margin(value * reach) < 0), found["hi"])


def convert(rows: DataFrame, value: str, source: str, target: str, units: dict[str, tuple[str, float]]) -> DataFrame:
    """rows with `converted`: value in another unit of the same dimension (unit to (dimension, factor)), else null. An unknown unit is tried as a prefix and a unit."""
    prefixes = {"k": 1e3, "M": 1e6, "m": 1e-3, "µ": 1e-6, "c": 1e-2}
    table = dict(units)
    for u, (dim, factor) in units.items():
        for p, scale in prefixes.items():
            table.setdefault(p + u, (dim, factor * scale))
    known = F.create_map(*[x for u, (d, f) in table.items() for x in (F.lit(u), F.struct(F.lit(d).alias("d"), F.lit(f).alias("f")))])
    a, b = F.try_element_at(known, F.col(source)), F.try_element_at(known, F.col(target))
    return rows.withColumn("converted", F.when(a["d"] == b["d"], F.col(value) * a["f"] / b["f"]))


def decision_band(p: Column) -> Column:
    return F.when(p >= MET, "met").when(p <= NOT_MET, "not-met").otherwise("unclear")


def credits(effort: Column, tools: Column, image: Column) -> Column:
    base = F.lit(1)
    for name, n in EFFORT.items():
        base = F.when(effort == name, n).otherwise(base)
    return base + F.coalesce(tools.cast("int"), F.lit(0)) + F.coalesce(image.cast("int"), F.lit(0))


def best_topic(rows: DataFrame, words: str, topics: dict[str, list[str]]) -> DataFrame:
    """rows with the topic that shares most of its distinctive words with the array `words`, two at least; ties go to the first."""
    scored = F.array(*(F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(topics.items())))
    top = F.array_max(scored)
    return rows.withColumn("topic", F.when(top["n"] >= 2, top["name"]))


def printed_numbers(text: Column) -> Column:
    """The distinct numbers of three signs or more in a text, without what groups their digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[0-9][0-9 ,.]{1,8}[0-9]"), F.lit(0)), lambda n: F.regexp_replace(n, "[ ,.]", "")))


def complete_tables(answers: DataFrame, tables: DataFrame) -> DataFrame:
    """answers (query_id, doc, text) with the first table (doc, unit_id, text) of their document that has one of their numbers: query_id, unit_id, shared."""
    a = answers.select("query_id", "doc", F.explode(printed_numbers(F.col("text"))).alias("number"))
    t = tables.select("doc", "unit_id", F.explode(printed_numbers(F.col("text"))).alias("number"))
    hits = a.join(t, ["doc", "number"]).groupBy("query_id", "unit_id").agg(F.count_distinct("number").alias("shared"))
    return hits.groupBy("query_id").agg(F.min(F.struct("unit_id", "shared")).alias("x")).select("query_id", "x.unit_id", "x.shared")


def bind_by_symbols(asked: DataFrame, constraints: DataFrame) -> DataFrame:
    """asked (query_id, text) with the constraint (node_id, symbols) most of whose symbols it names: query_id, node_id, named.

    A dotted symbol counts by its last part, of letters and `_`, two signs at least. Two
    symbols must be named; ties go to the first node_id.
    """
    leaf = F.lower(F.regexp_extract(F.col("symbol"), r"([A-Za-z_]{2,})$", 1))
    s = constraints.select("node_id", F.explode("symbols").alias("symbol")).select("node_id", leaf.alias("leaf")).where("leaf <> ''").distinct()
    q = asked.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z_]+"))).alias("leaf"))
    named = q.join(s, "leaf").groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("named")).where("named >= 2")
    return named.groupBy("query_id").agg(F.min(F.struct((-F.col("named")).alias("m"), "node_id")).alias("x")).select("query_id", "x.node_id", (-F.col("x.m")).alias("named"))
