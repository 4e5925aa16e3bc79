"""Sections and tables of HTML, and look-ups whose inputs are odd or empty."""

from pyspark.sql import functions as F

from clauseq.operators import evaluate, graph, language, registry
from clauseq.sources import html

PAGE = """<html><nav><p>no</p></nav><!-- <p>nor this</p> --><p>Intro &amp; more</p><h2 id=x>1.2 Scope <b>of</b> it</h2><p>It covers.<p>two</p><p>two alone</p><ul><li>a &lt;b</li><li></li></ul>
<table><caption>Cap</caption><thead><tr><th>A</th><th>B</th></tr></thead><tr><td>1</td><td>2</td></tr><tr><td> </td></tr><tr><td>3</td></tr></table><h3>Terms</h3><div>lost</div>
<table><tr><td>u</td><td>v</td></tr></table><table><tr><th>only</th></tr></table><TABLE><TR><TH>k</TH></TR><TR><TH>h</TH></TR></TABLE></html>"""


def test_sections(spark):
    d = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<h2>9</h2>no end of <p>it")], "k long, h string")
    got = [(r["k"], r["pos"], r["anchor"], r["title"], r["body"]) for r in html.sections(d, "k", "h", "^two").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "", "", "Intro & more"), (1, 1, "1.2", "1.2 Scope of it", "It covers. two\n- a <b\nA | B\n1 | 2\n3"), (1, 2, "", "Terms", "u | v\nonly\nk\nh"), (4, 1, "9", "9", "it")]
    assert html.sections(d.limit(0), "k", "h").count() == 0


def test_tables_as_text(spark):
    d = spark.createDataFrame([(1, PAGE), (2, None)], "k long, h string")
    c = {x: F.col(x) for x in ("caption", "columns", "rows")}
    t = html.tables(d, "k", "h").withColumns({
        "e": html.embed_text(c["caption"], F.lit("S"), c["columns"], c["rows"]), "g": html.display_text(**c),
        "s": html.selected_rows(c["columns"], c["rows"], F.array(F.lit("b"), F.lit("u"))),
    })
    one, two, three = t.orderBy("pos", "nth").collect()
    assert (one["anchor"], one["caption"], one["columns"], one["rows"], one["guessed"]) == ("1.2", "Cap", ["A", "B"], [["1", "2"], ["3"]], False)
    assert one["e"] == "Cap. Source: S. Columns: A; B.\nRow: A = 1; B = 2.\nRow: A = 3." and one["s"] == [["1", "2"]]
    assert one["g"] == "Table — Cap\n| A   | B   |\n|-----|-----|\n| 1   | 2   |\n| 3   |"
    assert (two["columns"], two["guessed"], two["s"]) == (["Column 1", "Column 2"], True, [["u", "v"]])
    assert (three["columns"], three["rows"], three["nth"]) == (["k"], [["h"]], 2)


def test_graph_and_register_edges(spark):
    nodes = spark.createDataFrame([("a", "concept", "Creep test"), ("b", "concept", None), ("c", "doc", "creep"), ("family:R", "family", "R")], "id string, kind string, label string")
    assert [r["node"] for r in graph.seed_nodes(nodes, ["CREEP", "no"], "R").collect()] == ["a", "family:R"]
    assert graph.seed_nodes(nodes, []).count() == 0
    edges = spark.createDataFrame([("c", "a", "defines"), ("c", "a", "defines"), ("d", "b", "defines"), ("c", "d", "successor"), ("c", "f", "part_of")], "src string, dst string, kind string")
    asked = spark.createDataFrame([(1, ["eep T", "xy"]), (2, None), (3, [])], "query_id long, terms array<string>")
    assert [tuple(r) for r in graph.defining_documents(asked, edges, nodes).collect()] == [(1, 1, "c")]
    assert [tuple(r) for r in graph.family_changes(edges).collect()] == [("f", "c", "d")]
    rows = [("R60-1", "Acme & Co", "XK3190", "2020"), ("R60-2", "190 Ltd", "ZM-190", "2019"), ("R60-3", "Acme", None, None)]
    register = spark.createDataFrame(rows, "num string, holder string, model string, year string")
    questions = spark.createDataFrame([(1, "What is the status of model 190 under R 60:2020?"), (2, "acme certificates"), (3, None)], "query_id long, text string")
    got = [tuple(r) for r in registry.register_search(questions, register).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, "R60-2", 3), (2, 1, "R60-1", 1), (2, 2, "R60-3", 1)]
    assert registry.register_search(questions.limit(0), register).count() == 0 == registry.register_search(questions, register.limit(0)).count()


def test_completion_and_binding_edges(spark):
    answers = spark.createDataFrame([(1, "x", "It is 1 234, then 12."), (2, "x", None), (3, None, "1234")], "query_id long, doc string, text string")
    tables = spark.createDataFrame([("x", "u2", "1,234 | 5"), ("x", "u1", "12 | 34"), ("y", "u0", "1234")], "doc string, unit_id string, text string")
    assert [tuple(r) for r in evaluate.complete_tables(answers, tables).collect()] == [(1, "u2", 1)]
    asked = spark.createDataFrame([(1, "is n_max within e_min?"), (2, "n_max"), (3, None)], "query_id long, text string")
    constraints = spark.createDataFrame([(5, ["a.n_max", "E_min", "q"]), (4, ["n_max", "x.n_max"]), (3, None)], "node_id long, symbols array<string>")
    assert [tuple(r) for r in evaluate.bind_by_symbols(asked, constraints).collect()] == [(1, 5, 2)]


def test_other_scripts_are_named(spark):
    texts = ["Быстрая лиса " * 30, "the fox and " * 60 + "лиса " * 20, "лиса " * 30, None, "", "the fox and " * 60 + "лиса " * 80]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = [r["x"] for r in d.orderBy("k").select(language.stopword_language(F.col("t")).alias("x")).collect()]
    assert got == ["non-latin", "en", None, None, None, "non-latin"]


def test_cells_of_a_table_are_made_once(spark):
    rows = "".join(f"<tr><td>{i}</td><td></td></tr>" for i in range(3000))
    pages = spark.createDataFrame([(1, f"<h2>1 A</h2><table><caption>c</caption><tr><th>H</th></tr>{rows}</table><table><thead><tr><th>T</th></tr></thead><tr><td>x</td></tr></table><table><tr></tr></table>")], "id long, html string")
    got = html.tables(pages, "id", "html")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<t[hd]") == 2  # of a thead's rows and of the others
    first, second = got.orderBy("nth").collect()
    assert (first["columns"], first["rows"], first["guessed"]) == (["H"], [[str(i)] for i in range(3000)], False)
    assert (second["columns"], second["rows"], second["caption"]) == (["T"], [["x"]], "")


def test_register_rows_are_kept_by_task_and_meet_a_question_once(spark):
    rows = [(q, s, y, n) for q in (1, None, 2) for s in (3, 5) for y in (None, 2000, 1999) for n in (None, 4, 2)]
    pairs = spark.createDataFrame(rows * 2, "query_id long, score int, year int, num long").coalesce(1)
    best = [(5, 2000, None), (5, 2000, None), (5, 2000, 2), (5, 2000, 2), (5, 2000, 4)]
    want = sorted(((q, *b) for q in (1, None, 2) for b in best), key=str)
    assert sorted((tuple(r) for r in registry.first_of_each(pairs, 5).collect()), key=str) == want
    assert registry.first_of_each(pairs.limit(0), 5).count() == 0
    register = spark.range(200).select(F.col("id").alias("num"), F.lit("Acme").alias("holder"), F.concat(F.lit("pump acme "), F.col("id")).alias("model"), (F.col("id") % 3).cast("int").alias("year"))
    asked = spark.createDataFrame([(1, "Acme acm pump 17?"), (None, "Acme")], "query_id long, text string")
    found = registry.register_search(asked, register)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "MapInArrow" in plan  # the register's rows once, and no pair gathered
    got = [tuple(r) for r in found.orderBy("place").collect()]
    assert got == [(1, 1, 17, 9), (1, 2, 2, 6), (1, 3, 5, 6), (1, 4, 8, 6), (1, 5, 11, 6), (1, 6, 14, 6)]
