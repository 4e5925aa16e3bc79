"""Graphs of publications and sections, and families, on cases written out."""

from pyspark.sql import functions as F

from clauseq.functions.codecs import codec
from clauseq.operators import families, graphbuild

STD = codec("series", "STD")
RECORDS = "place int, identifiers array<struct<content: string, primary: boolean>>, titles array<struct<language: string, content: string>>, status string, relations array<struct<type: string, identifiers: array<string>>>"


def record(place, name, status="in-force", relations=(), titles=(("eng", "A title"),)):
    return place, [{"content": "alias", "primary": None}, {"content": name, "primary": True}], [{"language": a, "content": b} for a, b in titles], status, [{"type": t, "identifiers": ids} for t, ids in relations]


def test_publications(spark):
    rows = [
        record(1, "STD R 60-1:2000", relations=[("hasSuccessor", ["STD R 60-1:2017", "junk"]), ("cites", ["STD R 5"])]), record(2, "STD R 60-1:2017", titles=[("fra", "titre")]), record(3, "STD R 60-1:2017 (F)", "withdrawn", titles=[]),
        record(4, "A circular"), record(5, "STD R 76:1992", "superseded"), record(6, "STD R 76:2006", None, [("hasSuccessor", ["STD R 76:2006"]), ("updates", ["STD R 60-1:2017", "STD R 99:1900"])]), (7, None, None, None, None), (8, [], [], None, []),
    ]
    passages = [
        ("STD R 60-1", "2017", "Bibliography", "STD R 60-1:1999, STD R 60-2:2001, ISO 9001, ISO  9001, STD R 76"), ("STD R 60-1", "1850", "x", "Normative bibliography IEC 60068"), ("STD R 60-1", None, "Normative references", "ISO 1"),
        ("STD R 60-1", "2017", "Scope", "ISO 7"), ("STD R 12", "2000", "Bibliography", "ISO 8"), (None, None, None, None),
    ]
    concepts = [("7", "load", ["book", "STD R 76:2006"]), ("8", None, ["STD R 1:1999"]), (None, "x", ["STD R 76:2006"]), ("9", "bare", None)]
    docs, nodes, edges = graphbuild.build(
        spark.createDataFrame(rows, RECORDS), spark.createDataFrame(passages, "identifier string, edition string, title string, text string"), spark.createDataFrame(concepts, "concept_id string, term string, sources array<string>"), STD
    )
    old, new = "doc:STD-R-60-1-2000", "doc:STD-R-60-1-2017"
    got = {r["node"]: (r["status"], r["derived_status"], r["superseded_by"], r["active"], r["title"]) for r in docs.collect()}
    assert got == {
        old: ("in-force", "superseded", new, False, "A title"), new: ("in-force", "in-force", None, True, "titre"), "doc:STD-R-76-1992": ("superseded", "superseded", None, False, "A title"),
        "doc:STD-R-76-2006": ("unknown", "unknown", None, True, "A title"),
    }
    cites = {("cite:STD-R-60-2-2001"), "cite:ISO-9001", "cite:STD-R-76", "cite:IEC-60068", "cite:ISO-1"}
    assert {(r["src"], r["dst"], r["kind"]) for r in edges.collect()} == {
        (old, "family:R-60", "part_of"), (new, "family:R-60", "part_of"), ("doc:STD-R-76-1992", "family:R-76", "part_of"), ("doc:STD-R-76-2006", "family:R-76", "part_of"), (old, new, "successor"),
        ("doc:STD-R-76-2006", new, "amends"), ("doc:STD-R-76-2006", "concept:7", "defines"), *((new, c, "cites") for c in cites),
    }
    kinds = {r["id"]: (r["kind"], r["label"]) for r in nodes.collect()}
    assert kinds[new] == ("doc", "STD R 60-1:2017 (F)") and kinds["concept:8"] == ("concept", "8") and kinds["cite:ISO-9001"] == ("cite", "ISO 9001") and "concept:9" in kinds and len(kinds) == 4 + 2 + 5 + 3


def test_sections(spark):
    documents = spark.createDataFrame([("b", "slug", "STD R 60:2017", [("hasPart", "STD R 60-1:2017"), ("obsoletes", "junk"), (None, "STD R 1"), ("same", "STD R 60:2017")]), ("c", "other", "no grammar", None)], "bundle string, slug string, canonical string, relations array<struct<type: string, to: string>>")
    units = [("b", "u1", "clause", "1", None, None), ("b", "u2", "annex", None, "A", None), ("b", "u3", "table", "", "", "u1"), ("b", "u4", "note", None, None, "u3"), ("b", "u5", "figure", "9", None, "u1"), ("c", "u1", "clause", "1", None, None), ("b", "u6", "term", "7", None, "gone")]
    links = [("b", "part_of", "u3", "u2"), ("b", "defines", "u1", "concept:mass"), ("b", "cites", "u1", "STD R 76:2006"), ("b", "cites", "u1", "STD R 60:2017"), ("b", "cites", "u2", "nothing"), ("b", "part_of", "u1", "gone"), ("b", "other", "u1", "u2")]
    nodes, edges = graphbuild.section_graph(documents, spark.createDataFrame(units, "bundle string, id string, type string, number string, anchor string, parent string"), spark.createDataFrame(links, "bundle string, kind string, from_unit string, to_target string"), STD)
    doc = "doc:STD-R-60-2017"
    assert {(r["src"], r["dst"], r["kind"]) for r in edges.collect()} == {
        ("sec:slug:1", doc, "part_of"), ("sec:slug:A", doc, "part_of"), ("sec:slug:u3", "sec:slug:1", "part_of"), ("sec:slug:u3", "sec:slug:A", "part_of"), ("sec:slug:1", "concept:mass", "defines"),
        ("sec:slug:1", "doc:STD-R-76-2006", "cites"), (doc, "doc:STD-R-60-1-2017", "hasPart"),
    }
    assert {(r["id"], r["kind"]) for r in nodes.collect()} == {
        (doc, "doc"), ("sec:slug:1", "section"), ("sec:slug:A", "section"), ("sec:slug:u3", "section"), ("concept:mass", "concept"), ("doc:STD-R-76-2006", "doc"), ("doc:STD-R-60-1-2017", "doc"), ("sec:other:1", "section")
    }


def test_families_of_nulls_and_single_members(spark):
    rows = [
        (1, 1, "STD R 60-1:2000", "R", "60", "2000", "en", "Load — cells", "dirty"), (2, 2, "STD R 60-1:2017 (E)", "R", "60", "2017", "fr", "Newer", "dirty"), (3, 3, "STD R 60-1:1990", "R", "60", "1990", "fr", "Curated", "clean"),
        (4, 4, None, "R", "60", None, None, None, None), (5, 5, "STD R 60-Annex A", "R", "60", "", "en", "An annex", "clean"), (6, 6, "STD D 1", "D", "1", "", "en", "Alone", "clean"), (7, 7, "x", None, "5", "", "en", "none", "clean"),
    ]
    docs = spark.createDataFrame(rows, "place int, doc_id int, identifier string, doctype string, number string, edition string, language string, title string, corpus string")
    got = families.family_notes(docs, "STD").collect()
    assert [(r["base"], r["parts"], r["annexes"]) for r in got] == [("STD R 60", 1, 1)]
    assert "- STD R 60-1 — Curated\n- STD R 60-Annex A — An annex" in got[0]["text"] and got[0]["text"].endswith("STD R 60 has 1 part and 1 annex (2 components total).")
    sections = spark.createDataFrame([(6, 2, "Foreword", "b"), (6, 1, "SCOPE of it", "a" * 1000), (6, 3, "Tests", "c")], "doc_id int, pos int, title string, text string")
    text = {r["doc_id"]: r["text"] for r in families.overviews(docs, sections, "STD", {"D": "Document"}).collect()}
    assert text[6] == "Alone — STD D 1 (en).\n\nAn STD Document.\n\nSCOPE of it: " + "a" * 900 + "\n\nForeword: b"


def test_overviews_move_no_more_of_a_text_than_they_quote(spark):
    docs = spark.createDataFrame([(k, k, "D", "7", f"STD D 7-{k}", "2001", "en", "T", "clean") for k in (1, 2)], "place int, doc_id int, doctype string, number string, identifier string, edition string, language string, title string, corpus string")
    bare = spark.createDataFrame([(1, k, f"Scope {k}") for k in range(5)], "doc_id int, pos int, title string")
    whole = bare.withColumn("text", F.repeat("title", F.lit(500)))
    given = families.overviews(docs, whole, "STD", {"D": "Document"})
    made = families.overviews(docs, bare, "STD", {"D": "Document"}, lambda t: F.repeat(t, F.lit(500)))
    want = {r["doc_id"]: r["text"] for r in given.collect()}
    assert {r["doc_id"]: r["text"] for r in made.collect()} == want
    assert "\n\n".join(f"Scope {k}: " + (f"Scope {k}" * 500)[:900] for k in range(3)) in want[1] and "Scope" not in want[2]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1 and plan.index("repeat(") < plan.index("Join ")  # made above all joins
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("left(text") > plan.index("Window ") if "left(text" in plan else plan.index("900") > plan.index("Window ")


def test_texts_are_scanned_for_citations_once(spark, tmp_path):
    rows = [record(1, "STD R 60-1:2000", relations=[("updates", ["STD R 60-1:2017", "STD R 99:1900"])]), record(2, "STD R 60-1:2017")]
    passages = [("STD R 60-1", "2017", "Bibliography", "STD R 60-1:1999, ISO 9001, -ISO--9001, STD R 60-1"), ("STD R 60-1", "2000", "Bibliography", "nothing"), ("STD R 60-1", "2000", "Bibliography", None)]
    spark.createDataFrame(passages, "identifier string, edition string, title string, text string").write.parquet(f"{tmp_path}/passages")
    concepts = spark.createDataFrame([("7", "load", ["STD R 60-1:2000"]), ("8", "x", ["STD R 98:1900"])], "concept_id string, term string, sources array<string>")
    edges = graphbuild.build(spark.createDataFrame(rows, RECORDS), spark.read.parquet(f"{tmp_path}/passages"), concepts, STD)[2]
    new, old = "doc:STD-R-60-1-2017", "doc:STD-R-60-1-2000"
    assert sorted(tuple(r) for r in edges.collect()) == sorted([(old, "family:R-60", "part_of"), (new, "family:R-60", "part_of"), (old, new, "amends"), (new, "cite:ISO-9001", "cites"), (old, "concept:7", "defines")])
    plan = edges._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("text:string>") == 1
