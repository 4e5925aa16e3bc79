"""Identifier codecs on cases written out."""

import re

import pytest
from pyspark.sql import functions as F

from clauseq.functions.codecs import CITED, codec, scan_cited

STD = codec("series", "STD")


def each(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    got = {r["i"]: r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).collect()}
    return [got[i] for i in range(len(values))]


def test_codecs_by_name(spark):
    assert codec("plain-slug").prefix is None
    with pytest.raises(ValueError, match="nope"):
        codec("nope")
    assert each(spark, ["Fixture Doc 12-A", "  STD  R 60-1 ", None], codec("plain-slug").slug) == ["fixture-doc-12-a", "std-r-60-1", None]
    assert each(spark, ["STD R 60:2021"], lambda c: codec("plain-slug").extract(c)) == [""]


def test_cited_as_a_plain_scan(spark):
    texts = ["see ISO 8601:2004, ISO/IEC 17025 and ISO/IEC Guide 98-3; IEC 60068-2-6; ISO 8601 : 2004", "ISO  8601:2004 then ISO 8601:2004", "STD R 60-1:2017 (E), STD V 2-200, ISOLATED 12, XISO 9", "", None, "ISO/TS 19100 IEC 61010-1:2010 ISO8601"]

    def plain(text, grammars):
        out, seen = [], set()
        for g in grammars:
            for m in re.finditer(g, text or ""):
                label = re.sub(r"\s+", " ", m.group(0))
                node = "cite:" + re.sub(r"[^A-Za-z0-9]+", "-", label).strip("-")
                if node not in seen:
                    seen.add(node)
                    out.append((node, label))
        return out

    assert [[tuple(x) for x in r] for r in each(spark, texts, scan_cited)] == [plain(t, CITED) for t in texts]
    own = r"\bSTD\s+[RDBGEVS]\s*\d{1,3}(?:\s*[-–]\s*[0-9A-Za-z]{1,3})?(?:\s*:\s*\d{4})?"
    assert [[tuple(x) for x in r] for r in each(spark, texts, STD.cited)] == [plain(t, (own, *CITED)) for t in texts]


def test_parse_names(spark):
    cases = {
        "R 60-1:2021": ("60", "2021", "STD R 60-1:2021"), "STD R 076": ("76", None, "STD R 76"), "urn:std:pub:r:60-1:2021": ("60", "2021", "STD R 60-1:2021"), "URN:STD:pub:d:31:en": ("31", None, "STD D 31"),
        "ISO 4064-1:2024|STD R 49-1:2024": ("49", "2024", "STD R 49-1:2024"), "STD R 49-1:2024 | ISO 4064-1:2024": ("49", "2024", "STD R 49-1:2024"), "STD R 60:2017 (E)": ("60", "2017", "STD R 60:2017"),
        "ISO 4064|IEC 2": None, "urn:other:r:60": None, "hello": None, "STD X 5": None, "R 1234": None, "": None,
    }
    got = each(spark, [*cases, None], STD.parse)
    assert [g and tuple(g) for g in got] == [*cases.values(), None]
    with_edition = each(spark, ["R 60:2017", "R 60"], lambda c: STD.parse(c, F.lit("2021")))
    assert [g["label"] for g in with_edition] == ["STD R 60:2021"] * 2


def test_questions_name_documents(spark):
    cases = {
        "What does R 76 say?": ("76", None, "STD R 76"), "E2 weights and R 111:2004": ("111", "2004", "STD R 111:2004"), "std r60-1 : 2017": ("60", "2017", "STD R 60:2017"), "STD E2": ("2", None, "STD E 2"),
        "class E2 weights": None, "d 31 or r 76": ("31", None, "STD D 31"), "nothing here": None, "R 0076": ("76", None, "STD R 76"), "": None,
    }
    got = each(spark, [*cases, None], STD.asked)
    assert [g and tuple(g) for g in got] == [*cases.values(), None]


def test_nodes_families_and_extraction(spark):
    assert each(spark, ["STD R 60-1:2017 (E)", "R 76", "STD D 31:2019+Amendment", "hello", None, "X 4"], STD.node) == ["doc:STD-R-60-1-2017", "doc:R-76", "doc:STD-D-31-2019-Amd", None, None, None]
    assert each(spark, ["STD R 60-1:2017", "V2-200", "hello", None], STD.family_node) == ["family:R-60", "family:V-2", None, None]
    assert each(spark, ["STD R 60-1:2017", "R 60", "K 12-3 draft", "hello", None], STD.family) == ["R-60", "R-60", "K-12", None, None]
    assert each(spark, ["doc:STD-R-60-2017", "doc:R-60-2017", "concept:x", None], STD.number_of_node) == ["60", None, None, None]
    far = "x" * 60_000 + " STD R 5:2001"
    assert each(spark, ["a STD R 9:2001 b reference STD R 60-1:2021 c", "a STD D 9:2001", "STD R 9", far, None], STD.extract) == ["STD R 60-1", "STD D 9", "", "", ""]


def test_precedence_of_identifiers(spark):
    cases = [
        ("A", {"docidentifier": "STD D 117:2003 (E)"}, "r120-1996-ara", ("STD D 117:2003", "D", "117")),
        ("Annexes to STD R 60:2017", {"docidentifier": "STD D 60"}, "r060-a", ("STD R 60 (Annexes)", "R", "60")),
        ("Annexes to STD R 60:2017", {"docidentifier": "STD R 60:2017"}, "r060-a", ("STD R 60:2017", "R", "60")),
        ("A", {"docidentifier": "STD D X"}, "d031-2019-en", ("STD D 31:2019", "D", "31")),
        ("A", {"docidentifier": "STD D 0:0000 (E)", "edition": "2008"}, "r-7", ("STD R 7:2008", "R", "7")),
        ("A", {"docidentifier": "R 1200"}, "x", ("R 1200", "", "")),
        ("A", {"docnumber": "5", "doctype": "basic publication", "edition": "x9"}, "q12", ("STD B 5:x9", "B", "5")),
        ("A", {"series": " g ", "docnumber": ""}, "part12-2001", ("STD G 12:2001", "G", "12")),
        (None, None, "zz9-1999", ("STD ZZ 9:1999", "ZZ", "9")),
        (None, {}, None, ("", "", "")),
    ]
    rows = spark.createDataFrame([(i, t, a, s) for i, (t, a, s, _) in enumerate(cases)], "i int, title string, attrs map<string,string>, slug string")
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    got = {r["i"]: tuple(r["y"]) for r in rows.select("i", STD.classify(F.col("title"), attrs, F.col("slug")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
