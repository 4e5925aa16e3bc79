"""Registered queries of identifiers and references, and their SQL. The texts are derived from the parts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.catalogue import query, read
from clauseq.functions.codecs import codec
from clauseq.operators import families, graphbuild

STD = codec("series", "STD")
_NAME = "(['R', 'D', 'B', 'G', 'V', 'X'])[p_partkey % 6 + 1]"
#: One reference of each part, in one of seven forms.
_FORM = f"""CASE p_partkey % 7 WHEN 0 THEN 'ISO ' || p_size * 37 || ':' || 1990 + p_size % 9 WHEN 1 THEN 'ISO/IEC  Guide ' || p_size || '-' || p_partkey % 4 WHEN 2 THEN 'ISO/IEC 6' || 1000 + p_size
  WHEN 3 THEN 'IEC 60068-2-' || p_size WHEN 4 THEN 'STD ' || {_NAME} || ' ' || p_partkey % 300 || '-' || p_size % 3 || ':2001' WHEN 5 THEN 'STD ' || {_NAME} || p_size ELSE 'ISOLATED 12' END"""


def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_brand, ref: one reference of each part, in one of seven forms."""
    key, size = F.col("p_partkey"), F.col("p_size")
    letter = F.get(F.array(*map(F.lit, "RDBGVX")), (key % 6).cast("int"))
    s = lambda *x: F.concat(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    ref = (
        F.when(key % 7 == 0, s("ISO ", size * 37, ":", 1990 + size % 9)).when(key % 7 == 1, s("ISO/IEC  Guide ", size, "-", key % 4)).when(key % 7 == 2, s("ISO/IEC 6", 1000 + size))
        .when(key % 7 == 3, s("IEC 60068-2-", size)).when(key % 7 == 4, s("STD ", letter, " ", key % 300, "-", size % 3, ":2001")).when(key % 7 == 5, s("STD ", letter, size)).otherwise(s("ISOLATED 12"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", ref.alias("ref"))


_OWN = r"\bSTD\s+[RDBGEVS]\s*\d{1,3}(?:\s*[-–]\s*[0-9A-Za-z]{1,3})?(?:\s*:\s*\d{4})?"
_ISO = r"\bISO(?:/IEC|/TS|/TR)?\s*(?:Guide\s+)?\d{1,5}(?:\s*[-–]\s*\d+)?(?:\s*:\s*\d{4})?"
_IEC = r"\bIEC\s*\d{4,6}(?:\s*[-–]\s*\d+)?(?:\s*[-–]\s*\d+)?(?:\s*:\s*\d{4})?"


@query(f"""WITH l AS (SELECT l_orderkey AS doc, string_agg({_FORM}, '; see ' ORDER BY l_linenumber, p_partkey, l_suppkey) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
g AS (SELECT doc, 1 AS g, regexp_extract_all(text, '{_OWN}') AS found FROM l UNION ALL SELECT doc, 2, regexp_extract_all(text, '{_ISO}') FROM l UNION ALL SELECT doc, 3, regexp_extract_all(text, '{_IEC}') FROM l),
u AS (SELECT doc, g, unnest(found) AS label, generate_subscripts(found, 1) AS i FROM g),
n AS (SELECT doc, g, i, regexp_replace(label, '\\s+', ' ', 'g') AS label FROM u),
k AS (SELECT *, 'cite:' || trim(regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g'), '-') AS node FROM n QUALIFY row_number() OVER (PARTITION BY doc, node ORDER BY g, i) = 1)
SELECT doc, node, label, CAST(row_number() OVER (PARTITION BY doc ORDER BY g, i) - 1 AS INTEGER) AS place FROM k""")
def cited_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's text cites, by three grammars in turn, the first spelling of each reference."""
    lines = read(spark, sf_dir, "lineitem").join(form(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"))
    one = F.struct("l_linenumber", "p_partkey", "l_suppkey", "ref")
    texts = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["ref"]), "; see ").alias("text"))
    return texts.select("doc", F.posexplode(STD.cited(F.col("text"))).alias("place", "x")).select("doc", "place", "x.*")


@query(f"""WITH r AS (SELECT p_partkey, p_size, {_FORM} AS ref FROM part)
SELECT p_partkey, ref, CASE WHEN regexp_matches(ref, '^(STD\\s+)?[RDBGEVS]\\s*\\d{{1,3}}') THEN 'doc:' || trim(regexp_replace(ref, '[^A-Za-z0-9]+', '-', 'g'), '-') END AS node,
  CASE WHEN regexp_matches(ref, '^(?:STD\\s+)?[RDBGEVS]\\s*\\d{{1,3}}') THEN 'family:' || regexp_extract(ref, '^(?:STD\\s+)?([RDBGEVS])', 1) || '-' || regexp_extract(ref, '^(?:STD\\s+)?[RDBGEVS]\\s*(\\d{{1,3}})', 1) END AS family,
  nullif(regexp_extract(ref, '^STD [RDBGEVS]\\s*0*(\\d{{1,3}})(?:-\\d)?(?::\\d{{4}})?$', 1), '') AS number,
  nullif(regexp_extract(ref, '^STD [RDBGEVS]\\s*\\d{{1,3}}(?:-\\d)?:(\\d{{4}})$', 1), '') AS edition FROM r""")
def reference_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference's node and family in the graph, and its number and edition, null outside the grammar."""
    ref = F.col("ref")
    parsed = STD.parse(ref)
    return form(spark, sf_dir).select("p_partkey", "ref", STD.node(ref).alias("node"), STD.family_node(ref).alias("family"), parsed["number"].alias("number"), parsed["edition"].alias("edition"))


@query("""WITH h AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'STD R ' || o_custkey % 1200 || ':2003 (E)' WHEN 1 THEN 'STD D X' WHEN 2 THEN 'G ' || o_custkey % 40 || ':0000' WHEN 3 THEN '' END AS header,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Annexes to STD R ' || o_custkey % 7 || ':2017' ELSE 'A title' END AS title,
  (['r', 'd', 'q', 'x-'])[o_orderkey % 4 + 1] || o_custkey % 900 || '-' || year(o_orderdate) AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'a guide' END AS doctype FROM orders),
p AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(header, ''), '\\s*\\((E|F|E/F)\\)\\s*$', ''), ':(0000|XXXX)\\b', '')) AS docid FROM h),
d AS (SELECT *, upper(regexp_extract(docid, '^(?:STD\\s+)?([RBVDGES ])\\s*\\d+', 1)) AS dl, regexp_extract(docid, '^(?:STD\\s+)?[RBVDGES ]\\s*(\\d+)', 1) AS dn,
  regexp_extract(title, '^Annexes to STD R (\\d+)', 1) AS an, upper(regexp_extract(slug, '^([a-z]+)\\d', 1)) AS sl, regexp_extract(slug, '^[a-z]+(\\d+)', 1) AS sn, right(slug, 4) AS yr FROM p),
e AS (SELECT *, coalesce(TRY_CAST(dn AS INT), 0) BETWEEN 1 AND 999 AS ok FROM d)
SELECT o_orderkey, CASE WHEN an <> '' AND NOT (ok AND dl = 'R' AND dn = an) THEN 'STD R ' || an || ' (Annexes)' WHEN ok THEN docid WHEN sl IN ('R', 'D') THEN 'STD ' || sl || ' ' || sn || ':' || yr
  WHEN doctype IS NOT NULL AND regexp_extract(slug, '(?:^|[a-z])(\\d{1,3})', 1) <> '' AND CAST(regexp_extract(slug, '(?:^|[a-z])(\\d{1,3})', 1) AS INT) BETWEEN 1 AND 999 THEN 'STD G ' || regexp_extract(slug, '(?:^|[a-z])(\\d{1,3})', 1) || ':' || yr
  WHEN sl <> '' THEN 'STD ' || sl || ' ' || sn || ':' || yr WHEN regexp_matches(slug, '^x-\\d') THEN 'STD X ' || regexp_extract(slug, '^x-(\\d+)', 1) || ':' || yr ELSE docid END AS identifier FROM e""")
def classified_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's identifier by title, header, slug and type, in their order of precedence."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda *x: F.concat(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    header = F.when(key % 5 == 0, s("STD R ", cust % 1200, ":2003 (E)")).when(key % 5 == 1, "STD D X").when(key % 5 == 2, s("G ", cust % 40, ":0000")).when(key % 5 == 3, "")
    title = F.when(key % 11 == 0, s("Annexes to STD R ", cust % 7, ":2017")).otherwise("A title")
    name = s(F.get(F.array(*map(F.lit, ("r", "d", "q", "x-"))), (key % 4).cast("int")), cust % 900, "-", F.year("o_orderdate"))
    attrs = F.map_filter(F.create_map(F.lit("docidentifier"), header, F.lit("doctype"), F.when(key % 3 == 0, "a guide")), lambda _, v: v.isNotNull())
    return read(spark, sf_dir, "orders").select("o_orderkey", STD.classify(title, attrs, name)["identifier"].alias("identifier"))


#: A record of a publication for each order: one in ten is none; some name a successor, amend another, or relate otherwise.
_RECORDS = """rec AS (SELECT o_orderkey AS place, o_orderkey % 10 = 0 AS junk, CASE WHEN o_custkey % 2 = 0 THEN 'R' ELSE 'D' END AS letter, o_custkey % 40 + 1 AS num, CASE o_orderkey % 3 WHEN 1 THEN '1' WHEN 2 THEN '2' END AS part,
  1990 + o_orderkey % 12 AS ed, CASE o_orderstatus WHEN 'F' THEN 'in-force' WHEN 'P' THEN 'withdrawn' ELSE 'unknown' END AS status, o_orderpriority AS title FROM orders),
pub AS (SELECT *, letter || '-' || num AS family, 'STD-' || letter || '-' || num || coalesce('-' || part, '') || '-' AS stem, 'doc:STD-' || letter || '-' || num || coalesce('-' || part, '') || '-' || ed AS node FROM rec WHERE NOT junk),
rel AS (SELECT node AS src, 'doc:' || stem || (ed + 2) AS dst, 'successor' AS kind FROM pub WHERE place % 5 = 1 UNION SELECT node, 'doc:STD-' || letter || '-' || (num + 1) || '-' || ed, 'amends' FROM pub WHERE place % 7 = 2 UNION SELECT node, 'family:' || family, 'part_of' FROM pub),
doc AS (SELECT node, min(place) AS place, arg_min(family, place) AS family, arg_min(part, place) AS part, CAST(arg_min(ed, place) AS VARCHAR) AS edition, arg_min(status, place) AS status FROM pub GROUP BY node),
succ AS (SELECT src AS node, max(dst) AS superseded_by FROM rel WHERE kind = 'successor' GROUP BY 1),
act AS (SELECT node FROM doc LEFT JOIN succ USING (node) WHERE superseded_by IS NULL AND status NOT IN ('superseded', 'withdrawn') QUALIFY row_number() OVER (PARTITION BY family, part ORDER BY edition DESC, place) = 1),
reg AS (SELECT doc.*, superseded_by, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE status END AS derived_status, node IN (SELECT node FROM act) AS active FROM doc LEFT JOIN succ USING (node))"""


def publication_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumns({
        "letter": F.when(F.col("o_custkey") % 2 == 0, "R").otherwise("D"), "num": F.col("o_custkey") % 40 + 1, "ed": 1990 + key % 12, "tail": F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("-"), key % 3)),
    })
    name = F.when(key % 10 == 0, "A circular").otherwise(F.concat(F.lit("STD "), "letter", F.lit(" "), "num", "tail", F.lit(":"), "ed"))
    other = lambda kind, *x: F.struct(F.lit(kind).alias("type"), F.array(F.concat(F.lit("STD "), "letter", F.lit(" "), *x)).alias("identifiers"))
    relations = F.array_compact(F.array(
        F.when(key % 5 == 1, other("hasSuccessor", "num", "tail", F.lit(":"), F.col("ed") + 2)), F.when(key % 7 == 2, other("updates", F.col("num") + 1, F.lit(":"), "ed")), F.when(key % 2 == 0, other("cites", "num", F.lit(":1900"))),
    ))
    status = F.when(F.col("o_orderstatus") == "F", "in-force").when(F.col("o_orderstatus") == "P", "withdrawn")
    names = F.array(F.struct(F.lit("an alias").alias("content"), F.lit(False).alias("primary")), F.struct(name.alias("content"), F.lit(True).alias("primary")))
    titles = F.array(F.struct(F.lit("fra").alias("language"), F.lit("titre").alias("content")), F.struct(F.lit("eng").alias("language"), F.col("o_orderpriority").alias("content")))
    return o.select(key.alias("place"), name.alias("name"), F.col("ed").cast("string").alias("ed"), names.alias("identifiers"), titles.alias("titles"), status.alias("status"), relations.alias("relations"))


@query(f"WITH {_RECORDS} SELECT node, family, part, edition, status, derived_status, superseded_by, active FROM reg")
def publication_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of editions: derived status, successor, and the active edition of each family and part."""
    found = graphbuild.publications(publication_records(spark, sf_dir), STD)
    docs = graphbuild.registry(found, graphbuild.record_edges(found, STD))
    return docs.select("node", "family", "part", "edition", "status", "derived_status", "superseded_by", "active")


@query(f"""WITH {_RECORDS}, l AS (SELECT l_orderkey, string_agg({_FORM}, '; see ' ORDER BY l_linenumber, p_partkey, l_suppkey) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
b AS (SELECT family, part, CASE WHEN place % 3 = 1 THEN '1899' ELSE CAST(ed AS VARCHAR) END AS edition, text FROM pub JOIN l ON l_orderkey = place WHERE place % 4 = 0 OR place % 4 = 3),
s AS (SELECT b.family, b.part, text, coalesce(x.node, m.node) AS src FROM b JOIN (SELECT family, part, node FROM reg QUALIFY row_number() OVER (PARTITION BY family, part ORDER BY active DESC, edition DESC, place) = 1) m
  ON m.family = b.family AND m.part IS NOT DISTINCT FROM b.part LEFT JOIN doc x ON x.family = b.family AND x.part IS NOT DISTINCT FROM b.part AND x.edition = b.edition),
u AS (SELECT family, part, src, unnest(list_concat(list_concat(regexp_extract_all(text, '{_OWN}'), regexp_extract_all(text, '{_ISO}')), regexp_extract_all(text, '{_IEC}'))) AS raw FROM s),
c AS (SELECT DISTINCT src, 'cite:' || trim(regexp_replace(raw, '[^A-Za-z0-9]+', '-', 'g'), '-') AS dst FROM u WHERE NOT (regexp_matches(raw, '^STD [RDBGEVS]\\s*\\d')
  AND regexp_extract(raw, '^STD ([RDBGEVS])', 1) || '-' || regexp_extract(raw, '^STD [RDBGEVS]\\s*(\\d+)', 1) = family AND nullif(regexp_extract(raw, '^STD [A-Z]+\\s+\\d+-([A-Za-z0-9]+)', 1), '') IS NOT DISTINCT FROM part)),
e AS (SELECT src, dst, kind FROM rel UNION SELECT src, dst, 'cites' FROM c UNION SELECT 'doc:STD-R-' || (s_suppkey % 45) || '-2001', 'concept:' || s_suppkey, 'defines' FROM supplier),
n AS (SELECT node AS id FROM pub UNION SELECT 'family:' || family FROM pub UNION SELECT dst FROM c UNION SELECT 'concept:' || s_suppkey FROM supplier)
SELECT src, dst, kind FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def publication_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the whole graph: parts, successors, amendments, citations without those of oneself, and definitions."""
    records = publication_records(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").join(form(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"))
    one = F.struct("l_linenumber", "p_partkey", "l_suppkey", "ref")
    texts = lines.groupBy(F.col("l_orderkey").alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["ref"]), "; see ").alias("text"))
    edition = F.when(F.col("place") % 3 == 1, "1899").otherwise(F.col("ed"))
    title = F.when(F.col("place") % 4 == 0, "Annex: BIBLIOGRAPHY").when(F.col("place") % 4 == 3, "Normative  reference")
    passages = records.join(texts, "place").select(F.col("name").alias("identifier"), edition.alias("edition"), title.alias("title"), "text")
    key = F.col("s_suppkey")
    source = F.concat(F.lit("STD R "), key % 45, F.lit(":2001"))
    concepts = read(spark, sf_dir, "supplier").select(key.cast("string").alias("concept_id"), F.col("s_name").alias("term"), F.array(F.lit("a book"), source).alias("sources"))
    return graphbuild.build(records, passages, concepts, STD)[2]


#: An edition for each order: of a base, a part or an annex of its family, in two corpora and three languages.
_EDITIONS = """ed AS (SELECT o_orderkey AS place, CASE WHEN o_custkey % 2 = 0 THEN 'R' ELSE 'D' END AS doctype, CAST(o_custkey % 400 + 1 AS VARCHAR) AS number, CASE o_orderkey % 5 WHEN 1 THEN '-1' WHEN 2 THEN '-2' WHEN 3 THEN '-Annex A' WHEN 4 THEN '-12' ELSE '' END AS tail,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(1990 + o_orderkey % 12 AS VARCHAR) END AS edition, ['en', 'fr', 'de'][o_orderkey % 3 + 1] AS language, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' — ' || o_custkey ELSE '' END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'clean' ELSE 'dirty' END AS corpus FROM orders),
id AS (SELECT *, 'STD ' || doctype || ' ' || number AS base, 'STD ' || doctype || ' ' || number || tail AS identity, trim(split_part(title, '—', 1)) AS short FROM ed),
best AS (SELECT doctype, number, base, identity, min(place) AS first, arg_max(short, (corpus = 'clean', CASE WHEN edition = '' THEN '0000' ELSE edition END, language = 'en', -place)) AS short FROM id GROUP BY ALL),
fam AS (SELECT doctype, number, base, count(*) AS n, count(*) FILTER (regexp_matches(identity, '-[0-9]')) AS parts, count(*) FILTER (contains(identity, 'Annex')) AS annexes,
  string_agg('- ' || identity || ' — ' || short, chr(10) ORDER BY first) FILTER (identity <> base) AS lines, string_agg('- ' || identity || ' — ' || short, chr(10) ORDER BY first) AS members FROM best GROUP BY ALL HAVING count(*) >= 2)"""


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    letter, number = F.when(cust % 2 == 0, "R").otherwise("D"), (cust % 400 + 1).cast("string")
    tail = F.when(key % 5 == 1, "-1").when(key % 5 == 2, "-2").when(key % 5 == 3, "-Annex A").when(key % 5 == 4, "-12").otherwise("")
    year = F.when(key % 11 == 0, "").otherwise((1990 + key % 12).cast("string"))
    return read(spark, sf_dir, "orders").select(
        key.alias("place"), key.alias("doc_id"), letter.alias("doctype"), number.alias("number"), F.concat(F.lit("STD "), letter, F.lit(" "), number, tail, F.when(year != "", F.concat(F.lit(":"), year)).otherwise("")).alias("identifier"),
        year.alias("edition"), F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (key % 3).cast("int")).alias("language"),
        F.concat("o_orderpriority", F.when(key % 2 == 0, F.concat(F.lit(" — "), cust)).otherwise("")).alias("title"), F.when(key % 4 == 0, "clean").otherwise("dirty").alias("corpus"),
    )


_WHAT = "parts || ' part' || CASE WHEN parts <> 1 THEN 's' ELSE '' END || CASE WHEN annexes > 0 THEN ' and ' || annexes || ' annex' || CASE WHEN annexes <> 1 THEN 'es' ELSE '' END ELSE '' END"


@query(f"""WITH {_EDITIONS}, t AS (SELECT doctype, number, arg_max(short, (identity = base, identity = base AND corpus = 'clean', -place)) AS title FROM id GROUP BY ALL)
SELECT doctype, number, base, parts, annexes, title || ' (' || base || ') is a multi-part STD publication. It comprises ' || {_WHAT} || ':' || chr(10) || lines || chr(10) || chr(10) || base || ' has ' || {_WHAT} || ' (' || (parts + annexes) || ' components total).' AS text FROM fam JOIN t USING (doctype, number)""")
def family_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage on each family: its parts and annexes, each by its best edition."""
    return families.family_notes(editions(spark, sf_dir), "STD")


@query(f"""WITH {_EDITIONS}, sec AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS pos, ['Scope', 'Tests', 'Introduction of it', 'Foreword', 'Limits'][l_linenumber % 5 + 1] AS title FROM lineitem),
q AS (SELECT doc_id, string_agg(title || ': ' || repeat(title || ' ', 200)[1:900], chr(10) || chr(10) ORDER BY pos) AS quoted FROM (SELECT * FROM sec WHERE title IN ('Scope', 'Introduction of it', 'Foreword') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3) GROUP BY 1)
SELECT place AS doc_id, md5(concat_ws(chr(10) || chr(10), title || ' — ' || identity || CASE WHEN edition <> '' THEN ':' || edition ELSE '' END || ' (' || language || ').', CASE WHEN doctype = 'R' THEN 'An STD Recommendation.' END, quoted,
  'Document family — ' || identity || CASE WHEN edition <> '' THEN ':' || edition ELSE '' END || ' comprises:' || chr(10) || members)) AS text FROM id LEFT JOIN q ON q.doc_id = place LEFT JOIN fam USING (doctype, number)""")
def document_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage on each edition, with its opening sections and its family."""
    title = F.get(F.array(*map(F.lit, ("Scope", "Tests", "Introduction of it", "Foreword", "Limits"))), F.col("l_linenumber") % 5)
    sections = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), title.alias("title")).distinct()
    text = lambda t: F.repeat(F.concat(t, F.lit(" ")), F.lit(200))
    return families.overviews(editions(spark, sf_dir), sections, "STD", {"R": "Recommendation"}, text).withColumn("text", F.md5(F.col("text").cast("binary")))
