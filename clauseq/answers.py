"""Registered queries of answers against their passages, languages of units and shortened texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseq.catalogue import asked, query, read
from clauseq.operators import grounding, language

_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop)}))) AS h_{lang}" for lang, stop in language.STOPWORDS.items())


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 1600)), '[a-zà-öø-ÿ]+') AS w FROM documents), h AS (SELECT doc_id, len(w) AS n, {_HITS} FROM w),
s AS (SELECT *, list_reverse_sort([h_en, h_fr, h_es, h_de]) AS s FROM h)
SELECT doc_id, CASE WHEN n >= 20 AND s[1] >= 3 AND s[1] > 1.5 * s[2] THEN CASE s[1] WHEN h_en THEN 'en' WHEN h_fr THEN 'fr' WHEN h_es THEN 'es' ELSE 'de' END END AS tag FROM s""")
def unit_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's language by all stop words of the four languages."""
    return read(spark, sf_dir, "documents").select("doc_id", language.unit_language(F.col("text")).alias("tag"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, regexp_replace(text, '[\[\]"“”‟«»\n]', ' ', 'g') AS said, coalesce(prev, '') AS prev FROM c),
f AS (SELECT *, lower(regexp_replace(replace(translate(prev, '‘’‛′“”‟″–—−', chr(39) || chr(39) || chr(39) || chr(39) || repeat(chr(34), 4) || '---'), chr(173), ''), '\s+', ' ', 'g')) AS hay,
  lower(regexp_replace(translate(said, '‘’‛′″–—−', chr(39) || chr(39) || chr(39) || chr(39) || chr(34) || '---'), '\s+', ' ', 'g')) AS whole, lower(regexp_replace(left(prev, 30), '[\[\]"“”‟«»\n]', ' ', 'g')) AS bit FROM s)
SELECT conv_id, turn, CASE WHEN length(said) > 0 AND NOT contains(hay, whole) THEN 1 ELSE 0 END + CASE WHEN length(bit) > 0 AND NOT contains(hay, regexp_replace(bit, '\s+', ' ', 'g')) THEN 1 ELSE 0 END AS missing FROM f""")
def quoted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that quotes a turn whole, and the beginning of the one before, in one anchor, against the turn before."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    c = c.withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")), F.lit("")))
    plain = lambda x: F.regexp_replace(x, '[\\[\\]"“”‟«»\n]', " ")
    answer = F.concat(F.lit("As said [1, «"), plain(F.col("text")), F.lit("» and “"), plain(F.left("prev", F.lit(30))), F.lit("”]."))
    return c.select("conv_id", "turn", F.size(grounding.unfounded(answer, F.col("prev"))).alias("missing"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey, o_custkey % 30 AS doc, o_custkey % 9 + 1 || '.' || o_orderkey % 7 AS c1, o_custkey % 9 + 1 || '.' || (o_orderkey % 7 + 2) || '.1' AS c2, o_orderkey % 12 || '.3' AS c3 FROM orders),
t AS (SELECT o_orderkey, doc, unnest([c1, c2, c3]) AS clause FROM a), k AS (SELECT DISTINCT l_suppkey % 30 AS doc, l_linenumber || '.' || l_partkey % 9 || CASE WHEN l_partkey % 2 = 0 THEN '.' || l_orderkey % 3 ELSE '' END AS clause FROM lineitem WHERE l_orderkey % 40 = 0)
SELECT DISTINCT o_orderkey, doc, clause FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = t.doc AND (k.clause = t.clause OR starts_with(k.clause, t.clause || '.')))""")
def clause_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses that an answer cites and its document has not; some are ends of a range."""
    key, doc = F.col("o_orderkey"), F.col("o_custkey") % 30
    answer = F.concat(F.lit("See "), F.col("o_custkey") % 9 + 1, F.lit("."), key % 7, F.lit("–"), F.col("o_custkey") % 9 + 1, F.lit("."), key % 7 + 2, F.lit(".1 and 2024, also clause "), key % 12, F.lit(".3 (not 5)."))
    answers = read(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"), answer.alias("answer"))
    tail = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("."), F.col("l_orderkey") % 3)).otherwise("")
    clauses = read(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 0").select((F.col("l_suppkey") % 30).alias("doc"), F.concat("l_linenumber", F.lit("."), F.col("l_partkey") % 9, tail).alias("clause"))
    return grounding.missing_clauses(answers, clauses, ["doc"], ["o_orderkey"]).select("o_orderkey", "doc", "clause")


_WORDS = ", ".join(repr(w) for w in grounding.STOP)
_TERMS = f"list_filter(regexp_extract_all({{x}}, '[a-z0-9]+(?:[.][0-9]+)?'), lambda t: regexp_matches(t, '^[0-9]') OR (length(t) >= 3 AND t NOT IN ({_WORDS})))"


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS clean, list_distinct({_TERMS.format(x="lower(b.text)")}) AS asked FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE d.text IS NOT NULL),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(clean, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM d),
u AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS x, asked FROM s WHERE length(clean) > 600 AND len(ss) > 1),
t AS (SELECT doc_id, i, length(x) AS n, x, {_TERMS.format(x="lower(x)")} AS ts, asked FROM u),
v AS (SELECT doc_id, i, n, x, CASE WHEN len(ts) = 0 THEN 0.0 ELSE round(len(list_filter(ts, lambda t: list_contains(asked, t))) / sqrt(len(ts)) + CASE WHEN regexp_matches(x, '[0-9]') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 9) END AS v FROM t),
r AS (SELECT doc_id, list({{'i': i, 'n': n}} ORDER BY v DESC, i) FILTER (i > 0) AS ranked, any_value(n) FILTER (i = 0) + 1 AS used FROM v GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(ranked, lambda acc, e: CASE WHEN acc.used + e.n + 1 <= 600 THEN {{'used': acc.used + e.n + 1, 'kept': list_append(acc.kept, e.i), 'n': 0::BIGINT, 'i': 0::BIGINT}} ELSE acc END, {{'used': CAST(used AS BIGINT), 'kept': [0::BIGINT], 'n': 0::BIGINT, 'i': 0::BIGINT}}) AS a
  FROM (SELECT doc_id, used, list_transform(ranked, lambda e: {{'used': 0::BIGINT, 'kept': [0::BIGINT], 'n': CAST(e.n AS BIGINT), 'i': CAST(e.i AS BIGINT)}}) AS ranked FROM r)),
o AS (SELECT doc_id, substr(trim(string_agg(x, ' ' ORDER BY i)), 1, 600) AS short FROM v JOIN k USING (doc_id) WHERE list_contains(a.kept, i) GROUP BY doc_id),
c AS (SELECT doc_id, clean, left(clean, 600) AS cut, len(ss) AS m FROM s),
e AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS place FROM c)
SELECT doc_id, md5(CASE WHEN length(clean) <= 600 THEN clean WHEN m <= 1 THEN trim(CASE WHEN contains(cut, ' ') AND place > 40 THEN left(cut, place) ELSE cut END) ELSE short END) AS short FROM e LEFT JOIN o USING (doc_id)""")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in 600 characters, for one of the passages as the question."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").join(asked(spark, sf_dir).withColumnRenamed("text", "question"), F.col("doc_id") % 40 == F.col("query_id"))
    return grounding.shortened(d.select("doc_id", "text", "question"), "text", "question", 600, "short").select("doc_id", F.md5(F.col("short").cast("binary")).alias("short"))
