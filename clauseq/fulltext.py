"""Registered queries of the stemmed index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.catalogue import asked, query, read
from clauseq.functions.porter import STEP_2, STEP_3, STEP_4
from clauseq.functions.tokens import STOP
from clauseq.operators.textindex import TextIndex
from clauseq.plans.folders import kept, new_folder

#: The stemmer's measure as patterns over a word's consonants and vowels; a y is a vowel behind a consonant only, so never at the start.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_START = f"^({_C}{_V}|[aeiou]+)"
_SOME, _ONE, _MORE = f"{_START}{_C}", f"{_START}{_C}({_V})?$", f"{_START}{_C}{_V}{_C}"
_VOWEL, _CVC = "^[aeiou]|^.+[aeiouy]", "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"


def _suffixes(table, test: str, column: str) -> str:
    """The longest suffix decides, whether or not its test holds."""
    cases = []
    for suffix, new in sorted(table, key=lambda t: -len(t[0])):
        stem = f"left({column}, length({column}) - {len(suffix)})"
        cases.append(f"WHEN ends_with({column}, '{suffix}') AND length({column}) > {len(suffix)} THEN CASE WHEN {test.format(stem=stem)} THEN {stem} || '{new}' ELSE {column} END")
    return f"CASE {' '.join(cases)} ELSE {column} END"


def _stems_sql(words: str) -> str:
    """CTEs of `stem` (word, stem) for the words of a CTE, in ASCII or with signs of two bytes as consonants."""
    some, more = f"regexp_matches({{stem}}, '{_SOME}')", f"regexp_matches({{stem}}, '{_MORE}')"
    cut = lambda n: f"left(w, length(w) - {n})"
    ing = f"CASE WHEN length(w) > 3 AND ends_with(w, 'eed') THEN NULL WHEN length(w) > 2 AND ends_with(w, 'ed') AND regexp_matches({cut(2)}, '{_VOWEL}') THEN {cut(2)} WHEN length(w) > 3 AND ends_with(w, 'ing') AND regexp_matches({cut(3)}, '{_VOWEL}') THEN {cut(3)} END"
    tail = f"""CASE WHEN c IS NULL THEN CASE WHEN length(w) > 3 AND ends_with(w, 'eed') AND regexp_matches({cut(3)}, '{_SOME}') THEN {cut(1)} ELSE w END
      WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e' WHEN length(c) > 1 AND right(c, 1) = left(right(c, 2), 1) AND regexp_matches(c, '[bcdfghjkmnpqrtvwxy]$') THEN left(c, length(c) - 1)
      WHEN regexp_matches(c, '{_ONE}') AND regexp_matches(c, '{_CVC}') THEN c || 'e' ELSE c END"""
    ion = f"regexp_matches({{stem}}, '{_MORE}') AND NOT (ends_with(w, 'ion') AND NOT regexp_matches({{stem}}, '[st]$'))"
    short = f"regexp_matches({cut(1)}, '{_ONE}') AND NOT regexp_matches({cut(1)}, '{_CVC}')"
    return f"""a0 AS (SELECT DISTINCT word, word AS w FROM {words}),
a1 AS (SELECT word, CASE WHEN length(w) < 3 THEN w WHEN regexp_matches(w, '.(sses|ies)$') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END AS w FROM a0),
a2 AS (SELECT word, {tail} AS w FROM (SELECT word, w, {ing} AS c FROM a1)),
a3 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND regexp_matches({cut(1)}, '{_VOWEL}') THEN {cut(1)} || 'i' ELSE w END AS w FROM a2),
a4 AS (SELECT word, {_suffixes(STEP_2, some, 'w')} AS w FROM a3), a5 AS (SELECT word, {_suffixes(STEP_3, some, 'w')} AS w FROM a4),
a6 AS (SELECT word, {_suffixes([(s, '') for s in STEP_4], ion, 'w')} AS w FROM a5),
a7 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, '{_MORE}') OR ({short})) THEN {cut(1)} ELSE w END AS w FROM a6),
stem AS (SELECT word, CASE WHEN length(word) < 3 OR strlen(word) > 63 THEN word WHEN ends_with(w, 'll') AND regexp_matches({cut(1)}, '{_MORE}') THEN {cut(1)} ELSE w END AS stem FROM a7)"""


_QUOTED = ", ".join(f"'{w}'" for w in STOP)


def _ranked_sql(docs: str, k: int) -> str:
    """docs: a CTE of doc_id and text."""
    return f"""raw AS (SELECT item_id AS query_id, [x FOR x IN string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\s_-]', ' ', 'g'), '\\s+') IF length(x) BETWEEN 2 AND 40 AND x NOT IN ({_QUOTED})] AS t FROM benchmark),
q AS (SELECT query_id, strip_accents(unnest((list_transform(list_sort(list_transform(list_distinct(t), lambda x: {{'p': list_position(t, x), 'x': x}})), lambda s: s.x))[1:12])) AS word FROM raw),
dw AS (SELECT doc_id, len(ws) AS dl, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {docs})),
every AS (SELECT word FROM dw WHERE word IS NOT NULL UNION SELECT word FROM q), {_stems_sql('every')},
tf AS (SELECT doc_id, dl, stem, count(*) AS tf FROM dw JOIN stem USING (word) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT DISTINCT doc_id, dl FROM dw)),
idf AS (SELECT stem, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM tf, tot GROUP BY stem, n),
hits AS (SELECT query_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS bm25 FROM q JOIN stem USING (word) JOIN tf USING (stem) JOIN idf USING (stem), tot GROUP BY ALL)
SELECT query_id, doc_id, bm25, round(-bm25 / (1 - bm25), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS rank FROM hits QUALIFY rank <= {k}"""


def _searched(spark: SparkSession, sf_dir: str, k: int, *steps) -> DataFrame:
    """The steps done on a new index, the benchmark's passages searched in it; the index goes, its answer stays."""
    index = TextIndex(spark, new_folder(spark, "index"))
    for step in steps:
        step(index)
    found = kept(index.search(asked(spark, sf_dir), k))
    index.drop()
    return found


@query(f"WITH d AS (SELECT doc_id, text FROM documents), {_ranked_sql('d', 40)}")
def stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best documents of each passage by their stems, from an index that is built first."""
    return _searched(spark, sf_dir, 40, lambda index: index.upsert(read(spark, sf_dir, "documents")))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN right(text, 400) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3), {_ranked_sql('d', 10)}""")
def stemmed_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after documents came in two loads, some were replaced by their last 400 characters, and some deleted."""
    docs = read(spark, sf_dir, "documents")
    changed = docs.where("doc_id % 5 = 0").select("doc_id", F.expr("right(text, 400)").alias("text"))
    return _searched(
        spark, sf_dir, 10, lambda i: i.upsert(docs.where("doc_id % 2 = 0")), lambda i: i.upsert(docs.where("doc_id % 2 = 1")),
        lambda i: i.upsert(changed), lambda i: i.delete(docs.where("doc_id % 7 = 3")),
    )
