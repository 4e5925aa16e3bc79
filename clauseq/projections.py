"""Scalar projections and filters of the reference over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseq.catalogue import query, read
from clauseq.functions import text as T


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 2800 THEN rtrim(substr(text, 1, 2799)) || ' …' ELSE text END) AS clamped FROM documents WHERE text IS NOT NULL""")
def field_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(T.clamp_text(F.col("text")).cast("binary")).alias("clamped"))


@query(r"""WITH i AS (SELECT o_orderkey, 'R ' || o_custkey % 100 || ':' || CASE WHEN o_orderkey % 3 = 0 THEN '0000' WHEN o_orderkey % 3 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'XXXX' END || CASE WHEN o_orderkey % 2 = 0 THEN ' (E)' ELSE '' END AS ident FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(ident, '\s*\((E|F|E/F)\)\s*$', ''), ':(0000|XXXX)$', '') AS sanitized,
 trim(regexp_replace(regexp_replace(regexp_replace(ident, ':(19|20)[0-9]{2}(\s*\([A-Z]\))?\s*$', ''), ':(19|20)[0-9]{2}(\s*\([A-Z]\))?\s*$', ''), '\s+', ' ', 'g')) AS normalized FROM i""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    year = F.when(key % 3 == 0, "0000").when(key % 3 == 1, F.year("o_orderdate").cast("string")).otherwise("XXXX")
    ident = F.concat(F.lit("R "), F.col("o_custkey") % 100, F.lit(":"), year, F.when(key % 2 == 0, " (E)").otherwise(""))
    o = read(spark, sf_dir, "orders").select("o_orderkey", ident.alias("ident"))
    return o.select("o_orderkey", T.sanitize_identifier(F.col("ident")).alias("sanitized"), T.normalize_identifier(F.col("ident")).alias("normalized"))


@query(r"""WITH s AS (SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '[^a-z0-9]+', '-', 'g'), '-') || CASE page_id % 3 WHEN 0 THEN '-fr' WHEN 1 THEN '-de' ELSE '' END AS slug, url FROM pages)
SELECT page_id, CASE WHEN ends_with(slug, '-fr') THEN 'fr' WHEN ends_with(slug, '-es') THEN 'es' WHEN ends_with(slug, '-en') THEN 'en' WHEN ends_with(slug, '-de') THEN 'de' ELSE 'en' END AS lang,
 regexp_extract(url, '(^|[^0-9])((19|20)[0-9]{2})([^0-9]|$)', 2) AS year FROM s""")
def slug_language_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauseq.functions.tokens import slug

    mark = F.when(F.col("page_id") % 3 == 0, "-fr").when(F.col("page_id") % 3 == 1, "-de").otherwise("")
    name = F.concat(slug(F.regexp_replace("url", "[?#].*$", "")), mark)
    return read(spark, sf_dir, "pages").select("page_id", T.slug_language(name).alias("lang"), T.first_year(F.col("url")).alias("year"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^<>]{1,120}>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("plain"))


@query(r"""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size || '.' || p_partkey % 7 ELSE 'annex' || p_size END AS anchor FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(anchor, '[0-9]+(\.[0-9]+)*') THEN array_to_string(list_transform(string_split(anchor, '.'), lambda x: CAST(x AS INT)), '/') END AS path,
 row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(string_split(anchor, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 1000000000)), p_partkey) AS place FROM n""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted anchors as paths, and their order, others last."""
    key = F.col("p_partkey")
    n = read(spark, sf_dir, "part").withColumn("anchor", F.when(key % 4 == 0, F.concat_ws(".", "p_size", key % 7)).otherwise(F.concat(F.lit("annex"), "p_size")))
    w = Window.partitionBy("p_brand").orderBy(T.anchor_sort_key(F.col("anchor")), "p_partkey")
    return n.select("p_partkey", F.array_join(T.anchor_path(F.col("anchor")).cast("array<string>"), "/").alias("path"), F.row_number().over(w).alias("place"))


@query(r"""SELECT doc_id, CAST(w + ceil((length(text) - w) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g')) AS w FROM documents WHERE text IS NOT NULL)""")
def est_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 8 AND prev IS NOT NULL AND trim(prev) <> '' THEN trim(prev) || ' — ' || trim(text) ELSE trim(text) END AS asked FROM c""")
def fold_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    c = c.withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    return c.select("conv_id", "turn", T.retrieval_query(F.col("text"), F.col("prev")).alias("asked"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || '|' || coalesce(role, '') || '|g7') AS key, substr(regexp_replace(trim(text), '^["'']+|["'']+$', '', 'g'), 1, 400) AS context
FROM conversations WHERE text IS NOT NULL""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of an answer (with the corpus generation as salt), and a normalised context."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", T.cache_key(F.col("text"), F.col("role"), "g7").alias("key"), T.normalize_context(F.col("text")).alias("context"))


@query(r"""SELECT vec_id, CASE label % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'it' ELSE 'en' END AS lang FROM embeddings""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("ENG", "fra ", "ger", "it", "")))
    return read(spark, sf_dir, "embeddings").select("vec_id", T.normalize_language(F.get(codes, F.col("label") % 5)).alias("lang"))


@query(r"""WITH r AS (SELECT l_orderkey, l_linenumber, '[[u:p' || l_partkey || ']] and [[u:u:s' || l_suppkey || ']] again [[u:p' || l_partkey || ']] [[x]]' AS t FROM lineitem),
x AS (SELECT *, list_transform(regexp_extract_all(t, '\[\[((u:)+[^\[\]]+)\]\]', 1), lambda v: regexp_replace(v, '^(u:)+', 'u:')) AS v FROM r)
SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN len(v) = 0 THEN v ELSE [v[1], v[2]] END, ',') AS refs FROM x""")
def unit_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("[[u:p"), "l_partkey", F.lit("]] and [[u:u:s"), "l_suppkey", F.lit("]] again [[u:p"), "l_partkey", F.lit("]] [[x]]"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.unit_refs(t), ",").alias("refs"))


@query(r"""WITH n AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'about ' || s_suppkey || ' 500,5 kg' WHEN 1 THEN '1,234,' || 100 + s_suppkey % 900 || '.5' WHEN 2 THEN '-' || s_suppkey || ',25' ELSE 'none' END AS t FROM supplier)
SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN TRY_CAST(s_suppkey || '500.5' AS DOUBLE) WHEN 1 THEN 1234000 + 100 + s_suppkey % 900 + 0.5 WHEN 2 THEN -CAST(s_suppkey || '.25' AS DOUBLE) END AS DOUBLE) AS value FROM n""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("about "), k, F.lit(" 500,5 kg"))).when(k % 4 == 1, F.concat(F.lit("1,234,"), 100 + k % 900, F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit("-"), k, F.lit(",25"))).otherwise("none")
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.number_of(t).alias("value"))


@query(r"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(\.[0-9]+)?'), lambda x: regexp_matches(x, '^[0-9]') OR (length(x) >= 3 AND x NOT IN ('the', 'and', 'les', 'der'))) AS t FROM documents WHERE text IS NOT NULL)""")
def compress_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.compress_tokens(F.col("text"), ["the", "and", "les", "der"]).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(substr(text, 1, 1600)), '[a-zà-öø-ÿ]+') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS en, len(list_filter(w, lambda x: x IN ('le', 'et', 'la', 'les'))) AS fr FROM w)
SELECT doc_id, CASE WHEN n >= 20 AND en >= 3 AND en > 1.5 * fr THEN 'en' WHEN n >= 20 AND fr >= 3 AND fr > 1.5 * en THEN 'fr' END AS tag FROM h""")
def langid_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's language by stop words of its first 1,600 characters (the reference's own sample): it tags, and drops nothing."""
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, 1600)), F.lit("[a-zà-öø-ÿ]+"), 0)
    d = read(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    hits = lambda *stop: F.size(F.filter("w", lambda x: x.isin(*stop)))
    d = d.select("doc_id", F.size("w").alias("n"), hits("the", "and", "of").alias("en"), hits("le", "et", "la", "les").alias("fr"))
    return d.select("doc_id", F.when(F.expr("n >= 20 AND en >= 3 AND en > 1.5 * fr"), "en").when(F.expr("n >= 20 AND fr >= 3 AND fr > 1.5 * en"), "fr").alias("tag"))


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'excluded' WHEN lang <> 'en' THEN 'declared' WHEN len(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+')) < 100 THEN 'shell' ELSE 'full' END AS verdict
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def load_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusion list comes first; other declared languages pass unchecked; short texts are shells."""
    out = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("x")).distinct()
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL").join(out, "doc_id", "left")
    short = F.size(F.split(F.trim("text"), r"[ \t\n\r]+")) < 100
    return d.select("doc_id", F.when(F.col("x"), "excluded").when(F.col("lang") != "en", "declared").when(short, "shell").otherwise("full").alias("verdict"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").where(F.col("lang").isin("en")).join(excluded, "doc_id", "left_anti").select("doc_id", "lang")


@query(r"""WITH p AS (SELECT c.conv_id, c.turn, c.text, lag(c.text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations c WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN contains(trim(regexp_replace(lower(coalesce(prev, '')), '\s+', ' ', 'g')), trim(regexp_replace(lower(replace(substr(text, 1, 20), '"', '')), '\s+', ' ', 'g'))) THEN 0 ELSE 1 END AS missing FROM p WHERE NOT regexp_matches(substr(text, 1, 20), '[\[\]"“”’‘«»]') AND length(text) > 0""")
def quote_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the quotation of an answer stands in its passage; here a turn's opening, quoted against the turn before it."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    c = c.withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")), F.lit("")))
    c = c.withColumn("start", F.substring("text", 1, 20)).where("length(text) > 0").where(~F.col("start").rlike(r'[\[\]"“”’‘«»]'))
    answer = F.concat(F.lit('As said [1, "'), "start", F.lit('"].'))
    return c.select("conv_id", "turn", F.size(T.quotes_missing(answer, F.col("prev"))).alias("missing"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?m)^\s*\|.+\|\s*$') AND length(text) - length(replace(text, '|', '')) >= 6 AS retyped, regexp_matches(lower(text), 'how many|number of|count') AS counts,
 regexp_matches(text, '(^|[^A-Za-z0-9_])(ISO|IEC|ASTM|EN)[ /]?[0-9]{3,6}') AS cites, regexp_matches(lower(substr(text, 1, 400)), 'bibliograph|normative references') AS bibliography FROM documents WHERE text IS NOT NULL""")
def shape_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean shapes: a table typed again, a counting question, a cited standard, a bibliography (by its first 400 characters, as in the reference)."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", T.is_retyped_table(t).alias("retyped"), F.lower(t).rlike("how many|number of|count").alias("counts"),
        t.rlike("(^|[^A-Za-z0-9_])(ISO|IEC|ASTM|EN)[ /]?[0-9]{3,6}").alias("cites"), F.lower(F.substring(t, 1, 400)).rlike("bibliograph|normative references").alias("bibliography"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sha256(CAST(event_id AS VARCHAR) || '|' || event_type)[1:16] AS id16 FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.substring(F.sha2(F.concat_ws("|", "event_id", "event_type").cast("binary"), 256), 1, 16).alias("id16"))


@query("""WITH t AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part) SELECT p_partkey, 'name = ' || p_name || '; brand = ' || p_brand || CASE WHEN p_size > 10 THEN '; size = ' || p_size ELSE '' END AS embed,
 rpad(p_brand, 12, ' ') || '| ' || rpad(CAST(p_size AS VARCHAR), 4, ' ') AS grid FROM t""")
def table_rows_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's row as pairs without empty values, and as a padded line."""
    pairs = [("name", F.col("p_name")), ("brand", F.col("p_brand")), ("size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))]
    embed = F.concat_ws("; ", *(F.concat(F.lit(f"{k} = "), v) for k, v in pairs))
    return read(spark, sf_dir, "part").select("p_partkey", embed.alias("embed"), F.concat(F.rpad("p_brand", 12, " "), F.lit("| "), F.rpad(F.col("p_size").cast("string"), 4, " ")).alias("grid"))


@query("""SELECT page_id, count(*) AS n, string_agg(h, ' > ' ORDER BY i) AS headings FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
 SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS hs FROM pages)) GROUP BY page_id""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    clean = F.transform(heads, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    return read(spark, sf_dir, "pages").select("page_id", clean.alias("hs")).where("size(hs) > 0").select("page_id", F.size("hs").cast("long").alias("n"), F.array_join("hs", " > ").alias("headings"))
