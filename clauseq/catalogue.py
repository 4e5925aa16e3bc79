"""The registered queries over the reference's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseq.functions.tokens import STOP, slug
from clauseq.operators import graph, language, lexical, tables, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_STOP = ", ".join(f"'{w}'" for w in STOP)
_TERMS = f"""
terms AS (SELECT item_id AS query_id, unnest(list_distinct_in_order) AS term FROM (
  SELECT item_id, (list_transform(list_sort(list_transform(list_distinct(t), lambda x: {{'p': list_position(t, x), 'x': x}})), lambda s: s.x))[1:12] AS list_distinct_in_order
  FROM (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) BETWEEN 2 AND 40 AND x NOT IN ({_STOP})) AS t FROM benchmark))),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents)
"""
_BM25 = f"""{_TERMS},
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM words) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(ws)) FROM words)))), 6) AS score
  FROM terms JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)
"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(read(spark, sf_dir, "documents"), asked(spark, sf_dir))


@query(f"""WITH {_BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored
WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')) QUALIFY rank <= 6""")
def lexical_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lexical.bm25_within(docs, asked(spark, sf_dir), docs.where(F.col("source").isin("src1", "src2", "src3")), 6)


@query(f"""WITH {_BM25}, ov AS (
  SELECT query_id, doc_id, count(*) AS c, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM terms JOIN (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM words) USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 10),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
  FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ov) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    return lexical.rrf([lexical.bm25_topk(docs, items), lexical.overlap_topk(docs, items)])


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank
FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return vectors.cosine_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop)}))) AS h_{lang}" for lang, stop in language.STOPWORDS.items())


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 30000)), '[a-zà-öø-ÿ]+') AS w, len(regexp_extract_all(substr(text, 1, 30000), '{language.OTHER_SCRIPTS}')) AS o FROM documents),
h AS (SELECT doc_id, len(w) AS n, o, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS latin, {_HITS} FROM d), r AS (SELECT *, list_reverse_sort([h_en, h_fr, h_es, h_de]) AS s FROM h)
SELECT doc_id, CASE WHEN latin + o > 200 AND o > 0.3 * (latin + o) THEN 'non-latin' WHEN n >= 150 AND s[1] >= 10 AND s[1] >= 2 * s[2] THEN
  CASE s[1] WHEN h_en THEN 'en' WHEN h_fr THEN 'fr' WHEN h_es THEN 'es' ELSE 'de' END END AS detected FROM r""")
def langid_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", language.stopword_language(F.col("text")).alias("detected"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256(url)[1:16] AS url_id FROM pages")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("slug"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16).alias("url_id"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total,
  round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 1) AS error_rate FROM events GROUP BY ALL""")
def stats_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type")
    wrong = F.count_if(F.col("event_type") == "error")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(100.0 * wrong / F.count(F.lit(1)), 1).alias("error_rate"))


@query("""WITH s AS (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, min(value) FILTER (i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))) AS p50,
       min(value) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS p95 FROM s GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nearest_rank(read(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_id, count(*) OVER w AS used, count(*) OVER w <= 3 AS allowed
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "ts")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("used", F.count(F.lit(1)).over(w)).select("user_id", "day", "event_id", "used", (F.col("used") <= 3).alias("allowed"))


@query("""SELECT o_custkey, o_orderdate, o_orderkey, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderkey) OVER w IS NULL AS active
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def edition_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.active_editions(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS valid, count(*) FILTER (o_orderstatus = 'P') AS suspended, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest
FROM orders GROUP BY o_custkey""")
def register_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return tables.latest_of(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", valid=status == "F", suspended=status == "P")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'medium'
  WHEN l_quantity > 30 THEN 'large' END AS step FROM lineitem""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("small", None, 10, False), ("medium", 10, 30, True), ("large", 30, None, True)]
    return tables.interval_lookup(read(spark, sf_dir, "lineitem"), "l_quantity", steps).select("l_orderkey", "l_linenumber", "step")


@query("""SELECT l_returnflag, count(1) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_quantity >= 10 AND l_linestatus = 'O'
GROUP BY l_returnflag ORDER BY n DESC, l_returnflag LIMIT 10""")
def db_find_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tables.find(
        read(spark, sf_dir, "lineitem"), [("l_quantity", "ge", 10), ("l_linestatus", "eq", "O")], ["l_returnflag"],
        [("count", "*", "n"), ("sum", "l_quantity", "qty")], [("n", True), ("l_returnflag", False)],
    )
    return got.withColumn("qty", F.round("qty", 2))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type ILIKE '%s%' ORDER BY p_partkey LIMIT 25""")
def db_find_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.find(read(spark, sf_dir, "part"), [("p_size", "between", (5, 20)), ("p_type", "like", "%s%")], order_by=[("p_partkey", False)], limit=25).select("p_partkey", "p_name", "p_brand")


@query("""SELECT d.* FROM (SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) d
UNION ALL SELECT doc_id, source, lang FROM documents o WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND NOT EXISTS
 (SELECT 1 FROM documents c WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND c.source = o.source AND c.lang = o.lang)""")
def precedence_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the lesser tier goes if the better tier has its source and language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    clean, other = docs.join(good, "doc_id", "left_semi"), docs.join(good, "doc_id", "left_anti")
    return clean.unionByName(other.join(clean.select("source", "lang").distinct(), ["source", "lang"], "left_anti").select("doc_id", "source", "lang"))


@query("""WITH t AS (SELECT conv_id, turn, least(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT), 600) AS tokens FROM conversations)
SELECT conv_id, turn, tokens, sum(tokens) OVER w <= 300 AS kept FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.least(F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4.0), F.lit(600)).cast("long")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("tokens")).withColumn("kept", F.sum("tokens").over(w) <= 300)


@query(f"""WITH {_BM25}, ov AS (
  SELECT query_id, doc_id, count(*) AS c, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM terms JOIN (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM words) USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 10),
f AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score
  FROM (SELECT query_id, doc_id, rank, 1.0::DOUBLE AS w FROM bm UNION ALL SELECT query_id, doc_id, rank, 1.2::DOUBLE FROM ov) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 15""")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    return lexical.rrf([lexical.bm25_topk(docs, items), lexical.overlap_topk(docs, items)], k=15, weights=[1.0, 1.2])


@query(f"""WITH {_BM25}, ov AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM terms JOIN (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM words) USING (term) GROUP BY query_id, doc_id QUALIFY rank <= 10)
SELECT query_id, doc_id, lane, rank FROM (SELECT query_id, doc_id, 0 AS lane, rank FROM bm UNION ALL SELECT query_id, doc_id, 1, rank FROM ov)
QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY lane, rank) = 1""")
def lane_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    return lexical.lanes([lexical.bm25_topk(docs, items), lexical.overlap_topk(docs, items)])


@query(f"""WITH {_BM25} SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (
  SELECT bm.*, source FROM bm JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2)""")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two results of a query have the same source. The cap is the feature; overviews have no counterpart in the tables."""
    docs = read(spark, sf_dir, "documents")
    ranked = lexical.bm25_topk(docs, asked(spark, sf_dir)).join(docs.select("doc_id", "source"), "doc_id")
    own, all_of = Window.partitionBy("query_id", "source").orderBy("rank"), Window.partitionBy("query_id").orderBy("rank")
    kept = ranked.withColumn("nth", F.row_number().over(own)).where("nth <= 2")
    return kept.select("query_id", "doc_id", "source", "score", F.row_number().over(all_of).cast("long").alias("place"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (1, 2, 3))
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0) q JOIN e ON e.vec_id <> q.vec_id QUALIFY rank <= 10""")
def vector_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return vectors.cosine_topk(v.where(F.col("label").isin(1, 2, 3)), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


_MASS = ",\n".join(
    f"m{i + 1} AS (SELECT node, sum(mass) AS mass FROM (SELECT b AS node, 0.85::DOUBLE * mass / degree AS mass FROM m{i} JOIN o ON node = a "
    f"UNION ALL SELECT node, (1 - 0.85::DOUBLE) * mass FROM m0) GROUP BY node)"
    for i in range(graph.ITERATIONS)
)


@query(f"""WITH e AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), o AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS degree FROM d),
m0 AS (SELECT 'n' || n_nationkey AS node, 1.0::DOUBLE / count(*) OVER () AS mass FROM nation WHERE n_regionkey = 1),
{_MASS}
SELECT node, round(mass, 9) AS mass FROM m{graph.ITERATIONS}""")
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    def name(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    nations = read(spark, sf_dir, "nation")
    edges = read(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("a"), name("s", "s_suppkey").alias("b"))
    edges = edges.unionByName(nations.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")))
    return graph.personalized_pagerank(edges, nations.where("n_regionkey = 1").select(name("n", "n_nationkey").alias("node")))


@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n+')) AS part, generate_subscripts(string_split_regex(coalesce(text, ''), '\\n+'), 1) - 1 AS ordinal FROM documents)
SELECT doc_id, ordinal, length(part) AS n_chars, sha256(part) AS part_sha256 FROM p WHERE part <> ''""")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n+")).alias("ordinal", "part"))
    return parts.where("part <> ''").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.char_length("part").cast("long").alias("n_chars"), F.sha2(F.col("part").cast("binary"), 256).alias("part_sha256"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') AS title,
  len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '(?i)<table[ >]')) AS tables FROM pages""")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tags(pattern: str):
        return F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("long")

    title = F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), tags("(?i)<p[ >]").alias("paragraphs"), tags("(?i)<table[ >]").alias("tables"))


@query("""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{2,6}[ -][0-9]{1,6}'))) AS cited FROM documents)
SELECT doc_id, 'cite:' || lower(replace(cited, ' ', '-')) AS node, count(*) AS n FROM c GROUP BY ALL""")
def cites_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from documents to what they cite: a series in capitals and a number; spellings of one citation are counted."""
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,6}[ -][0-9]{1,6}"), F.lit(0)))
    edges = read(spark, sf_dir, "documents").select("doc_id", F.explode(cited).alias("cited"))
    return edges.groupBy("doc_id", F.concat(F.lit("cite:"), F.lower(F.replace("cited", F.lit(" "), F.lit("-")))).alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, p_type, count(*) AS members, arg_max(p_partkey, (p_size, p_retailprice, -p_partkey)) AS best
FROM part GROUP BY p_brand, p_type HAVING count(*) >= 2""")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey")))
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("members"), best.alias("best")).where("members >= 2")


@query("""WITH r AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders)
SELECT r.o_orderkey, superseded_by, s.o_totalprice AS successor_price FROM r LEFT JOIN orders s ON s.o_orderkey = superseded_by""")
def family_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    one = tables.active_editions(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "superseded_by")
    return one.join(orders.select(F.col("o_orderkey").alias("superseded_by"), F.col("o_totalprice").alias("successor_price")), "superseded_by", "left")


@query("""WITH c AS (SELECT 'discount' AS rule, l_discount <= 0.08 AS ok FROM lineitem UNION ALL
  SELECT 'charge', l_extendedprice * (1 - l_discount) >= 1000 FROM lineitem UNION ALL SELECT 'returned', l_returnflag <> 'R' OR l_linestatus = 'F' FROM lineitem)
SELECT rule, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unknown FROM c GROUP BY rule""")
def verdict_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "discount": F.col("l_discount") <= 0.08, "charge": F.col("l_extendedprice") * (1 - F.col("l_discount")) >= 1000,
        "returned": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"),
    }
    return tables.verdicts(read(spark, sf_dir, "lineitem"), checks)


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_id, round(sum(value) OVER w, 4) AS spent, round(sum(value) OVER w, 4) <= 100 AS allowed
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "ts", "value")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("spent", F.round(F.sum("value").over(w), 4)).select("user_id", "day", "event_id", "spent", (F.col("spent") <= 100).alias("allowed"))


@query("""WITH m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events)
SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(ts AS DATE) >= last - 10 AS kept FROM events, m GROUP BY ALL""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = days.agg(F.max("day").alias("last"))  # one row
    return days.join(F.broadcast(last)).select("day", "n", (F.col("day") >= F.date_sub("last", 10)).alias("kept"))


@query("""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, apart by over 30 minutes; ours, the reference has only daily windows."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(order) + F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    e = read(spark, sf_dir, "events").withColumn("fresh", fresh)
    e = e.withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count(F.lit(1)).alias("n")).drop("session")
