"""Registered queries of the lanes that fill a pool, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.catalogue import asked, query, read
from clauseq.fulltext import _ranked_sql
from clauseq.operators import lanes, stages, vectors
from clauseq.operators.textindex import TextIndex
from clauseq.plans.folders import new_folder

_SCOPES = """CASE query_id // 50 % 7 WHEN 1 THEN CAST(own AS VARCHAR) WHEN 2 THEN '99' WHEN 3 THEN CAST(own AS VARCHAR) WHEN 4 THEN '7' WHEN 5 THEN own || '-1' WHEN 6 THEN CAST((own + 1) % 5 AS VARCHAR) END"""
_PINS = "CASE query_id // 50 % 7 WHEN 3 THEN '1800' WHEN 5 THEN '1991' WHEN 6 THEN '1992' END"
_NEAREST = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
h AS (SELECT q.vec_id AS query_id, q.label % 5 AS own, e.vec_id AS id, e.vec_id, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 100)"""


@query(f"""WITH {_NEAREST},
m AS (SELECT query_id, id, score, rank, CASE WHEN vec_id % 97 = 5 THEN '7' ELSE CAST(label % 5 AS VARCHAR) END AS number, label % 5 || '-' || vec_id % 3 AS part,
  CASE WHEN vec_id % 11 = 0 THEN '' ELSE CAST(1990 + vec_id % 4 AS VARCHAR) END AS edition, {_SCOPES} AS scope, {_PINS} AS pin FROM h),
a AS (SELECT *, scope IS NOT NULL AND (number = scope OR (contains(scope, '-') AND number = split_part(scope, '-', 1) AND part = scope)) AS ours FROM m),
b AS (SELECT *, ours AND rank <= 50 AND (pin IS NULL OR edition = '' OR edition = pin) AS fits FROM a),
c AS (SELECT *, count(*) FILTER (fits) OVER w AS n, count(*) FILTER (ours) OVER w AS deep, count(*) FILTER (ours AND rank <= 50) OVER w AS doc FROM b WINDOW w AS (PARTITION BY query_id)),
d AS (SELECT *, CASE WHEN scope IS NULL THEN 'plain' WHEN pin IS NOT NULL AND CASE WHEN n > 0 THEN n ELSE deep END < 3 AND doc > CASE WHEN n > 0 THEN n ELSE deep END THEN 'dropped' WHEN n = 0 THEN 'deep' ELSE 'scoped' END AS way FROM c),
o AS (SELECT *, CASE way WHEN 'plain' THEN rank <= 50 WHEN 'dropped' THEN ours AND rank <= 50 WHEN 'deep' THEN ours ELSE fits END AS own FROM d),
k AS (SELECT *, count(*) FILTER (own) OVER (PARTITION BY query_id) AS kept FROM o)
SELECT query_id, id, score, way, way = 'dropped' AS edition_dropped, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, rank) AS pos FROM k WHERE own OR (way <> 'plain' AND kept < 10 AND rank <= 50)""")
def dense_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with and without a scope and a pin, so that each way of the dense lane is taken."""
    v = read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", (F.col("label") % 5).alias("own"))
    vec = F.col("vec_id")
    meta = v.select(
        vec, vec.alias("id"), F.when(vec % 97 == 5, "7").otherwise((F.col("label") % 5).cast("string")).alias("number"),
        F.concat(F.lit("Std R "), F.col("label") % 5, F.lit("-"), vec % 3, F.lit(":2001 (E)")).alias("identifier"),
        F.when(vec % 11 == 0, "").otherwise((1990 + vec % 4).cast("string")).alias("edition"),
    )
    hits = vectors.cosine_topk(v, q.select("query_id", "embedding"), lanes.DEEP).join(meta, "vec_id").drop("vec_id")
    case, own = F.expr("query_id div 50") % 7, F.col("own").cast("string")
    scope = F.when(case.isin(1, 3), own).when(case == 2, "99").when(case == 4, "7").when(case == 5, F.concat(own, F.lit("-1"))).when(case == 6, ((F.col("own") + 1) % 5).cast("string"))
    pin = F.when(case == 3, "1800").when(case == 5, "1991").when(case == 6, "1992")
    return lanes.dense(hits, q.select("query_id", scope.alias("scope"), pin.alias("pin"))).select("query_id", "id", "score", "way", "edition_dropped", "pos")


@query(f"""WITH {_NEAREST}, p AS (SELECT p_partkey, p_name, p_type, p_brand FROM part),
g AS (SELECT query_id, rank, (1 + score) / 2 AS cosine, round(score - 0.2 + (vec_id % 5) / 10.0, 6) AS score, trim(p_name) AS term, substr(p_type || ' — ' || p_brand, 1, 300) AS definition FROM h JOIN p ON p_partkey = vec_id % 200 WHERE rank <= 5 AND (1 + score) / 2 >= 0.5),
u AS (SELECT * FROM g WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(term), '[^a-z0-9 ]', '', 'g')) ORDER BY rank) = 1)
SELECT query_id, term, definition, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS place FROM u QUALIFY place <= 3""")
def glossary_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts of a query's nearest glossary entries, one for each spelling; likeness is the cosine moved to 0 to 1."""
    v = read(spark, sf_dir, "embeddings")
    near = vectors.cosine_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), lanes.GLOSSARY)
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" — ", "p_name", "p_type", "p_brand").alias("text"))
    rows = near.join(part, F.col("vec_id") % 200 == F.col("p_partkey"))
    return lanes.glossary(rows.select("query_id", "rank", ((1 + F.col("score")) / 2).alias("cosine"), F.round(F.col("score") - 0.2 + (F.col("vec_id") % 5) / 10.0, 6).alias("score"), "title", "text"))


@query("""WITH t AS (SELECT n_nationkey AS query_id, unnest(['BRAND#' || n_nationkey % 9, ['red', 'blue', 'st'][n_regionkey % 3 + 1]]) AS term FROM nation),
d AS (SELECT DISTINCT query_id, term, 's' || l_suppkey AS doc FROM t JOIN part ON length(term) >= 3 AND contains(lower(p_name || ' ' || p_brand), lower(term)) JOIN lineitem ON l_partkey = p_partkey)
SELECT DISTINCT query_id, doc FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY doc) <= 12)""")
def concept_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers that define the concepts of a nation's terms."""
    n = read(spark, sf_dir, "nation")
    second = F.get(F.array(F.lit("red"), F.lit("blue"), F.lit("st")), F.col("n_regionkey") % 3)
    terms = n.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array(F.concat(F.lit("BRAND#"), F.col("n_nationkey") % 9), second)).alias("term"))
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("concept").alias("kind"), F.concat_ws(" ", "p_name", "p_brand").alias("label"))
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("defines").alias("kind"))
    return lanes.concept_documents(terms, edges, nodes)


_LINKED = _ranked_sql("d", 10).rsplit("SELECT query_id, doc_id, bm25", 1)[0].rstrip()


@query(f"""WITH d AS (SELECT doc_id, text FROM documents), {_LINKED},
p AS (SELECT query_id, doc_id AS id, round(-bm25 / (1 - bm25), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS pos FROM hits QUALIFY pos <= 10),
s AS (SELECT DISTINCT item_id AS query_id, unnest(['src' || item_id % 7, 'src' || (item_id % 11 + 3)]) AS number FROM benchmark),
w AS (SELECT query_id, doc_id AS id, round(-bm25 / (1 - bm25), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS pos FROM hits JOIN documents USING (doc_id) JOIN s USING (query_id) WHERE source = number QUALIFY pos <= 5),
n AS (SELECT query_id, id, round(score * 0.375, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM w WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM p))
SELECT query_id, id, score, pos FROM p UNION ALL SELECT n.query_id, id, score, i + coalesce(last, 0) AS pos FROM n LEFT JOIN (SELECT query_id, max(pos) AS last FROM p GROUP BY 1) USING (query_id)""")
def linked_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each passage, and behind them those of its linked sources, ranked within these."""
    docs, passages = read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    index = TextIndex(spark, new_folder(spark, "index"))
    index.upsert(docs)
    item = F.col("query_id")
    sets = passages.select("query_id", F.explode(F.array(F.concat(F.lit("src"), item % 7), F.concat(F.lit("src"), item % 11 + 3))).alias("number"))
    flat = lambda h: h.select("query_id", F.col("doc_id").alias("id"), "score", F.col("rank").alias("pos"))
    near, within = index.search_both(passages, docs.select("doc_id", F.col("source").alias("number")), sets, 10)
    index.drop()
    got = stages.run_stages(flat(near), {"graph-lane": {"lane": flat(within)}})
    return got.withColumn("score", F.round("score", 6))


@query("""WITH u AS (SELECT DISTINCT p_brand AS standard, p_name || ' ' || p_size AS node_id FROM part), k AS (SELECT *, 'm' || left(sha1(standard || '|' || node_id), 16) AS id FROM u),
q AS (SELECT n_nationkey AS query_id, unnest(['Brand#' || n_nationkey % 25, 'Brand#' || n_regionkey]) AS standard FROM nation),
p AS (SELECT DISTINCT n_nationkey AS query_id, id FROM nation JOIN k ON ord(right(id, 1)) % 5 = n_regionkey AND ord(left(right(id, 2), 1)) % 16 = n_nationkey % 16),
pool AS (SELECT query_id, id, 9.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM p),
f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY standard, node_id) AS pos FROM (SELECT DISTINCT * FROM q) JOIN k USING (standard) QUALIFY pos <= 40),
n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM f WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM pool))
SELECT query_id, id, CAST(score AS DOUBLE) AS score, pos FROM pool UNION ALL SELECT query_id, id, 0.5, i + coalesce(last, 0) FROM n LEFT JOIN (SELECT query_id, max(pos) AS last FROM pool GROUP BY 1) USING (query_id)""")
def licensed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's pool, and behind it the units of the brands that it may read, looked up by id."""
    units = read(spark, sf_dir, "part").select(F.col("p_brand").alias("standard"), F.concat_ws(" ", "p_name", "p_size").alias("node_id")).distinct()
    stored = units.select(lanes.unit_key(F.col("standard"), F.col("node_id")).alias("id"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), "n_regionkey")
    entitled = n.select("query_id", F.explode(F.array(F.concat(F.lit("Brand#"), F.col("query_id") % 25), F.concat(F.lit("Brand#"), "n_regionkey"))).alias("standard"))
    last, before = F.ascii(F.right("id", F.lit(1))), F.ascii(F.left(F.right("id", F.lit(2)), F.lit(1)))
    pool = n.join(stored.distinct().withColumns({"a": last % 5, "b": before % 16}), (F.col("a") == F.col("n_regionkey")) & (F.col("b") == F.col("query_id") % 16))
    pool = stages.placed(pool.select("query_id", "id", F.lit(9.0).alias("score"), F.lit(0).alias("pos")), F.col("id"))
    return stages.run_stages(pool, {"licensed-lane": {"entitled": entitled, "units": units, "stored": stored}})
