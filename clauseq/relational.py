"""Joins, aggregates, windows, sorts and set operations of the reference, over the driver's tables, with their SQL.

Registry data stand for it: orders are editions of a customer's family, line items
its clauses, events the telemetry, conversations the messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseq.catalogue import SQL, query, read
from clauseq.operators import registry
from clauseq.plans import versions
from clauseq.sources import html, htmltree


@query("""SELECT n_name, c_custkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) OR n_name LIKE '%AN%'""")
def join_defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges joined to the nodes whose label is one of a set or has a fragment."""
    nation, edges = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    named = nation.where("n_regionkey = 1 OR n_name LIKE '%AN%'").select("n_nationkey", "n_name")
    return edges.join(named, "n_nationkey").select("n_name", "c_custkey", "c_name")


@query("""SELECT DISTINCT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0""")
def join_edges_documents_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n, r = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), read(spark, sf_dir, "region")
    return c.join(n, "n_nationkey").join(r, "r_regionkey").select("c_custkey", "n_name", "r_name").distinct()


@query("""SELECT c_custkey, count(o_orderkey) AS messages, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its number of messages, 0 kept; messages are counted before the join."""
    sums = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("last_at"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("messages"), "last_at")


@query("""SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS i
FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE i = 1""")
def left_join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with its latest row, ties by the greatest key; nodes without a row stay."""
    latest = registry.latest(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return read(spark, sf_dir, "customer").select("c_custkey").join(latest.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND l_returnflag = 'R'""")
def join_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of the messages that belong to one owner."""
    c = read(spark, sf_dir, "customer")
    own = c.join(F.broadcast(c.agg(F.min("c_mktsegment").alias("c_mktsegment"))), "c_mktsegment", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate").join(own, "o_custkey", "left_semi")
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderdate")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))""")
def semi_join_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    c = read(spark, sf_dir, "customer").join(n, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines,
  (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS n_returned FROM supplier
WHERE s_nationkey = (SELECT s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 1)""")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of the first match, and two counts for each of its members, made in one grouping."""
    s = read(spark, sf_dir, "supplier")
    first = s.agg(F.min_by("s_nationkey", "s_suppkey").alias("s_nationkey"))
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    out = s.join(F.broadcast(first), "s_nationkey", "left_semi").join(counts, "s_suppkey", "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("r", F.lit(0)).alias("n_returned"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have no context yet."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY vec_id")
def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the index without a current chunk, sorted: what a reconciliation reports and deletes."""
    current = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return registry.stale(read(spark, sf_dir, "embeddings").select("vec_id"), current, "vec_id").orderBy("vec_id")


@query("""SELECT d.doc_id, md5(CASE WHEN l.doc_id IS NULL THEN '' ELSE 'quality ' || l.quality || ' ' END || coalesce(d.text, '')) AS preambled
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def context_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with its context before it, where there is one."""
    ctx = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.concat(F.lit("quality "), F.min("quality").cast("string")).alias("ctx"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(ctx, "doc_id", "left")
    return d.select("doc_id", F.md5(F.concat_ws(" ", "ctx", F.coalesce("text", F.lit(""))).cast("binary")).alias("preambled"))


@query("""WITH u AS (SELECT doc_id AS id, 'labels' AS lane, 2 AS k FROM labels UNION ALL SELECT doc_id, 'documents', 1 FROM documents UNION ALL SELECT item_id, 'benchmark', 3 FROM benchmark),
c AS (SELECT id, arg_max(lane, k) AS lane FROM u GROUP BY id) SELECT e.vec_id, c.lane FROM embeddings e JOIN c ON c.id = e.vec_id""")
def vectors_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical sources united, the last with an id wins; vectors take their chunk by id."""
    lanes = [("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id")]
    sources = [read(spark, sf_dir, t).select(F.col(c).alias("vec_id"), F.lit(t).alias("lane")) for t, c in lanes]
    return read(spark, sf_dir, "embeddings").select("vec_id").join(registry.last_wins(sources, "vec_id"), "vec_id")


@query("""SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY ALL) p
ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def children_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with its parent in the same document."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parents = c.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("role").alias("parent_role"))
    return c.select("conv_id", "turn").join(parents, ["conv_id", "turn"], "left")


@query("""WITH b(kind, si, tol) AS (VALUES ('low', 5.0, 4.0), ('mid', 25.0, 6.0), ('high', 45.0, 5.0))
SELECT l_orderkey, l_linenumber, kind, CAST(round(abs(l_quantity - si), 4) AS DOUBLE) AS gap FROM lineitem JOIN b ON abs(l_quantity - si) <= tol""")
def band_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = [("low", 5.0, 4.0), ("mid", 25.0, 6.0), ("high", 45.0, 5.0)]
    return registry.bands(read(spark, sf_dir, "lineitem"), "l_quantity", bands).select("l_orderkey", "l_linenumber", "kind", F.round("gap", 4).alias("gap"))


_ANCHOR = "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 3 + 1 AS VARCHAR) || '.' || CAST(l_partkey % 3 + 1 AS VARCHAR) ELSE CAST(l_suppkey % 3 + 1 AS VARCHAR) END"


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, sub = (F.col("l_suppkey") % 3 + 1).cast("string"), (F.col("l_partkey") % 3 + 1).cast("string")
    anchor = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(".", top, sub)).otherwise(top)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), anchor.alias("anchor"), F.col("l_quantity").alias("score"))


@query(f"""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS pos, {_ANCHOR} AS anchor FROM lineitem)
SELECT a.doc, a.pos AS ancestor, d.pos AS descendant FROM c a JOIN c d ON a.doc = d.doc AND starts_with(d.anchor, a.anchor || '.')""")
def ancestor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clauses of a document, one's anchor a proper prefix of the other's."""
    return registry.ancestors(clauses(spark, sf_dir), ["doc"]).select("doc", F.col("ancestor.pos").alias("ancestor"), F.col("descendant.pos").alias("descendant"))


@query("""WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, o_orderstatus = 'O' AS act FROM orders), q AS (SELECT c_custkey, 1992 + c_custkey % 7 AS want FROM customer)
SELECT c_custkey, want, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY (y = want) DESC, act DESC, y DESC, o_orderkey DESC) AS i FROM q JOIN a ON o_custkey = c_custkey) WHERE i = 1""")
def edition_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition that a citation means: the one of its year, else an active one, else the newest."""
    q = read(spark, sf_dir, "customer").select("c_custkey", (1992 + F.col("c_custkey") % 7).alias("want"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("edition"), "o_orderkey", (F.col("o_orderstatus") == "O").alias("active"))
    return registry.edition_of(q, o, ["c_custkey"], "want", "o_orderkey").select("c_custkey", "want", "o_orderkey")


@query("""WITH s AS (SELECT o_custkey || ':' || year(o_orderdate) AS ident, min(o_orderstatus) AS st FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
f AS (SELECT CAST(o_custkey AS VARCHAR) AS ident, min(o_orderstatus) AS st FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL)
SELECT o_orderkey, coalesce(s.st, f.st, 'unknown') AS status FROM orders LEFT JOIN s ON s.ident = o_custkey || ':' || year(o_orderdate) LEFT JOIN f ON f.ident = CAST(o_custkey AS VARCHAR)""")
def status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by identifier and edition, else by identifier, else unknown."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("ident"), F.concat_ws(":", "o_custkey", F.year("o_orderdate")).alias("dated"))
    exact = o.where("o_orderkey % 3 = 0").select(F.col("dated").alias("ident"), "o_orderstatus")
    plain = o.where("o_orderkey % 5 = 0").select("ident", "o_orderstatus")
    known = exact.unionByName(plain).groupBy("ident").agg(F.min("o_orderstatus").alias("status"))
    return registry.cascade(o.select("o_orderkey", "dated", "ident"), known, ["dated", "ident"], "status", "unknown").select("o_orderkey", "status")


@query("""SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag = b.l_returnflag""")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a, b = x.withColumnRenamed("l_linenumber", "i"), x.withColumnRenamed("l_linenumber", "j")
    return a.join(b, ["l_orderkey", "l_returnflag"]).where("i < j").select("l_orderkey", "i", "j")


@query("""SELECT event_type AS model, round(sum(value), 4) AS requests FROM events GROUP BY event_type ORDER BY requests DESC, model""")
def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.sum("value"), 4).alias("requests")).orderBy(F.desc("requests"), "model")


@query("SELECT quality AS rating, count(*) AS n FROM labels GROUP BY quality")
def count_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").groupBy(F.col("quality").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(CASE WHEN event_type IN ('view', 'click') THEN event_type END, 'miss') AS cache, count(*) AS n FROM events GROUP BY ALL")
def cache_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = F.coalesce(F.when(F.col("event_type").isin("view", "click"), F.col("event_type")), F.lit("miss"))
    return read(spark, sf_dir, "events").groupBy(cache.alias("cache")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, sum(CASE WHEN value > 50 THEN CAST(floor(value / 50) AS BIGINT) ELSE 0 END) AS retries, count(*) FILTER (value > 50) AS retried FROM events GROUP BY event_type""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = F.when(F.col("value") > 50, F.floor(F.col("value") / 50)).otherwise(0)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(tries).alias("retries"), F.count_if(F.col("value") > 50).alias("retried"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events
WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7 GROUP BY ALL ORDER BY user_id, day DESC""")
def usage_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by key and day over the seven days up to the newest event."""
    e = registry.since(read(spark, sf_dir, "events"), "ts", 7)
    out = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    return out.orderBy("user_id", F.desc("day"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS tier, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7 GROUP BY ALL""")
def report_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = registry.since(read(spark, sf_dir, "events"), "ts", 7)
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT source, count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def quota_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


@query("""SELECT coalesce(lang, '?') AS language, coalesce(source, '?') AS doctype, count(*) AS n FROM documents GROUP BY ALL""")
def report_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = [F.coalesce(F.col(c), F.lit("?")).alias(a) for c, a in (("lang", "language"), ("source", "doctype"))]
    return read(spark, sf_dir, "documents").groupBy(*of).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, count(*) AS chunks, sha256(string_agg(h, '' ORDER BY h)) AS manifest FROM (SELECT conv_id, sha256(coalesce(text, '')) AS h FROM conversations) GROUP BY conv_id""")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document and the hash of their hashes in order: equal iff the chunks are, whatever their order."""
    return registry.manifest(read(spark, sf_dir, "conversations"), "conv_id", "text")


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
SELECT conv_id, count(*) AS n, string_agg(substr(text, 1, 30), ' | ' ORDER BY i) AS excerpts FROM t WHERE i <= 12 GROUP BY conv_id HAVING count(*) >= 2""")
def section_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two units or more: their first 12 in order, an excerpt of each."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("i", F.row_number().over(w)).where("i <= 12")
    got = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("i", F.substring("text", 1, 30).alias("x")))).alias("xs"))
    return got.where("n >= 2").select("conv_id", "n", F.array_join("xs.x", " | ").alias("excerpts"))


@query("SELECT count(DISTINCT lower(trim(p_brand))) AS classes, count(DISTINCT lower(trim(p_type))) AS types, min(p_size) AS lo, max(p_size) AS hi FROM part")
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.count_distinct(F.lower(F.trim(c)))
    return read(spark, sf_dir, "part").agg(of("p_brand").alias("classes"), of("p_type").alias("types"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("""WITH d AS (SELECT o_custkey, o_orderpriority AS label, min(o_orderdate) AS first_at, max(o_orderstatus = 'O') AS active FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY active DESC, first_at, label) AS i FROM d)
SELECT o_custkey, string_agg(label, '; ' ORDER BY i) AS note FROM r WHERE i <= 3 GROUP BY o_custkey""")
def citation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the distinct labels that cite it, active ones first, at most so many."""
    d = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.min("o_orderdate").alias("first_at"), F.max(F.col("o_orderstatus") == "O").alias("active"))
    return registry.notes(d, "o_custkey", "label", [F.desc("active"), F.col("first_at"), F.col("label")], 3)


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations),
f AS (SELECT *, used <= 600 AS fits FROM t)
SELECT conv_id, count(*) FILTER (fits) AS kept, bool_or(NOT fits) AS truncated, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (fits), '')) AS body FROM f GROUP BY conv_id""")
def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text in reading order up to the first unit that would overflow the cap."""
    return registry.assemble(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "text"], "text", 600)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), k AS (SELECT e.* FROM e WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND b IN (SELECT p_partkey FROM part WHERE p_size < 25))
SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) + (SELECT count(*) FROM part WHERE p_size < 25) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM k) AS kept""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, distinct edges, and edges with both ends among the nodes."""
    a = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    b = read(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes, kept = a.unionByName(b), registry.both_ends(e, a.unionByName(b))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(nodes, "nodes").join(count(e, "edges")).join(count(kept, "kept"))


@query("""SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) WHEN 0 THEN 'verified' WHEN 1 THEN 'curated' ELSE 'ocr' END AS quality FROM lineitem GROUP BY l_orderkey""")
def worst_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of an answer: the worst of its passages."""
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.element_at(F.array(*map(F.lit, ("verified", "curated", "ocr"))), F.max(rank) + 1).alias("quality"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("""SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) OVER w - min(l_quantity) OVER w AS DOUBLE) AS spread FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.max("l_quantity").over(w) - F.min("l_quantity").over(w)).alias("spread"))


@query("""SELECT o_orderkey, max(year(o_orderdate)) OVER (PARTITION BY o_custkey, o_orderpriority) AS newest, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS family_newest FROM orders""")
def newest_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.max(F.year("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", year.over(Window.partitionBy("o_custkey", "o_orderpriority")).alias("newest"), year.over(Window.partitionBy("o_custkey")).alias("family_newest"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY best) AS place FROM (SELECT *, min(pos) OVER (PARTITION BY l_orderkey, doc) AS best FROM p)""")
def groups_by_best_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("doc"), "l_quantity", "l_partkey", "l_extendedprice")
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_extendedprice")))
    p = p.withColumn("best", F.min("pos").over(Window.partitionBy("l_orderkey", "doc")))
    return p.select("l_orderkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("best")).alias("place"))


@query("SELECT source, lang, min(doc_id) AS first_id FROM documents GROUP BY source, lang")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.first_wins(read(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"]).select("source", "lang", F.col("doc_id").alias("first_id"))


@query("""SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, year(o_orderdate) DESC, o_orderkey) AS place
FROM orders ORDER BY place LIMIT 100""")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by status, price and year; the key is the last one, so the order is total."""
    o = read(spark, sf_dir, "orders").withColumn("status_rank", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2))
    by = ["status_rank", F.desc("o_totalprice"), F.desc(F.year("o_orderdate")), "o_orderkey"]
    return o.orderBy(*by).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*by))).select("o_orderkey", "o_orderstatus", "place")


@query("""SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey) AS place FROM part""")
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing by family, part and edition."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", "p_size", "p_partkey")).alias("place"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 3 <> 0 THEN turn END, length(text)) NULLS LAST, turn, text) AS place FROM conversations""")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by their ordinal, else by another number of theirs."""
    key = F.coalesce(F.when(F.col("turn") % 3 != 0, F.col("turn")), F.char_length("text").cast("long"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(key.asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("text").asc_nulls_last())).alias("place"))


@query("""WITH t AS (SELECT p_partkey, p_name, string_split(lower(p_name), ' ') AS w FROM part)
SELECT p_partkey, CAST(2 * list_contains(w, 'red')::INT + 3 * regexp_matches(p_name, '(^|[^0-9])1(0|5)([^0-9]|$)')::INT + starts_with(lower(p_name), 'b')::INT AS BIGINT) AS points FROM t""")
def register_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a register row for the tokens of a question: 2 for the model, 3 for a number as a word, 1 for the holder."""
    name, one = F.col("p_name"), lambda c, n: F.when(c, n).otherwise(0)
    points = one(F.array_contains(F.split(F.lower(name), " "), "red"), 2) + one(name.rlike("(^|[^0-9])1(0|5)([^0-9]|$)"), 3) + one(F.lower(name).startswith("b"), 1)
    return read(spark, sf_dir, "part").select("p_partkey", points.cast("long").alias("points"))


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS ts FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(ts, lambda x: x IN ('view', 'click', 'admin')), ',') AS allowed, array_to_string(list_filter(ts, lambda x: x NOT IN ('view', 'click', 'admin')), ',') AS refused,
round(len(list_filter(ts, lambda x: x IN ('view', 'click', 'admin'))) / (len(ts) + 3.0 - len(list_filter(ts, lambda x: x IN ('view', 'click', 'admin')))), 6)::DOUBLE AS overlap FROM s""")
def scope_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for and permitted, what is asked for and not, and the Jaccard overlap of both sets."""
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("ts"))
    mine = F.array(*map(F.lit, ("view", "click", "admin")))
    both = F.array_intersect("ts", mine)
    return s.select("user_id", F.array_join(both, ",").alias("allowed"), F.array_join(F.array_except("ts", mine), ",").alias("refused"), F.round(F.size(both) / F.size(F.array_union("ts", mine)), 6).alias("overlap"))


@query("SELECT count(*) AS edges FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)")
def distinct_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").dropDuplicates().agg(F.count(F.lit(1)).alias("edges"))


@query("""WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END, '')) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run embeds again: new and changed ids; and what it deletes."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return registry.diff(d.where("doc_id % 3 <> 0"), new, "doc_id", "text")


_HALVES = "a AS (SELECT DISTINCT l_orderkey % 500 AS k, l_partkey % 20 AS v FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_orderkey % 700 AS k, l_partkey % 20 AS v FROM lineitem WHERE l_linenumber = 2), "


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = lambda n, m: read(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select((F.col("l_orderkey") % m).alias("k"), (F.col("l_partkey") % 20).alias("v"))
    return line(1, 500).groupBy("k").agg(F.max("v").alias("v")), line(2, 700)


@query(f"WITH {_HALVES} n AS (SELECT k, max(v) AS v FROM b GROUP BY k), o AS (SELECT k, max(v) AS v FROM a GROUP BY k) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a key that is there take its row's place."""
    return versions.upsert(*_halves(spark, sf_dir), ["k"])


@query(f"WITH {_HALVES} n AS (SELECT k, max(v) AS v FROM b GROUP BY k), o AS (SELECT k, max(v) AS v FROM a GROUP BY k) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def sink_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.insert_absent(*_halves(spark, sf_dir), ["k"])


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY ALL""")
def sink_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of two batches of events, added up."""
    counts = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("requests"))
    a, b = (counts.where(F.col("half") == h).drop("half") for h in (0, 1))
    return versions.increment(a, b, ["event_type", "day"], "requests")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def sink_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.delete(read(spark, sf_dir, "labels").select("doc_id", "quality"), read(spark, sf_dir, "documents").where("lang = 'fr'"), ["doc_id"])


_REGISTER_STOP = ", ".join(f"'{w}'" for w in registry.REGISTER_STOP)


@query(f"""WITH q AS (SELECT n_nationkey AS query_id, 'What is the status of ' || ['red', 'SMALL', 'blue', 'steel'][n_nationkey % 4 + 1] || ' bolt model ' || CAST(n_nationkey * 7 AS VARCHAR) || ' of Brand#' || CAST(n_nationkey AS VARCHAR) || '?' AS text FROM nation),
t AS (SELECT query_id, list_filter(string_split_regex(text, '[^A-Za-z0-9&-]+'), lambda w: length(w) >= 2 AND lower(w) NOT IN ({_REGISTER_STOP})) AS ts FROM q),
d AS (SELECT query_id, list_transform(list_filter(ts, lambda x, i: list_position(ts, x) = i)[1:12], lambda x: lower(x)) AS ts FROM t),
r AS (SELECT p_partkey AS num, CAST(p_partkey AS VARCHAR) AS n, lower(p_brand) AS holder, lower(p_name) || '-' || p_partkey % 100 || ' ' || lower(p_type) AS model, p_size AS year FROM part),
m AS (SELECT query_id, num, year, len(list_filter(ts, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN model = x OR n = x OR contains(' ' || regexp_replace(model, '[-,.]', ' ', 'g') || ' ', ' ' || x || ' ') ELSE contains(holder, x) OR contains(model, x) OR contains(n, x) END)) AS hits,
  list_sum(list_transform(ts, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') AND contains(' ' || regexp_replace(model, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || x || ' ') THEN 3 WHEN NOT regexp_full_match(x, '[0-9]+') AND contains(model, x) THEN 2 WHEN contains(holder, x) THEN 1 ELSE 0 END)) AS score FROM d, r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year DESC, num) AS INTEGER) AS place, num, CAST(score AS INTEGER) AS score FROM m WHERE hits > 0 QUALIFY place <= 6""")
def register_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each nation over all parts."""
    key = F.col("n_nationkey")
    word = F.get(F.array(*map(F.lit, ("red", "SMALL", "blue", "steel"))), key % 4)
    text = F.concat(F.lit("What is the status of "), word, F.lit(" bolt model "), key * 7, F.lit(" of Brand#"), key, F.lit("?"))
    model = F.concat("p_name", F.lit("-"), F.col("p_partkey") % 100, F.lit(" "), "p_type")
    register = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("num"), F.col("p_brand").alias("holder"), model.alias("model"), F.col("p_size").alias("year"))
    return registry.register_search(read(spark, sf_dir, "nation").select(key.alias("query_id"), text.alias("text")), register)


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a page with a table, with a thead, a first row of th or no header."""
    line = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint")).withColumnRenamed("l_orderkey", "o_orderkey")
    cell = lambda *c: F.concat(F.lit("<td class=x> "), *c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("l_linenumber")), cell(F.col("q"), F.lit(" &lt; <b>"), F.col("l_partkey"), F.lit("</b>")), F.lit("<td></td></tr>\n"))
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "l_linestatus", row.alias("row"))))
    kind = F.col("o_orderkey") % 3
    head = F.lit("<tr><th>Line</th><th>Parts</th></tr>")
    head = F.when(kind == 0, F.concat(F.lit("<THEAD >"), head, F.lit("</THEAD>"))).when(kind == 1, head).otherwise("")
    title = F.concat(F.lit("<script>var t='<table >';</script><h2 id=a>"), F.col("o_orderkey") % 9 + 1, F.lit(" Order</h2><p>Text<table>"))
    page = F.concat(title, F.when(kind == 2, "").otherwise("<caption>Lines &amp;  more</caption>"), head, F.array_join("x.row", ""), F.lit("</table>"))
    return line.groupBy("o_orderkey").agg(by.alias("x")).select("o_orderkey", page.alias("html"))


def _embedded(t: DataFrame) -> DataFrame:
    t = t.withColumn("embedded", html.embed_text(F.col("caption"), F.concat(F.lit("O"), "o_orderkey"), F.col("columns"), F.col("rows")))
    return t.select("o_orderkey", "anchor", "caption", F.array_join("columns", ";").alias("columns"), F.size("rows").alias("n_rows"), "guessed", "embedded")


@query("""WITH r AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
t AS (SELECT o_orderkey, list({'a': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'q': q, 'l': l_linestatus} ORDER BY l_linenumber, l_partkey, l_suppkey, q, l_linestatus) AS rs FROM r GROUP BY o_orderkey),
e AS (SELECT o_orderkey, rs, o_orderkey % 3 AS kind FROM t)
SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS VARCHAR) AS anchor, CASE kind WHEN 2 THEN '' ELSE 'Lines & more' END AS caption, CASE kind WHEN 2 THEN 'Column 1;Column 2' ELSE 'Line;Parts' END AS columns, CAST(len(rs) AS INTEGER) AS n_rows, kind = 2 AS guessed,
 CASE kind WHEN 2 THEN 'Table. ' ELSE 'Lines & more. ' END || 'Source: O' || o_orderkey || '. Columns: ' || CASE kind WHEN 2 THEN 'Column 1; Column 2' ELSE 'Line; Parts' END || '.' ||
 array_to_string(list_transform(rs, lambda x: chr(10) || 'Row: ' || CASE kind WHEN 2 THEN 'Column 1' ELSE 'Line' END || ' = ' || x.a || '; ' || CASE kind WHEN 2 THEN 'Column 2' ELSE 'Parts' END || ' = ' || x.q || ' < ' || x.p || '.'), '') AS embedded FROM e""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' tables, read back by patterns."""
    return _embedded(html.tables(order_pages(spark, sf_dir), "o_orderkey", "html"))


@query(SQL["html_tables"])
def html_tree_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, read back by the parser with a stack."""
    return _embedded(htmltree.tables(order_pages(spark, sf_dir), "o_orderkey", "html"))


_UNESCAPED = "x"
for _name, _sign in html.ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(f"""WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{html.HIDDEN}', ' ', 'g'), '{html.BLOCK}') AS bs FROM pages),
c AS (SELECT page_id, list_filter(list_transform(list_transform(bs, lambda b: {{'b': b, 'x': regexp_replace(b, '<[^>]*>', ' ', 'g')}}), lambda s: CASE WHEN regexp_matches(s.b, '(?i)^<li') THEN '- ' ELSE '' END || trim(regexp_replace({_UNESCAPED.replace('(x', '(s.x')}, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x NOT IN ('', '- ')) AS xs FROM b)
SELECT page_id, 0 AS pos, '' AS title, array_to_string(xs, chr(10)) AS body FROM c WHERE len(xs) > 0""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' text by paragraphs and items; the given pages have no heading of level 2 to 5 and no table."""
    return html.sections(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "pos", "title", "body")
