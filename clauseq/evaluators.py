"""Evaluators, chunks and graph look-ups over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseq.catalogue import _MASS, query, read
from clauseq.operators import chunking, evaluate, graph

_SETS = {"mild": {"q": (10.0, 6.0), "d": (0.02, 0.02)}, "warm": {"q": (25.0, 10.0), "d": (0.05, 0.03)}, "hot": {"q": (45.0, 4.0), "d": (0.09, 0.01)}}
_FAR = {n: " + ".join(f"abs({c} - {si}::DOUBLE) / {max(t, 1.0)}::DOUBLE" for c, (si, t) in zip(("l_quantity", "l_discount"), e.values(), strict=True)) for n, e in _SETS.items()}
_IN = {n: " AND ".join(f"abs({c} - {si}::DOUBLE) <= {t}::DOUBLE" for c, (si, t) in zip(("l_quantity", "l_discount"), e.values(), strict=True)) for n, e in _SETS.items()}


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in _IN.items())} END AS passed,
 CASE least({', '.join(f'({f})' for f in _FAR.values())}) {' '.join(f"WHEN ({f}) THEN '{n}'" for n, f in _FAR.items())} END AS nearest FROM lineitem""")
def condition_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.condition_sets(read(spark, sf_dir, "lineitem"), {"q": "l_quantity", "d": "l_discount"}, _SETS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "passed", "nearest")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS t FROM lineitem),
c AS (SELECT *, 30 - (q - 2) * (1 + t - 0.01::DOUBLE) AS a, 30 - (q + 2) * (1 + t - 0.01::DOUBLE) AS b, 30 - (q - 2) * (1 + t + 0.01::DOUBLE) AS c, 30 - (q + 2) * (1 + t + 0.01::DOUBLE) AS d FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN round(least(a, b, c, d), 9) >= 0 THEN 'pass' WHEN round(greatest(a, b, c, d), 9) < 0 THEN 'fail' ELSE 'void' END AS verdict,
 round((30 - q * (1 + t)) / 4, 6) AS safety FROM c""")
def verdict_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check at every corner of its tolerances, and its margin over the width of the tolerance."""
    margin = lambda v: 30 - v["q"] * (1 + v["t"])
    values = {"q": (F.col("l_quantity"), F.lit(2)), "t": (F.col("l_tax"), F.lit(0.01))}
    low, high = evaluate.corners(values, lambda v: 30 - v["q"] * (1 + v["t"]))
    safety = margin({"q": F.col("l_quantity"), "t": F.col("l_tax")}) / 4
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", evaluate.verdict(F.round(low, 9), F.round(high, 9)).alias("verdict"), F.round(safety, 6).alias("safety"))


@query("""WITH RECURSIVE s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS lo, CAST(p_size AS DOUBLE) * 20 AS hi, 0 AS i FROM part WHERE p_size > 0 AND p_size <= 60 AND p_size * 20 > 60
 UNION ALL SELECT p_partkey, CASE WHEN (lo + hi) / 2 <= 60 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (lo + hi) / 2 <= 60 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 12)
SELECT p.p_partkey, round(s.hi, 6) AS flips_at FROM part p LEFT JOIN s ON s.p_partkey = p.p_partkey AND s.i = 12""")
def flip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a size of a part that passes `size <= 60` would come to fail."""
    flip = evaluate.flip_point(F.col("p_size"), lambda v: 60 - v)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(F.when(F.col("p_size") > 0, flip), 6).alias("flips_at"))


@query("""WITH u(u, d, f) AS (VALUES ('g', 'mass', 0.001::DOUBLE), ('kg', 'mass', 1.0::DOUBLE), ('mg', 'mass', 0.001::DOUBLE * 0.001::DOUBLE), ('m', 'length', 1.0::DOUBLE), ('cm', 'length', 0.01::DOUBLE), ('km', 'length', 1000.0::DOUBLE), ('s', 'time', 1.0::DOUBLE), ('h', 'time', 3600.0::DOUBLE)),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, ['g', 'cm', 'h', 'mg'][l_linenumber % 4 + 1] AS a, ['kg', 'km', 's', 'm', 'xx'][l_partkey % 5 + 1] AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, a, b, round(CASE WHEN p.d = q.d THEN l_quantity * p.f / q.f END, 9) AS converted FROM x LEFT JOIN u p ON p.u = a LEFT JOIN u q ON q.u = b""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = {"g": ("mass", 1e-3), "kg": ("mass", 1.0), "m": ("length", 1.0), "s": ("time", 1.0), "h": ("time", 3600.0)}
    pick = lambda names, key, n: F.get(F.array(*map(F.lit, names)), F.col(key) % n)
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", pick(("g", "cm", "h", "mg"), "l_linenumber", 4).alias("a"), pick(("kg", "km", "s", "m", "xx"), "l_partkey", 5).alias("b"))
    return evaluate.convert(x, "l_quantity", "a", "b", units).select("l_orderkey", "l_linenumber", "l_partkey", "a", "b", F.round("converted", 9).alias("converted"))


@query("""SELECT o_orderkey, CASE WHEN p >= 0.8 THEN 'met' WHEN p <= 0.2 THEN 'not-met' ELSE 'unclear' END AS band, CAST(CASE o_orderpriority[1] WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END + (o_custkey % 3) + (o_orderstatus = 'F')::INT AS INTEGER) AS credits
FROM (SELECT *, (o_orderkey % 100) / 100.0::DOUBLE AS p FROM orders)""")
def decision_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of a probability, and the credits of an effort with its tools and image."""
    first = F.substring("o_orderpriority", 1, 1)
    effort = F.when(first == "1", "high").when(first == "2", "medium").otherwise("low")
    return read(spark, sf_dir, "orders").select("o_orderkey", evaluate.decision_band(F.col("o_orderkey") % 100 / 100.0).alias("band"), evaluate.credits(effort, F.col("o_custkey") % 3, F.col("o_orderstatus") == "F").alias("credits"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part),
n AS (SELECT p_partkey, len(list_filter(['red', 'small', 'steel'], lambda x: list_contains(w, x))) AS a, len(list_filter(['blue', 'large', 'brass'], lambda x: list_contains(w, x))) AS b, len(list_filter(['green', 'economy', 'steel'], lambda x: list_contains(w, x))) AS c FROM w)
SELECT p_partkey, CASE WHEN greatest(a, b, c) < 2 THEN NULL WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS topic FROM n""")
def licensed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w"))
    return evaluate.best_topic(rows, "w", {"first": ["red", "small", "steel"], "second": ["blue", "large", "brass"], "third": ["green", "economy", "steel"]}).select("p_partkey", "topic")


@query("""WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
h1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 'n3' QUALIFY dense_rank() OVER (ORDER BY b) <= 24),
h2 AS (SELECT DISTINCT u.b AS node FROM h1 JOIN u ON u.a = h1.node WHERE u.b <> 'n3' AND u.b NOT IN (SELECT node FROM h1) QUALIFY dense_rank() OVER (ORDER BY u.b) <= 60)
SELECT 'n3' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def concept_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded neighbourhood of a node over two hops; of the frontier the first nodes by name are followed, where the reference takes any."""
    from clauseq.operators.graph import neighborhood

    link = lambda t, a, b, p, q: read(spark, sf_dir, t).select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst"))
    e = link("nation", "n_regionkey", "n_nationkey", "r", "n").unionByName(link("supplier", "s_nationkey", "s_suppkey", "n", "s")).unionByName(link("customer", "c_nationkey", "c_custkey", "n", "c"))
    return neighborhood(e, "n3", [24, 60])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_orderstatus = 'O' AS active FROM orders), f AS (SELECT o_custkey FROM o WHERE o_orderkey = (SELECT min(o_orderkey) FROM o WHERE active))
SELECT o_orderkey, y FROM o WHERE active AND o_custkey IN (SELECT o_custkey FROM f)""")
def edition_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active editions in the family of the first match."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    first = o.agg(F.min_by("o_custkey", "o_orderkey").alias("o_custkey"))
    return o.join(F.broadcast(first), "o_custkey", "left_semi").select("o_orderkey", "y")


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
c AS (SELECT doc_id, flatten(list_transform(ps, lambda x: list_transform(range(0, CAST((length(x) - 1) // 2800 AS BIGINT) + 1), lambda i: substr(x, CAST(i * 2800 + 1 AS BIGINT), 2800)))) AS xs FROM p),
r AS (SELECT doc_id, xs, 0 AS i, CAST([] AS VARCHAR[]) AS parts FROM c UNION ALL
 SELECT doc_id, xs, i + 1, CASE WHEN len(parts) > 0 AND length(parts[-1]) + 2 + length(xs[i + 1]) <= 2800 THEN list_append(parts[1:len(parts) - 1], parts[-1] || chr(10) || chr(10) || xs[i + 1]) ELSE list_append(parts, xs[i + 1]) END FROM r WHERE i < len(xs))
SELECT doc_id, generate_subscripts(parts, 1) - 1 AS part, md5(unnest(parts)) AS body FROM r WHERE i = len(xs)""")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of a document's paragraphs into chunks."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), "text")
    return chunking.chunk_documents(d, "doc_id", "title", "text").select("doc_id", "part", F.md5(F.col("body").cast("binary")).alias("body"))


@query("""WITH s AS (SELECT user_id, event_id, ts, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, count(*) AS n, max(i) FILTER (i <= 2 OR used <= 500) AS kept FROM (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM s) GROUP BY user_id""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passages fit a running budget, two at least; values are not negative, so the first overflow ends it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), F.sum("value").over(w).alias("used"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when((F.col("i") <= 2) | (F.col("used") <= 500), F.col("i"))).alias("kept"))


@query(f"""WITH e AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier UNION ALL SELECT 'family:' || n_regionkey, 'n' || n_nationkey FROM nation),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), o AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS degree FROM d),
seeds AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_name IN ('NATION_3', 'NATION_24') UNION ALL SELECT 'family:1'),
m0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS mass FROM seeds), {_MASS}
SELECT node, round(mass, 9) AS mass FROM m{graph.ITERATIONS} WHERE node[1] = 's' ORDER BY 2 DESC, 1 LIMIT 6""")
def ppr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the mass that two nations and a region give them."""
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = s.select(name("n", "s_nationkey").alias("a"), name("s", "s_suppkey").alias("b")).unionByName(n.select(name("family:", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")))
    nodes = n.select(name("n", "n_nationkey").alias("id"), F.lit("concept").alias("kind"), F.col("n_name").alias("label"))
    nodes = nodes.unionByName(s.select(name("s", "s_suppkey").alias("id"), F.lit("doc").alias("kind"), F.col("s_name").alias("label")))
    nodes = nodes.unionByName(read(spark, sf_dir, "region").select(name("family:", "r_regionkey").alias("id"), F.lit("family").alias("kind"), F.col("r_name").alias("label")))
    return graph.documents_by_mass(graph.personalized_pagerank(edges, graph.seed_nodes(nodes, ["nation_3", "nation_24", "no"], "1")), nodes)


@query("""WITH q AS (SELECT r_regionkey AS query_id, [['red', 'blue', 'small', 'steel', 'green'][r_regionkey % 5 + 1], 'No', 'Bolt', 'Brand#' || r_regionkey, 'ing'] AS ts FROM region),
t AS (SELECT query_id, unnest(list_filter(ts, lambda x: length(x) >= 3)) AS term, generate_subscripts(list_filter(ts, lambda x: length(x) >= 3), 1) AS k FROM q),
d AS (SELECT DISTINCT query_id, k, 's' || l_suppkey AS doc FROM t JOIN part ON k <= 4 AND contains(lower(p_name || ' ' || p_brand), lower(term)) JOIN lineitem ON l_partkey = p_partkey),
f AS (SELECT query_id, doc, min(k) AS k FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY doc) <= 12) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, doc) AS INTEGER) AS place, doc FROM f QUALIFY place <= 6""")
def defining_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the parts whose name or brand has a region's terms."""
    r = F.col("r_regionkey")
    first = F.get(F.array(*map(F.lit, ("red", "blue", "small", "steel", "green"))), r % 5)
    asked = read(spark, sf_dir, "region").select(r.alias("query_id"), F.array(first, F.lit("No"), F.lit("Bolt"), F.concat(F.lit("Brand#"), r), F.lit("ing")).alias("terms"))
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("concept").alias("kind"), F.concat_ws(" ", "p_name", "p_brand").alias("label"))
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("defines").alias("kind"))
    return graph.defining_documents(asked, edges, nodes)


@query("""WITH s AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
f AS (SELECT o_custkey, s.src, s.dst FROM s JOIN orders ON o_orderkey = s.src WHERE s.dst IS NOT NULL UNION SELECT o_custkey, s.src, s.dst FROM s JOIN orders ON o_orderkey = s.dst)
SELECT 'f' || o_custkey AS family, 'o' || src AS src, 'o' || dst AS dst FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY 'o' || src, 'o' || dst) <= 40""")
def family_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are a family; an order's successor is the next of its priority."""
    o = read(spark, sf_dir, "orders")
    order, edge = F.concat(F.lit("o"), "o_orderkey"), lambda kind, rows: rows.select("src", "dst", F.lit(kind).alias("kind"))
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    after = edge("successor", o.select(order.alias("src"), F.lead(order).over(w).alias("dst")).where("dst IS NOT NULL"))
    return graph.family_changes(after.unionByName(edge("part_of", o.select(order.alias("src"), F.concat(F.lit("f"), "o_custkey").alias("dst")))))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders),
a AS (SELECT o_custkey, list_distinct([CAST(max(t) AS VARCHAR), CAST(min(t) AS VARCHAR)]) AS ns FROM o GROUP BY o_custkey),
h AS (SELECT a.o_custkey, 'u' || o.o_orderkey AS unit_id, len(list_filter(ns, lambda n: n = CAST(t AS VARCHAR))) AS shared FROM a JOIN o USING (o_custkey))
SELECT o_custkey AS query_id, min(unit_id) AS unit_id, arg_min(shared, unit_id) AS shared FROM h WHERE shared > 0 GROUP BY o_custkey""")
def table_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's answer names two of its orders' totals, one with its thousands apart; each order is a table."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("t"))
    low = F.regexp_replace(F.min("t").cast("string"), r"^(\d+)(\d{3})$", "$1 $2")
    answers = o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.concat(F.lit("From "), low, F.lit(" up to "), F.max("t"), F.lit(".")).alias("text")).withColumn("doc", F.col("query_id"))
    tables = o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("u"), "o_orderkey").alias("unit_id"), F.concat(F.lit("Total | "), "t", F.lit(" | no")).alias("text"))
    return evaluate.complete_tables(answers, tables)


@query("""WITH q AS (SELECT n_nationkey AS query_id, list_distinct(string_split_regex(lower('Is a ' || ['red', 'BLUE', 'small', 'steel'][n_nationkey % 4 + 1] || ' bolt2 or ring valid, by ' || n_name || ' economy?'), '[^a-z_]+')) AS ws FROM nation),
c AS (SELECT p_partkey AS node_id, list_filter(list_distinct([lower(string_split(p_name, ' ')[1]), lower(string_split(p_name, ' ')[2]), lower(p_type)]), lambda x: regexp_matches(x, '^[a-z_]{2,}$')) AS ls FROM part),
m AS (SELECT query_id, node_id, len(list_filter(ls, lambda x: list_contains(ws, x))) AS named FROM q, c)
SELECT query_id, node_id, CAST(named AS BIGINT) AS named FROM m WHERE named >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY named DESC, node_id) = 1""")
def symbol_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part whose name and type a nation's question names most; a part's words stand for the symbols of a constraint."""
    word = F.get(F.array(*map(F.lit, ("red", "BLUE", "small", "steel"))), F.col("n_nationkey") % 4)
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Is a "), word, F.lit(" bolt2 or ring valid, by "), "n_name", F.lit(" economy?")).alias("text"))
    words = F.split("p_name", " ")
    symbols = F.array(F.concat(F.lit("part.size."), F.get(words, F.lit(0))), F.get(words, F.lit(1)), F.concat(F.lit("t."), "p_type"))
    return evaluate.bind_by_symbols(asked, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), symbols.alias("symbols")))
