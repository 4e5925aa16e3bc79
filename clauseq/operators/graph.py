"""Ranking over an undirected multigraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseq.operators.registry import starts_of

DAMPING, ITERATIONS = 0.85, 12
#: Terms, nodes of a term, seeds, documents of an answer; documents of a term where a query is widened; changes of a family.
TERMS, OF_TERM, SEEDS, DOCUMENTS = 3, 6, 4, 6
WIDEN_TERMS, WIDEN_OF_TERM, CHANGES = 4, 12, 40


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """node, mass (9 decimals). edges: a, b, read both ways. seeds: node; those that have an edge share the restart evenly.

    Every node of the graph has an edge, so no mass is lost. An iteration is one
    join and one grouped sum, which share their partitioning by node.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL")
    out = both.join(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "a").withColumnRenamed("a", "node")
    live = seeds.select("node").distinct().join(both.select(F.col("a").alias("node")), "node", "left_semi")
    # The number of seeds is one row.
    start = live.join(F.broadcast(live.agg(F.count(F.lit(1)).alias("n")))).select("node", (1.0 / F.col("n")).alias("mass"))
    mass = start
    for _ in range(iterations):
        moved = mass.join(out, "node").select(F.col("b").alias("node"), (F.lit(DAMPING) * F.col("mass") / F.col("degree")).alias("mass"))
        mass = moved.unionByName(start.select("node", (F.lit(1 - DAMPING) * F.col("mass")).alias("mass"))).groupBy("node").agg(F.sum("mass").alias("mass"))
    return mass.select("node", F.round("mass", 9).alias("mass"))


def neighborhood(edges: DataFrame, seed: str, caps: list[int]) -> DataFrame:
    """(node, hops) around a seed over undirected edges (src, dst): of each hop's new nodes the first by name, as many as its cap. A frontier is no longer than that, so it is broadcast."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = edges.sparkSession.createDataFrame([(seed, 0)], "node string, hops int")
    frontier = found
    for hop, cap in enumerate(caps, 1):
        new = both.join(F.broadcast(frontier.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = new.join(F.broadcast(found), "node", "left_anti").orderBy("node").limit(cap).withColumn("hops", F.lit(hop))
        found = found.unionByName(frontier)
    return found


def seed_nodes(nodes: DataFrame, terms: list[str], family: str | None = None) -> DataFrame:
    """The first nodes (id, kind, label) whose concept label has one of the first terms, and the family's node: node, four at most, in order of term and id."""
    hits = [nodes.where((F.col("kind") == "concept") & F.contains(F.lower("label"), F.lit(t.lower()))).orderBy("id").limit(OF_TERM).select("id", F.lit(k).alias("k")) for k, t in enumerate(terms[:TERMS]) if len(t) >= 3]
    if family:
        hits.append(nodes.where((F.col("kind") == "family") & (F.col("id") == f"family:{family}")).select("id", F.lit(TERMS).alias("k")))
    if not hits:
        return nodes.limit(0).select(F.col("id").alias("node"))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return every.groupBy("id").agg(F.min("k").alias("k")).orderBy("k", "id").limit(SEEDS).select(F.col("id").alias("node"))


def documents_by_mass(mass: DataFrame, nodes: DataFrame, keep: int = DOCUMENTS) -> DataFrame:
    """The document nodes of most mass: node, mass; ties by node."""
    docs = nodes.where("kind = 'doc'").select(F.col("id").alias("node"))
    return mass.where("mass > 0").join(docs, "node", "left_semi").orderBy(F.desc("mass"), "node").limit(keep)


def defining_documents(asked: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (query_id, terms): query_id, place, doc of the first six documents that define a concept whose label has a term.

    The first four terms of three signs or more count, each with its first 12 documents by
    name. A label meets a term by the three signs that the term begins with.
    """
    t = asked.select("query_id", F.posexplode(F.slice(F.filter("terms", lambda x: F.char_length(x) >= 3), 1, WIDEN_TERMS)).alias("k", "term")).withColumn("term", F.lower("term"))
    labels = nodes.where("kind = 'concept'").select("id", F.lower("label").alias("label"))
    labels = labels.select("id", "label", F.explode(F.array_distinct(starts_of(F.col("label"), 3))).alias("key"))
    met = t.withColumn("key", F.substring("term", 1, 3)).join(labels, "key").where(F.contains("label", "term")).select("query_id", "k", F.col("id").alias("dst"))
    docs = met.join(edges.where("kind = 'defines'").select("src", "dst"), "dst").select("query_id", "k", F.col("src").alias("doc")).distinct()
    docs = docs.withColumn("i", F.row_number().over(Window.partitionBy("query_id", "k").orderBy("doc"))).where(F.col("i") <= WIDEN_OF_TERM)
    docs = docs.groupBy("query_id", "doc").agg(F.min("k").alias("k"))
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "doc"))).where(F.col("place") <= DOCUMENTS).select("query_id", "place", "doc")


def family_changes(edges: DataFrame) -> DataFrame:
    """The successor edges of each family, to which either end is a part: family, src, dst; the first 40 by name."""
    part = edges.where("kind = 'part_of'").select(F.col("src").alias("doc"), F.col("dst").alias("family"))
    after = edges.where("kind = 'successor'").select("src", "dst")
    found = after.join(part.withColumnRenamed("doc", "src"), "src").unionByName(after.join(part.withColumnRenamed("doc", "dst"), "dst")).distinct()
    return found.withColumn("i", F.row_number().over(Window.partitionBy("family").orderBy("src", "dst"))).where(F.col("i") <= CHANGES).select("family", "src", "dst")
