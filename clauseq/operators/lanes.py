"""The lanes that fill a pool before its stages: the dense one with its four ways, the glossary's, those of linked documents, and units by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseq.operators.registry import starts_of
from clauseq.operators.stages import KEEP, per_query, unseen

#: Hits of a dense query, of its deep one, hits under which an edition's pin is doubted.
NEAR, DEEP, DOUBT = 50, 100, 3
#: Fixed values of the lanes: candidates, those kept, and the share of their score that they keep.
GLOSSARY, GLOSSARY_FLOOR, GLOSSARY_KEPT, DEFINITION = 5, 0.5, 3, 300
CONCEPT_KEPT, CONCEPT_DISCOUNT, CONCEPT_OF_TERM, SHORTEST_TERM = 3, 0.75, 12, 3
LINKED_KEPT, LINKED_DISCOUNT, MASS_DISCOUNT = 5, 0.375, 0.375
LICENSED_UNITS, LICENSED_SCORE = 40, 0.5


def in_scope(number: Column, identifier: Column, scope: Column) -> Column:
    """A hit is in a document's scope by its number; in that of a part ("134-2") also by the part's name as the last word of its identifier."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(identifier, F.lit("")), r"\s*\([A-Z]\)\s*$", ""), r":\d+$", ""))
    last = F.lower(F.element_at(F.split(bare, r"\s+"), -1))
    part = F.contains(scope, F.lit("-")) & (number == F.split(scope, "-")[0]) & (last == F.lower(scope))
    return F.coalesce((number == scope) | part, F.lit(False))


def dense(hits: DataFrame, filters: DataFrame, near: int = NEAR, keep: int = KEEP) -> DataFrame:
    """The dense lane: every column of hits, and pos, way and edition_dropped.

    hits: each query's DEEP nearest by rank (1-based), with number, identifier and
    edition. filters: query_id, scope and pin, one row a query; null or empty is none.
    One ranking serves all ways, which each query takes by its own counts:

    - `plain`: without a scope, the first `near`;
    - `scoped`: of these, those in scope, and of the pinned edition or without one;
    - `deep`: with none of them, those in scope of all DEEP, of any edition;
    - `dropped`: a pin that leaves fewer than DOUBT hits where the scope alone has more is dropped.

    Fewer than `keep` hits in scope are followed by the others of the first `near`.
    A query's hits are DEEP at most, so a window over them never gathers more.
    """
    blank = lambda c: F.when(F.trim(c) != "", c)
    f = filters.select("query_id", blank(F.col("scope")).alias("_scope"), blank(F.col("pin")).alias("_pin"))
    h = hits.join(f, "query_id", "left")
    near_ = F.col("rank") <= near
    ours = in_scope(F.col("number"), F.col("identifier"), F.col("_scope"))
    edition = F.col("_pin").isNull() | (F.coalesce("edition", F.lit("")) == "") | (F.col("edition") == F.col("_pin"))
    h = h.withColumns({"_near": near_, "_ours": ours & (F.col("rank") <= DEEP), "_fits": ours & near_ & edition})
    count = lambda c: F.count_if(c).over(per_query())
    h = h.withColumns({"_n": count(F.col("_fits")), "_deep": count(F.col("_ours")), "_doc": count(F.col("_ours") & F.col("_near"))})
    first = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_deep"))
    way = (
        F.when(F.col("_scope").isNull(), "plain").when(F.col("_pin").isNotNull() & (first < DOUBT) & (F.col("_doc") > first), "dropped")
        .when(F.col("_n") == 0, "deep").otherwise("scoped")
    )
    h = h.withColumn("way", way)
    own = (
        F.when(F.col("way") == "plain", F.col("_near")).when(F.col("way") == "dropped", F.col("_ours") & F.col("_near"))
        .when(F.col("way") == "deep", F.col("_ours")).otherwise(F.col("_fits"))
    )
    h = h.withColumn("_own", own).withColumn("_kept", count(F.col("_own")))
    widened = (F.col("way") != "plain") & (F.col("_kept") < keep) & F.col("_near")
    h = h.where(F.col("_own") | widened)
    place = F.row_number().over(per_query().orderBy(F.desc("_own"), "rank"))
    return h.select(*hits.columns, place.cast("long").alias("pos"), "way", (F.col("way") == "dropped").alias("edition_dropped"))


def glossary(hits: DataFrame) -> DataFrame:
    """query_id, place, term, definition, score: the first three concepts of the glossary's nearest entries.

    hits: query_id, rank, cosine, score (of the reranker, else the cosine), title and text, whose
    definition follows " — ". Entries of one concept in two spellings are one, the first by rank.
    """
    near = hits.where((F.col("rank") <= GLOSSARY) & (F.col("cosine") >= GLOSSARY_FLOOR))
    parts = F.split("text", " — ")
    said = near.select("query_id", "rank", F.trim(F.coalesce("title", F.lit(""))).alias("term"), F.substring(F.array_join(F.slice(parts, 2, 10_000), " — "), 1, DEFINITION).alias("definition"), "score")
    said = said.where((F.col("term") != "") & (F.coalesce("definition", F.lit("")) != "") & (F.col("score") > 0))
    plain = F.regexp_replace(F.regexp_replace(F.lower("term"), "[^a-z0-9 ]", ""), r"labeler\b", "labeller")
    said = said.withColumn("_key", F.trim(F.regexp_replace(plain, r"\s+", " ")))
    once = said.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("rank"))).where("_i = 1")
    ranked = once.withColumn("place", F.row_number().over(per_query().orderBy(F.desc("score"), "rank"))).where(F.col("place") <= GLOSSARY_KEPT)
    return ranked.select("query_id", "place", "term", "definition", "score")


def concept_documents(terms: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, doc: the documents that define a concept whose label holds one of a query's terms (query_id, term); of each term the first 12 by name.

    Terms of three signs or more meet the labels by the term's first three signs, not each label by each term.
    """
    t = terms.where(F.char_length("term") >= SHORTEST_TERM).select("query_id", F.lower("term").alias("term")).distinct()
    labels = nodes.where("kind = 'concept'").select("id", F.lower("label").alias("label"))
    labels = labels.select("id", "label", F.explode(F.array_distinct(starts_of(F.col("label"), SHORTEST_TERM))).alias("key"))
    met = t.withColumn("key", F.substring("term", 1, SHORTEST_TERM)).join(labels, "key").where(F.contains("label", "term")).select("query_id", "term", F.col("id").alias("dst")).distinct()
    docs = met.join(edges.where("kind = 'defines'").select("src", "dst"), "dst").select("query_id", "term", F.col("src").alias("doc")).distinct()
    w = Window.partitionBy("query_id", "term").orderBy("doc")
    return docs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= CONCEPT_OF_TERM).select("query_id", "doc").distinct()


def merged(pool: DataFrame, lane: DataFrame, keep: int, factor: float) -> DataFrame:
    """The lane's first `keep` hits (by pos) that the pool has not, behind the pool at a share of their score. The first are counted before those that the pool has go."""
    first = lane.withColumn("_i", F.row_number().over(per_query().orderBy("pos"))).where(F.col("_i") <= keep).drop("_i")
    return unseen(pool, first, keep, factor)


def concept_lane(pool: DataFrame, lane: DataFrame) -> DataFrame:
    return merged(pool, lane, CONCEPT_KEPT, CONCEPT_DISCOUNT)


def graph_lane(pool: DataFrame, lane: DataFrame) -> DataFrame:
    return merged(pool, lane, LINKED_KEPT, LINKED_DISCOUNT)


def mass_lane(pool: DataFrame, lane: DataFrame) -> DataFrame:
    return merged(pool, lane, LINKED_KEPT, MASS_DISCOUNT)


def unit_key(standard: Column, node: Column) -> Column:
    """The id under which a unit of a standard is stored."""
    return F.concat(F.lit("m"), F.substring(F.sha1(F.concat_ws("|", standard, node).cast("binary")), 1, 16))


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows with the ids; an id that nothing has gives none, a repeated one gives its row once."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi").select(*rows.columns)


def licensed_lane(pool: DataFrame, entitled: DataFrame, units: DataFrame, stored: DataFrame) -> DataFrame:
    """The first 40 units by name of the standards that a query's asker may read (query_id, standard), looked up by id, behind the pool with a fixed score.

    units: standard, node_id. stored: id and the columns of hits. No similarity is asked for: a package's units are its units.
    """
    mine = entitled.select("query_id", "standard").distinct().join(units.select("standard", "node_id").distinct(), "standard")
    first = mine.withColumn("pos", F.row_number().over(per_query().orderBy("standard", "node_id"))).where(F.col("pos") <= LICENSED_UNITS)
    asked = first.select("query_id", "pos", unit_key(F.col("standard"), F.col("node_id")).alias("id"))
    own = [c for c in pool.columns if c in stored.columns and c not in ("query_id", "pos", "id", "score", "rerank")]
    hits = asked.join(stored.select("id", *own), "id")
    rest = {c: F.lit(None).cast(t) for c, t in pool.dtypes if c not in hits.columns}
    return unseen(pool, hits.withColumns(rest | {"score": F.lit(LICENSED_SCORE)}), LICENSED_UNITS)


#: The stages that come first in a run; each takes the pool, dense the ranking that it is made of.
LANES = {"dense": dense, "concept-graph": concept_lane, "graph-lane": graph_lane, "graph-ppr": mass_lane, "licensed-lane": licensed_lane}
