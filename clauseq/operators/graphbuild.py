"""The graph of publications from their records, bibliographies and concepts, and the graph of a document's sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseq.functions.codecs import Codec
from clauseq.plans.folders import kept

#: Kinds of edges by the relation that a record names; others are no edge.
RELATIONS = {
    "hasPart": "part_of", "partOf": "part_of", "includedIn": "part_of", "instanceOf": "variant_of", "hasInstance": "variant_of",
    "translatedFrom": "variant_of", "hasSuccessor": "successor", "amends": "amends", "updates": "amends",
}
#: Citations that count of a passage, characters of a label, states that no active edition has.
CITATIONS, LABEL, ENDED = 40, 200, ("superseded", "withdrawn")
#: What marks a bibliography, and within how many characters of a text.
BIBLIOGRAPHY, NORMATIVE, HEAD = r"(?i)bibliograph", r"(?i)normative\s+references?", 400
SECTIONS, UNITS = ("clause", "annex"), ("table", "term", "formula", "requirement", "note", "example", "sourcecode")


def _parts(identifier: Column, codec: Codec) -> tuple[Column, Column]:
    """(part, edition) of an identifier; null and '' where it has none."""
    bare = F.regexp_replace(identifier, rf"^{codec.prefix}\s+", "")
    return F.nullif(F.regexp_extract(bare, r"^[A-Z]+\s+\d+(?:-([A-Za-z0-9]+))?", 1), F.lit("")), F.regexp_extract(bare, r":(\d{4})", 1)


def publications(records: DataFrame, codec: Codec) -> DataFrame:
    """place, node, identifier, label, family, part, edition, status, relations: the records that are publications.

    records: place (their order), identifiers (content, primary), titles (language,
    content), status, relations (type, identifiers). The first primary identifier counts, else the
    first; the first English title, else the first, else the identifier. Records outside the grammar are left out.
    """
    primary = F.filter("identifiers", lambda x: F.coalesce(x["primary"], F.lit(False)) & (F.coalesce(x["content"], F.lit("")) != ""))
    name = F.coalesce(F.get(primary, F.lit(0))["content"], F.get("identifiers", F.lit(0))["content"])
    english = F.filter("titles", lambda t: (t["language"] == "eng") & (F.coalesce(t["content"], F.lit("")) != ""))
    label = F.coalesce(F.get(english, F.lit(0))["content"], F.nullif(F.get("titles", F.lit(0))["content"], F.lit("")), name)
    part, edition = _parts(name, codec)
    family = F.substring(codec.family_node(name), 8, 100)
    rows = records.select(
        "place", codec.node(name).alias("node"), name.alias("identifier"), F.substring(label, 1, LABEL).alias("label"), F.coalesce(family, F.lit("")).alias("family"),
        part.alias("part"), edition.alias("edition"), F.coalesce("status", F.lit("unknown")).alias("status"), "relations",
    )
    return rows.where("node IS NOT NULL")


def record_edges(found: DataFrame, codec: Codec) -> DataFrame:
    """src, dst, kind: the family that each publication is a part of, and its relations to others by RELATIONS; each once."""
    family = found.where("family <> ''").select(F.col("node").alias("src"), F.concat(F.lit("family:"), "family").alias("dst"), F.lit("part_of").alias("kind"))
    kinds = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    each = found.select("node", F.explode("relations").alias("r")).select("node", kinds[F.col("r.type")].alias("kind"), F.explode("r.identifiers").alias("other"))
    related = each.select(F.col("node").alias("src"), codec.node(F.col("other")).alias("dst"), "kind").where("kind IS NOT NULL AND dst IS NOT NULL AND dst <> src")
    return family.unionByName(related).distinct()


def registry(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per publication: node, identifier, family, part, edition, status, title, derived_status, superseded_by, active.

    Of several records of one the first counts. What has a successor is superseded by
    it, whatever its own status says (by the greatest name of several). Active is the
    newest edition of a family and part without a successor and not ended by its
    status, of equal editions the first record; a family may have none.
    """
    columns = ["place", "identifier", "family", "part", "edition", "status", "label"]
    docs = found.groupBy("node").agg(F.min_by(F.struct(*columns), "place").alias("x")).select("node", "x.*")
    after = edges.where("kind = 'successor'").groupBy(F.col("src").alias("node")).agg(F.max("dst").alias("superseded_by"))
    docs = docs.join(after, "node", "left")
    live = docs.where(F.col("superseded_by").isNull() & ~F.col("status").isin(*ENDED))
    top = live.groupBy("family", "part").agg(F.max(F.struct("edition", (-F.col("place")).alias("p"), "node")).alias("x")).select(F.col("x.node").alias("node"), F.lit(True).alias("_top"))
    docs = docs.join(top, "node", "left")
    derived = F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status"))
    return docs.select("node", "place", "identifier", "family", "part", "edition", "status", F.col("label").alias("title"), derived.alias("derived_status"), "superseded_by", F.coalesce("_top", F.lit(False)).alias("active"))


def is_bibliography(title: Column, text: Column) -> Column:
    t, head = F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    return t.rlike(BIBLIOGRAPHY) | t.rlike(NORMATIVE) | head.rlike(BIBLIOGRAPHY)


def citation_edges(passages: DataFrame, docs: DataFrame, codec: Codec) -> DataFrame:
    """src, dst, label: what each publication's bibliographies cite, each once.

    passages: identifier, edition, title, text. A passage belongs to the publication of its
    family and part with its edition; without such a one to the active, else the newest one. Of
    its citations the first 40 count. One that names the publication's own family and part is none.
    """
    part, _ = _parts(F.col("identifier"), codec)
    rows = passages.where(is_bibliography(F.col("title"), F.col("text"))).select(
        F.substring(codec.family_node(F.col("identifier")), 8, 100).alias("family"), part.alias("part"), F.coalesce("edition", F.lit("")).alias("edition"), F.slice(codec.cited(F.col("text")), 1, CITATIONS).alias("cited")
    )
    # A family and part has few editions; its best for any edition asked, and each edition's own.
    of = docs.select("family", "part", "node", F.col("edition").alias("own"), "place", "active")
    own = of.groupBy("family", "part", F.col("own").alias("edition")).agg(F.min_by("node", "place").alias("exact"))
    best = of.groupBy("family", "part").agg(F.max(F.struct("active", "own", (-F.col("place")).alias("p"), "node")).alias("x")).select("family", "part", F.col("x.node").alias("best"))
    same = lambda a, b: (F.col(f"{a}.family") == F.col(f"{b}.family")) & F.col(f"{a}.part").eqNullSafe(F.col(f"{b}.part"))
    j = rows.alias("r").join(best.alias("b"), same("r", "b")).join(own.alias("o"), same("r", "o") & (F.col("r.edition") == F.col("o.edition")) & (F.col("r.edition") != ""), "left")
    # A plain explode would have the citations made again for a filter on their number.
    each = j.select("r.family", "r.part", F.coalesce("o.exact", "b.best").alias("src"), F.explode_outer("cited").alias("c")).where("c IS NOT NULL").select("family", "part", "src", F.col("c.node").alias("dst"), F.col("c.label").alias("label"))
    label_part, _ = _parts(F.col("label"), codec)
    itself = (F.substring(codec.family_node(F.col("label")), 8, 100) == F.col("family")) & label_part.eqNullSafe(F.col("part"))
    # Each spelling is looked at once for all passages that have it.
    others = each.distinct().where(~F.coalesce(itself, F.lit(False)))
    return others.groupBy("src", "dst").agg(F.min(F.substring("label", 1, LABEL)).alias("label"))


def concept_edges(concepts: DataFrame, codec: Codec) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of concepts (concept_id, term, sources): the first source of the grammar defines it."""
    nodes = concepts.where("concept_id IS NOT NULL").select(F.concat(F.lit("concept:"), "concept_id").alias("id"), F.lit("concept").alias("kind"), F.substring(F.coalesce("term", "concept_id"), 1, LABEL).alias("label"))
    sources = F.array_compact(F.transform("sources", lambda s: codec.node(s)))
    edges = concepts.where("concept_id IS NOT NULL").select(F.get(sources, F.lit(0)).alias("src"), F.concat(F.lit("concept:"), "concept_id").alias("dst"), F.lit("defines").alias("kind"))
    return nodes.dropDuplicates(["id"]), edges.where("src IS NOT NULL").distinct()


def build(records: DataFrame, passages: DataFrame, concepts: DataFrame, codec: Codec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, edges). nodes: id, kind, label; of a publication's records the last gives the label. edges: src, dst, kind, only where both ends are nodes."""
    # Read for the documents, their relations and labels; the records are parsed once for all.
    found = kept(publications(records, codec))
    related = record_edges(found, codec)
    docs = registry(found, related)
    cites = citation_edges(passages, docs, codec)
    concept_nodes, defines = concept_edges(concepts, codec)
    nodes = (
        found.groupBy(F.col("node").alias("id")).agg(F.max_by("label", "place").alias("label")).select("id", F.lit("doc").alias("kind"), "label")
        .unionByName(found.where("family <> ''").select(F.concat(F.lit("family:"), "family").alias("id"), F.lit("family").alias("kind"), F.col("family").alias("label")).distinct())
        .unionByName(cites.groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label")).select("id", F.lit("cite").alias("kind"), "label"))
        .unionByName(concept_nodes)
    )
    # Families, what is cited and concepts are nodes by themselves, and so is what cites; only the documents that records and concepts name may be none.
    known = found.select("node").distinct()
    named = related.where(~F.col("dst").startswith("family:")).join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    edges = (
        related.where(F.col("dst").startswith("family:")).unionByName(named.select("src", "dst", "kind")).unionByName(cites.select("src", "dst", F.lit("cites").alias("kind")))
        .unionByName(defines.join(known.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "kind"))
    )
    return docs, nodes, edges


def section_graph(documents: DataFrame, units: DataFrame, links: DataFrame, codec: Codec) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents' sections.

    documents: bundle, slug, canonical, relations (type, to). units: bundle, id, type, number, anchor,
    parent. links: bundle, kind, from_unit, to_target.

    A clause or annex is a part of its document; a table, term, formula, requirement, note,
    example or listing, of its parent clause. Links between units are parts, to concepts
    definitions, to documents of the grammar citations, but for the document's own. A
    document's relations keep their types. A section's node is known by number, else anchor, else id.
    """
    head = documents.select("bundle", "slug", codec.node(F.col("canonical")).alias("doc"), "relations")
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    u = units.join(head.select("bundle", "slug", "doc"), "bundle").select("bundle", "id", "type", "parent", "doc", F.concat(F.lit("sec:"), "slug", F.lit(":"), F.coalesce(some("number"), some("anchor"), F.col("id"))).alias("sec"))
    of = u.select("bundle", F.col("id").alias("other"), F.col("sec").alias("other_sec"), F.col("type").alias("other_type"))
    edge = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
    clause = u.where(F.col("type").isin(*SECTIONS) & F.col("doc").isNotNull()).select(edge("sec", "doc", "part_of").alias("e"))
    inner = u.where(F.col("type").isin(*UNITS)).join(of, (u["bundle"] == of["bundle"]) & (F.col("parent") == F.col("other"))).where(F.col("other_type").isin(*SECTIONS)).select(edge("sec", "other_sec", "part_of").alias("e"))
    of_from = u.select("bundle", F.col("id").alias("from_unit"), "sec", "doc")
    linked = links.join(of_from, ["bundle", "from_unit"])
    part = linked.where("kind = 'part_of'").join(of.withColumnRenamed("other", "to_target"), ["bundle", "to_target"]).select(edge("sec", "other_sec", "part_of").alias("e"))
    concept = linked.where("kind = 'defines'").withColumn("c", F.concat(F.lit("concept:"), F.regexp_replace("to_target", "^concept:", ""))).select(edge("sec", "c", "defines").alias("e"))
    cited = linked.where("kind = 'cites'").withColumn("t", codec.node(F.col("to_target"))).where("t IS NOT NULL AND NOT (t <=> doc)").select(edge("sec", "t", "cites").alias("e"))
    related = head.where("doc IS NOT NULL").select("doc", F.explode("relations").alias("r")).withColumn("t", codec.node(F.col("r.to"))).where("t IS NOT NULL AND t <> doc AND r.type <> ''")
    related = related.select(F.struct(F.col("doc").alias("src"), F.col("t").alias("dst"), F.col("r.type").alias("kind")).alias("e"))
    edges = clause
    for more in (inner, part, concept, cited, related):
        edges = edges.unionByName(more)
    edges = edges.select("e.*").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(u.where(F.col("type").isin(*SECTIONS)).select(F.col("sec").alias("id"))).unionByName(head.where("doc IS NOT NULL").select(F.col("doc").alias("id"))).distinct()
    kind = F.when(F.col("id").startswith("sec:"), "section").when(F.col("id").startswith("concept:"), "concept").otherwise("doc")
    return ends.select("id", kind.alias("kind"), F.col("id").alias("label")), edges
