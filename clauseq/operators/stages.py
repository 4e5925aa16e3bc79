"""The retrieval stages as DataFrame steps over a pool of hits, their registry and runner.

A pool has one row per hit: query_id, pos (its place, 1-based), id, score, rerank
(null until a stage sets it) and metadata: doc, family, anchor, edition, lang,
status, doctype, corpus, standard_key, unit_id, title, text. Missing metadata columns are null.
Sorts are stable: the old place is their last key. A query's hits are few (at most
some hundreds), so windows over query_id never gather much; queries spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Fixed values of the stages: share of the spread (or of the score) by which they move a hit, and limits.
OVERVIEW_SHARE, STD_REF, TERM, CONCEPT, RECENCY, STALE, TREE = 0.85, 0.35, 1.5, 0.15, 0.1, 0.4, 0.2
WINDOW_FLOOR, KEEP, RRF_K, FIRST_YEAR = 0.25, 10, 60, 1990
CITES_STANDARD = r"\b(?:ISO|IEC|ASTM|EN)[ /]?\d{3,6}(?:[-–]\d+)?\b"
ASKS_STANDARD = r"(?i)\b(iso|iec|astm|en\s?\d{2,5})\b"
METADATA = "doc family anchor edition lang status doctype corpus standard_key unit_id title text".split()
#: Fixed values of pins, probes and descents: factors of a score, an added hit's score, and limits.
PARENT, CHILD, PROBE_SCORE, PROBES, GATE, CHILDREN, DESCENDED = 0.7, 0.8, 10.0, 8, 3, 25, 2
BIBLIOGRAPHY = r"(?i)bibliograph|normative reference"
ASKS_BLOCK = {"figure": r"\bfig(ure)?s?\b", "table": r"\btables?\b", "formula": r"\b(formulas?|equations?)\b"}


def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def points() -> Column:
    """The score that counts: the rerank score, where there is one."""
    return F.coalesce("rerank", "score")


def as_pool(rows: DataFrame) -> DataFrame:
    """rows with every column of a pool."""
    missing = {c: F.lit(None).cast("string") for c in METADATA if c not in rows.columns}
    if "rerank" not in rows.columns:
        missing["rerank"] = F.lit(None).cast("double")
    return rows.withColumns(missing) if missing else rows


def placed(pool: DataFrame, *by: Column) -> DataFrame:
    """The pool in a new order, ties by the old one; without an order only gaps go."""
    return pool.withColumn("pos", F.row_number().over(per_query().orderBy(*by, F.col("pos"))))


def by_rerank(pool: DataFrame) -> DataFrame:
    return placed(pool, F.col("rerank").desc_nulls_last())


def nudged(pool: DataFrame, hit: Column, share: float) -> DataFrame:
    """The hits for which `hit` holds gain a share of the pool's spread; pools without spread stay as they are."""
    spread = F.max(points()).over(per_query()) - F.min(points()).over(per_query())
    p = pool.withColumn("_s", spread)
    gain = hit & (F.col("_s") > 0)
    return by_rerank(p.withColumn("rerank", F.when(gain, points() + F.col("_s") * share).otherwise(F.col("rerank"))).drop("_s"))


def overview_demote(pool: DataFrame) -> DataFrame:
    return pool.withColumn("score", F.when(F.col("anchor") == "overview", F.col("score") * OVERVIEW_SHARE).otherwise(F.col("score")))


def family_boost(pool: DataFrame, number: str) -> DataFrame:
    """Hits of the asked family rise above the pool's best, each above the one before it; then the pool is sorted."""
    own = F.col("family") == number
    turn = F.count_if(own).over(per_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    best = F.max("score").over(per_query())
    p = pool.withColumn("score", F.when(own, best + turn).otherwise(F.col("score")))
    return placed(p, F.desc("score"))


def std_ref_nudge(pool: DataFrame) -> DataFrame:
    return nudged(pool, F.coalesce(F.col("text").rlike(CITES_STANDARD), F.lit(False)) | F.coalesce(F.col("title").rlike(CITES_STANDARD), F.lit(False)), STD_REF)


def term_nudge(pool: DataFrame, term: str) -> DataFrame:
    """Hits whose title, or first 200 characters after the header line, have the term as a word."""
    body = F.substring(F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), "\n", " "), 1, 200)
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce(body, F.lit(""))))
    return nudged(pool, hay.rlike(rf"(^|[^a-z])\Q{term.lower()}\E([^a-z]|$)"), TERM)


def concept_steer(pool: DataFrame, families: list[str]) -> DataFrame:
    return nudged(pool, F.coalesce(F.col("family").isin(families), F.lit(False)), CONCEPT)


def edition_steer(pool: DataFrame) -> DataFrame:
    """Newer editions gain by their year; those with a newer edition of the same document in the pool lose, and so do superseded or unknown ones with a newer one in the family."""
    year = F.when(F.col("edition").rlike(r"^(19|20)\d{2}$") & (F.col("edition") >= str(FIRST_YEAR)), F.col("edition").cast("int"))
    any_year = F.when(F.col("edition").rlike(r"^(19|20)\d{2}$"), F.col("edition").cast("int"))
    p = pool.withColumns({"_y": year, "_any": any_year, "_s": F.max(points()).over(per_query()) - F.min(points()).over(per_query())})
    p = p.withColumns({
        "_top": F.max("_y").over(per_query()), "_doc": F.max("_y").over(Window.partitionBy("query_id", "doc", "lang")),
        "_fam": F.max("_y").over(Window.partitionBy("query_id", "doctype", "family", "lang")),
    })
    gain = F.when((F.col("_top") > FIRST_YEAR) & F.col("_y").isNotNull(), F.col("_s") * RECENCY * (F.col("_y") - FIRST_YEAR) / (F.col("_top") - FIRST_YEAR))
    lost = (F.col("_any") < F.col("_doc")) | ((F.col("_any") < F.col("_fam")) & F.col("status").isin("superseded", "unknown"))
    loss = F.when(F.coalesce(lost, F.lit(False)), F.col("_s") * STALE)
    moved = F.coalesce(gain, F.lit(0.0)) - F.coalesce(loss, F.lit(0.0))
    new = F.when((F.col("_s") > 0) & (gain.isNotNull() | loss.isNotNull()), points() + moved).otherwise(F.col("rerank"))
    return by_rerank(p.withColumn("rerank", new).drop("_y", "_any", "_s", "_top", "_doc", "_fam"))


def structural_propagate(pool: DataFrame) -> DataFrame:
    """Each clause moves towards the mean of itself, its best ancestor and its descendants' mean, by scores taken before any move; pools of under 3 hits stay."""
    from clauseq.operators.registry import ancestors

    size, lo, hi = F.count(F.lit(1)).over(per_query()), F.min(points()).over(per_query()), F.max(points()).over(per_query())
    p = pool.withColumns({"_n": size, "_s": hi - lo, "_v": (points() - lo) / F.nullif(hi - lo, F.lit(0.0))})
    nodes = p.where((F.col("_n") >= 3) & (F.col("_s") > 0) & F.col("anchor").rlike(r"^\d+(\.\d+)*$")).select("query_id", "doc", "anchor", "id", F.col("_v").alias("v"))
    pairs = ancestors(nodes, ["query_id", "doc"])
    up = pairs.groupBy("query_id", F.col("descendant.id").alias("id")).agg(F.max("ancestor.v").alias("_up"))
    down = pairs.groupBy("query_id", F.col("ancestor.id").alias("id")).agg(F.avg("descendant.v").alias("_down"))
    j = p.join(up, ["query_id", "id"], "left").join(down, ["query_id", "id"], "left")
    mean = (F.col("_v") + F.coalesce("_up", "_v") + F.coalesce("_down", "_v")) / 3
    move = F.when(F.col("_up").isNotNull() | F.col("_down").isNotNull(), F.col("_s") * TREE * (mean - F.col("_v")))
    move = F.when(F.abs(move) >= 1e-9, move)
    j = j.withColumn("_m", F.coalesce(move, F.lit(0.0)))
    j = j.withColumns({"rerank": F.col("rerank") + F.col("_m"), "score": F.when(F.col("rerank").isNull(), F.col("score") + F.col("_m")).otherwise(F.col("score"))})
    return placed(j.drop("_n", "_s", "_v", "_up", "_down", "_m"), F.desc(points())).select(*pool.columns)


def window_floor(pool: DataFrame) -> DataFrame:
    """Hits under a quarter of the best go, but for those without rerank score, typed units and family notes; only where two or more remain."""
    keep = F.col("rerank").isNull() | (points() >= WINDOW_FLOOR * F.max(points()).over(per_query())) | (F.coalesce("unit_id", F.lit("")) != "") | (F.coalesce("anchor", F.lit("")) == "family")
    p = pool.withColumn("_k", F.coalesce(keep, F.lit(False)))
    return p.withColumn("_n", F.count_if("_k").over(per_query())).where(F.col("_k") | (F.col("_n") < 2)).drop("_k", "_n")


def seal(pool: DataFrame, number: str, edition: str | None = None) -> DataFrame:
    """Only hits of the sealed document's family, and of its edition if one is given."""
    p = pool.where(F.col("family") == number)
    return p.where(F.col("edition") == edition) if edition else p


def edition_exclude(pool: DataFrame, number: str, edition: str) -> DataFrame:
    return pool.where(~F.coalesce((F.col("family") == number) & ~F.col("edition").eqNullSafe(edition), F.lit(False)))


def edition_last(pool: DataFrame, number: str, edition: str) -> DataFrame:
    """Other editions of the document go to the end, in their order."""
    return placed(pool, F.coalesce((F.col("family") == number) & ~F.col("edition").eqNullSafe(edition), F.lit(False)))


def license_scope(pool: DataFrame, keys: list[str] | None) -> DataFrame:
    """Hits without a standard key, or with an allowed one. No set leaves all, an empty one hides every keyed hit."""
    return pool if keys is None else pool.where((F.coalesce("standard_key", F.lit("")) == "") | F.col("standard_key").isin(keys))


def corpus_scope(pool: DataFrame, known: list[str], allowed: list[str]) -> DataFrame:
    """Hits of an allowed corpus, and of any that no dataset names."""
    return pool.where((F.coalesce("corpus", F.lit("")) == "") | ~F.col("corpus").isin(known) | F.col("corpus").isin(allowed)) if allowed else pool


def rerank(pool: DataFrame, scored: Column, number: str | None = None) -> DataFrame:
    """Sorted by a new score; for a document filter its own family comes first, or else overview rows where it has none. One hit stays as it is."""
    p = pool.withColumn("_n", F.count(F.lit(1)).over(per_query())).withColumn("rerank", F.when(F.col("_n") > 1, scored).otherwise(F.col("rerank"))).drop("_n")
    if number is None:
        return by_rerank(p)
    own, head = F.coalesce(F.col("family") == number, F.lit(False)), F.coalesce("anchor", F.lit("")).isin("overview", "")
    p = p.withColumn("_pin", F.when(F.count_if(own).over(per_query()) > 0, own).otherwise(head))
    return placed(p, F.desc("_pin"), F.col("rerank").desc_nulls_last()).drop("_pin")


def unseen(pool: DataFrame, lane: DataFrame, keep: int | None, share: float = 1.0) -> DataFrame:
    """The pool and, after it, the first hits of a lane that it has not, with a share of their score: hyde, federation, sub-queries, owners' files, full-text hits."""
    new = lane.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.withColumn("_i", F.row_number().over(per_query().orderBy("pos")))
    new = new if keep is None else new.where(F.col("_i") <= keep)
    last = pool.groupBy("query_id").agg(F.max("pos").alias("_last"))
    new = new.join(last, "query_id", "left").withColumn("pos", F.coalesce("_last", F.lit(0)) + F.col("_i")).withColumn("score", F.col("score") * share)
    return pool.unionByName(new.select(*pool.columns))


def fuse(lanes: list[DataFrame], keep: int) -> DataFrame:
    """Reciprocal rank fusion of lanes (the first is primary): in order of the fused score; each hit keeps the row of its first lane, with its score."""
    every = reduce(DataFrame.unionByName, (x.withColumn("_lane", F.lit(k)) for k, x in enumerate(lanes)))
    names = [c for c in lanes[0].columns if c not in ("query_id", "id", "pos")]
    got = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("pos"))), 12).alias("_f"), F.min(F.struct("_lane", "pos", *names)).alias("x"))
    got = got.withColumn("pos", F.row_number().over(per_query().orderBy(F.desc("_f"), "x._lane", "x.pos"))).where(F.col("pos") <= keep)
    return got.select("query_id", "id", "pos", *[F.col(f"x.{c}").alias(c) for c in names]).select(*lanes[0].columns)


def diversity(pool: DataFrame, scoped: bool = False, keep: int = KEEP) -> DataFrame:
    """Few hits of one document and language, and few overviews, taken in order.

    A document's counter is shared by its overviews (one at most) and clauses (two, or
    three where a document is asked for), so the rule is a fold over the ordered pool.
    It ends at keep + 2 accepted hits, of which keep stay.
    """
    cap, most = (3, 6) if scoped else (2, 2)
    key = F.concat_ws("|", F.coalesce("doc", F.lit("")).cast("string"), F.coalesce("lang", F.lit("")))
    row = F.struct("pos", "id", key.alias("key"), (F.coalesce("anchor", F.lit("")) == "overview").alias("over"))
    hits = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))

    def step(kept: Column, h: Column) -> Column:
        same, overs = F.size(F.filter(kept, lambda k: k["key"] == h["key"])), F.size(F.filter(kept, lambda k: k["over"]))
        room = (F.size(kept) < keep + 2) & (same < F.when(h["over"], 1).otherwise(cap)) & ~(h["over"] & (overs >= most))
        return F.when(room, F.array_append(kept, h)).otherwise(kept)

    start = F.slice("hits", 1, 0)
    kept = hits.select("query_id", F.posexplode(F.slice(F.aggregate("hits", start, step), 1, keep)).alias("_i", "h"))
    kept = kept.select("query_id", F.col("h.id").alias("id"), F.col("h.pos").alias("pos"), (F.col("_i") + 1).alias("_new"))
    return pool.join(kept, ["query_id", "id", "pos"]).withColumn("pos", F.col("_new")).select(*pool.columns)


def chain_dedup(pool: DataFrame) -> DataFrame:
    """Of a clause and its ancestor in the pool with half their words in common, the weaker goes; pairs are judged in pool order, and a dropped hit drops no other."""
    words = F.array_distinct(F.filter(F.split(F.substring(F.lower(F.regexp_replace("text", r"\s+", " ")), 1, 600), "[^a-z0-9°%]+"), lambda w: F.char_length(w) > 3))
    row = F.struct("pos", "id", "doc", "anchor", points().alias("s"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    hits = pool.where(F.col("anchor").rlike(r"^\d+(\.\d+)*$")).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))

    def chained(a: Column, b: Column) -> Column:
        return b["anchor"].startswith(F.concat(a["anchor"], F.lit("."))) | a["anchor"].startswith(F.concat(b["anchor"], F.lit(".")))

    def alike(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a["w"], b["w"]))
        return (both > 0) & (2 * both >= F.size(a["w"]) + F.size(b["w"]) - both)

    def outer(gone: Column, a: Column) -> Column:
        def inner(g: Column, b: Column) -> Column:
            judged = ~F.array_contains(gone, a["pos"]) & ~F.array_contains(g, b["pos"]) & (b["pos"] > a["pos"]) & (a["doc"] == b["doc"])
            return F.when(judged & chained(a, b) & alike(a, b), F.array_append(g, F.when(a["s"] >= b["s"], b["pos"]).otherwise(a["pos"]))).otherwise(g)

        return F.aggregate("hits", gone, inner)

    gone = hits.select("query_id", F.explode(F.aggregate("hits", F.array().cast("array<int>"), outer)).alias("pos")).distinct()
    return pool.join(gone, ["query_id", "pos"], "left_anti").select(*pool.columns)


def position_order(pool: DataFrame) -> DataFrame:
    """Documents by their best hit; within one its overview and family notes, then clauses in the order of their anchors, others last. Pools of under 3 hits stay."""
    numeric = F.col("anchor").rlike(r"^\d+(\.\d+)*$")
    path = F.when(numeric, F.transform(F.split("anchor", r"\."), lambda x: x.cast("int")))
    p = pool.withColumns({"_n": F.count(F.lit(1)).over(per_query()), "_best": F.min("pos").over(Window.partitionBy("query_id", "doc"))})
    small, head = F.col("_n") < 3, F.coalesce("anchor", F.lit("")).isin("overview", "family")
    off = lambda c: F.when(~small, c)
    return placed(p, off(F.col("_best")), off(head).desc(), off(path).asc_nulls_last()).drop("_n", "_best")


def figure_seat(pool: DataFrame, figures: DataFrame, seats: int = 3) -> DataFrame:
    """The first figures of the document that is most frequent in the pool's first five hits, after the pool; ties go to the first document."""
    top = pool.where(F.col("pos") <= 5).groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p"))
    top = top.groupBy("query_id").agg(F.max(F.struct("c", (-F.col("p")).alias("p"), "doc")).alias("x")).select("query_id", F.col("x.doc").alias("doc"))
    return unseen(pool, figures.join(top, ["query_id", "doc"], "left_semi"), seats)


def cover(pool: DataFrame, lane: DataFrame, covered: Column, keep: int = 1) -> DataFrame:
    """Pools without a hit for which `covered` holds take the lane's first hits: a licensed unit, or an active edition."""
    bare = pool.groupBy("query_id").agg(F.bool_or(F.coalesce(covered, F.lit(False))).alias("c")).where("NOT c").select("query_id")
    return unseen(pool, lane.join(bare, "query_id", "left_semi"), keep)


def citation_probe(pool: DataFrame, lane: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The asked document's passages of references, the first of the lane, behind the pool with a fixed score; licences hold for them too."""
    near = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    first = lane.withColumn("_i", F.row_number().over(per_query().orderBy("pos"))).where(F.col("_i") <= PROBES).drop("_i")
    return unseen(pool, license_scope(first.where(near.rlike(BIBLIOGRAPHY)), keys).withColumn("score", F.lit(PROBE_SCORE)), PROBES)


def typed_pin(pool: DataFrame, hits: DataFrame, clauses: DataFrame, families: list[str], hard: bool = True, keep: int = KEEP) -> DataFrame:
    """The typed unit of the asked families that answers best takes the pool's last seat; then comes its clause.

    `hits` are all hits, with block (figure, table, formula) and asked, the question. A
    unit counts the question's words that it has, a bonus where its block is asked for
    or it stands in the clause of the first hit in prose, and the share of filled cells.
    Without a hard scope a unit that is no table needs three of the words. `clauses` is
    the lane of clause passages. The three are put together once by query, see pin_among.
    """
    more = [c for c in ("block", "asked", "family", "title", "text") if c not in pool.columns]
    of = lambda df, k: df.select(*pool.columns, *(F.col(c) if c in df.columns else F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in more), *(F.lit(k == n).alias(n) for n in ("in_pool", "in_hits", "in_clauses")))
    rows = of(pool, "in_pool").unionByName(of(hits, "in_hits")).unionByName(of(clauses, "in_clauses")).repartition("query_id")
    return pin_among(rows, families, hard, keep).select(*pool.columns)


def pin_among(rows: DataFrame, families: list[str], hard: bool = True, keep: int = KEEP) -> DataFrame:
    """The pool of typed_pin out of rows that hold pool, hits and clauses: in_pool, in_hits and in_clauses tell for which of them a row counts, one or several.

    All windows are over a query's rows in no order, so that these are sorted by query once, or not at all where they are already.
    """
    low, bare = F.lower("asked"), F.coalesce("unit_id", F.lit("")) == ""
    terms = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda t: F.char_length(t) > 2)
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    cells = F.split(F.coalesce("text", F.lit("")), r"\|")
    filled = F.size(F.filter(cells, lambda c: F.trim(c) != "")) / F.size(cells)
    asks = reduce(lambda a, b: a | b, ((F.col("block") == name) & low.rlike(pattern) for name, pattern in ASKS_BLOCK.items()))
    hit, sure = F.col("in_hits"), lambda c: F.coalesce(c, F.lit(False))
    one = lambda c: F.max(c).over(per_query())
    at = lambda x: sure((F.col("pos") == x["pos"]) & F.col("id").eqNullSafe(x["id"]))
    prose = F.min(F.when(hit & bare, F.struct("pos", F.coalesce("anchor", F.lit("")).alias("anchor")))).over(per_query())["anchor"]
    unit = sure(hit & ~bare & F.col("block").isNotNull() & F.col("family").isin(families))
    r = rows.withColumn("_near", (F.col("anchor") == prose) & (prose != "")).withColumns({"_n": F.when(unit, F.size(terms)), "_o": F.when(unit, F.size(F.filter(terms, lambda t: F.contains(hay, t))))})
    bonus = F.when(sure(asks), 2 * F.col("_n")).when(sure(F.col("_near")), F.col("_n")).otherwise(0)
    best = one(F.when(unit, F.struct((F.col("_o") + bonus + 2 * filled).alias("s"), (-F.col("pos")).alias("p"), "pos", "id", "doc", "anchor", F.col("_o").alias("o"), "block")))
    r = r.withColumns({"_unit": unit, "_b": best})
    passes = F.lit(hard) | (F.col("_b.o") >= GATE) | (F.col("_b.block") == "table")
    r = r.withColumn("_b", F.when(sure(passes & F.col("query_id").isNotNull()), F.col("_b"))).drop("_near", "_n", "_o")
    r = r.withColumn("_new", sure(F.col("_b").isNotNull() & ~one(sure(F.col("in_pool") & (F.col("id") == F.col("_b.id"))))))
    r = r.withColumn("_kept", F.col("in_pool") & sure(~F.col("_new") | (F.col("pos") <= keep - 1)))
    there = sure((F.col("doc") == F.col("_b.doc")) & (F.col("anchor") == F.col("_b.anchor"))) & bare
    ids = F.collect_list(F.when(F.col("_kept"), F.col("id"))).over(per_query())
    r = r.withColumns({"_last": F.coalesce(one(F.when(F.col("_kept"), F.col("pos"))), F.lit(0)), "_bare": one(F.col("_kept") & there), "_ids": ids})
    seen = sure(F.array_contains("_ids", F.col("id"))) | sure(F.col("id") == F.col("_b.id"))
    r = r.withColumn("_clause", F.col("in_clauses") & F.col("_new") & sure(F.col("_b.anchor") != "") & there & ~F.col("_bare") & ~seen).drop("_ids")
    r = r.withColumn("_parent", F.col("_clause") & at(F.min(F.when(F.col("_clause"), F.struct("pos", "id"))).over(per_query())))
    r = r.withColumn("_best", F.col("_unit") & F.col("_new") & at(F.col("_b")))
    r = r.where(F.col("_kept") | F.col("_best") | F.col("_parent"))
    place = F.when(F.col("_kept"), F.col("pos")).when(F.col("_best"), F.col("_last") + 1).otherwise(F.col("_last") + 2)
    score = F.when(F.col("_parent"), F.col("score") * PARENT).otherwise(F.col("score"))
    return r.withColumns({"pos": place.cast(rows.schema["pos"].dataType), "score": score}).select(*(c for c in rows.columns if c not in ("in_pool", "in_hits", "in_clauses")))


def section_descent(pool: DataFrame, clauses: DataFrame) -> DataFrame:
    """The first hit that summarises a section gives way to the first two of its clauses that the pool has not, behind the pool.

    Pools have section_summary ('1') and child_anchors (separated by commas); the first
    25 anchors count, and the first three clauses of the lane that stand at one. A
    summary without such a clause stays.
    """
    anchors = F.slice(F.filter(F.transform(F.split("child_anchors", ","), lambda a: F.trim(a)), lambda a: a != ""), 1, CHILDREN)
    heads = pool.where((F.col("section_summary") == "1") & (F.col("child_anchors") != "") & (F.col("score") > 0))
    heads = heads.withColumn("_i", F.row_number().over(per_query().orderBy("pos"))).where("_i = 1").select("query_id", "doc", F.col("id").alias("_head"), anchors.alias("_anchors"))
    kids = heads.select("query_id", "doc", F.explode(F.array_distinct("_anchors")).alias("anchor"))
    got = clauses.join(kids, ["query_id", "doc", "anchor"], "left_semi").withColumn("_i", F.row_number().over(per_query().orderBy("pos"))).where(F.col("_i") <= DESCENDED + 1)
    got = got.where(F.coalesce("section_summary", F.lit("")) == "").drop("_i").join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    gone = heads.join(got, "query_id", "left_semi").select("query_id", F.col("_head").alias("id"))
    return placed(unseen(pool, got, DESCENDED, CHILD).join(gone, ["query_id", "id"], "left_anti")).select(*pool.columns)


#: In the order in which they run, whatever the order they are asked for in.
STAGES: dict[str, Callable[..., DataFrame]] = {
    "hyde": lambda pool, lane: unseen(pool, lane, 10, 0.7),
    "multi-query": lambda pool, lanes: fuse([pool, *lanes], 50),
    "sub-query": lambda pool, lane: unseen(pool, lane, 8, 0.8),
    "lexical-union": lambda pool, lane: unseen(pool, lane, 40),
    "federate": lambda pool, lane: unseen(pool, lane, None, 0.95),
    "user-lane": lambda pool, lane, owner: unseen(pool, lane.where(F.col("owner") == owner).drop("owner"), 3),
    "seal": seal, "license-scope": license_scope, "overview-demote": overview_demote, "family-boost": family_boost, "rerank": rerank,
    "lexical-rrf": lambda pool, lane: fuse([pool, lane], 50), "citation-probe": citation_probe,
    "corpus-scope": corpus_scope, "edition-cover": cover, "std-ref-nudge": std_ref_nudge, "term-nudge": term_nudge, "concept-steer": concept_steer,
    "edition-steer": edition_steer, "structural-propagate": structural_propagate, "diversity": diversity, "licensed-cover": cover,
    "typed-pin": typed_pin, "section-descent": section_descent, "dedup": chain_dedup, "figure-seat": figure_seat, "window-floor": window_floor,
}


def run_stages(pool: DataFrame, asked: dict[str, dict]) -> DataFrame:
    """The asked stages (name to options), the lanes that fill the pool first, in the order of the registry; an unknown name is an error."""
    from clauseq.operators.lanes import LANES

    every = {"dense": LANES["dense"], "hyde": STAGES["hyde"]} | LANES | STAGES
    if unknown := sorted(set(asked) - set(every)):
        raise ValueError(f"unknown stages: {', '.join(unknown)}; known: {', '.join(every)}")
    for name, stage in every.items():
        if name in asked:
            pool = stage(pool, **asked[name])
    return pool
