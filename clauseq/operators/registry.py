"""Registry, manifest and join patterns that several queries share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], by: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its greatest row by `by` (nulls are least); one grouping, no window."""
    top = F.max(F.struct(*by, *[F.col(v).alias(f"_{v}") for v in values])).alias("x")
    return rows.groupBy(*key).agg(top).select(*key, *[F.col(f"x._{v}").alias(v) for v in values])


def first_wins(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The least row of each key by `by`: its key and `by` columns."""
    return rows.groupBy(*key).agg(F.min(F.struct(*by)).alias("x")).select(*key, "x.*")


def last_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """The sources united; where several have a key, the last one's row stays (of its own rows the greatest)."""
    tagged = [s.withColumn("_k", F.lit(k)) for k, s in enumerate(sources)]
    names = [c for c in sources[0].columns if c != key]
    united = reduce(DataFrame.unionByName, tagged)
    return united.groupBy(key).agg(F.max(F.struct("_k", *names)).alias("x")).select(key, *[f"x.{c}" for c in names])


def stale(index: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return index.join(current.select(key), key, "left_anti")


def bands(rows: DataFrame, value: str, of: list[tuple[str, float, float]]) -> DataFrame:
    """Rows with each band (kind, centre, tolerance) that holds their value, and the gap to its centre. Bands are a literal list, so no join is needed."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("centre"), F.lit(t).alias("tol")) for k, c, t in of))
    hit = F.filter(every, lambda b: F.abs(F.col(value) - b["centre"]) <= b["tol"])
    return rows.withColumn("_b", F.explode(hit)).withColumn("kind", F.col("_b.kind")).withColumn("gap", F.abs(F.col(value) - F.col("_b.centre"))).drop("_b")


def ancestors(rows: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of rows (structs ancestor, descendant) whose dotted `anchor`s are a proper prefix of one another.

    A descendant names its ancestors, so the join is on equal anchors and not on a prefix condition.
    """
    names = [c for c in rows.columns if c not in within]
    parts = F.split("anchor", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = rows.where(F.size(parts) > 1).select(*within, F.explode(up).alias("_up"), F.struct(*names).alias("descendant"))
    above = rows.select(*within, F.col("anchor").alias("_up"), F.struct(*names).alias("ancestor"))
    return above.join(below, [*within, "_up"]).drop("_up")


def edition_of(asked: DataFrame, editions: DataFrame, family: list[str], want: str, key: str) -> DataFrame:
    """For each asked row the edition of the wanted year, else an active one, else the newest; ties go to the greatest key."""
    best = F.max(F.struct((F.col("edition") == F.col(want)).alias("exact"), "active", "edition", F.col(key).alias("key"))).alias("x")
    return asked.join(editions, family).groupBy(*asked.columns).agg(best).select(*asked.columns, F.col("x.key").alias(key))


def cascade(rows: DataFrame, known: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """rows with the value of the first of their keys that `known` (ident, value) has."""
    out = rows
    for k, key in enumerate(keys):
        out = out.join(known.select(F.col("ident").alias(key), F.col(value).alias(f"_{k}")), key, "left")
    return out.select(*rows.columns, F.coalesce(*(f"_{k}" for k in range(len(keys))), F.lit(default)).alias(value))


def since(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """The rows of the last `days` days up to the newest row; that day is one row, read apart and broadcast."""
    last = rows.agg(F.max(F.to_date(ts)).alias("_last"))
    return rows.join(F.broadcast(last), F.to_date(ts) > F.date_sub("_last", days)).drop("_last")


def manifest(rows: DataFrame, key: str, text: str) -> DataFrame:
    hashes = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_list(hashes)).alias("h"))
    return got.select(key, "chunks", F.sha2(F.array_join("h", "").cast("binary"), 256).alias("manifest"))


def notes(rows: DataFrame, key: str, label: str, by: list[Column], cap: int) -> DataFrame:
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("_i") <= cap)
    got = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", label))).alias("x"))
    return got.select(key, F.array_join(F.col("x").getField(label), "; ").alias("note"))


def assemble(rows: DataFrame, key: str, order: list[str], text: str, cap: int) -> DataFrame:
    """A document's units in order until the first overflow of `cap` characters: kept, truncated, and the hash of the text.

    The running sum never falls, so the units that fit are those before the first overflow.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("_fits", F.sum(F.char_length(text)).over(w) <= cap)
    parts = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(*order, F.col(text).alias("_t")))))
    got = t.groupBy(key).agg(F.count_if("_fits").alias("kept"), F.bool_or(~F.col("_fits")).alias("truncated"), parts.alias("x"))
    return got.select(key, "kept", "truncated", F.md5(F.array_join("x._t", "\n").cast("binary")).alias("body"))


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends both are nodes (id)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Each id of either side as new, gone, changed or same, by the hash of its text."""
    a, b = (x.select(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias(h)) for x, h in ((old, "_a"), (new, "_b")))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, state.alias("state"))


#: Fixed values of a register search: words that say nothing there, tokens of a question, rows of an answer.
REGISTER_STOP = """the a an is are was were still currently in on for of and or certificate certificates certified certification register status valid suspended
revoked recommendation per under by with what which who does do load cell model manufacturer holder company r how to list show
many issued issue latest newest recent total number""".split()
REGISTER_TOKENS, REGISTER_ROWS = 12, 6


def register_tokens(question: Column) -> Column:
    """The first distinct words and numbers of two signs or more that are no stop words; years behind a document's number go."""
    bare = F.regexp_replace(question, r"(?i)\b([RDMB]\s?-?\d{2,3}(?:-\d+)?)\s?:\s?\d{4}\b", "$1")
    words = F.filter(F.split(bare, "[^A-Za-z0-9&-]+"), lambda w: (F.char_length(w) >= 2) & ~F.lower(w).isin(REGISTER_STOP))
    return F.slice(F.array_distinct(words), 1, REGISTER_TOKENS)


def starts_of(text: Column, n: int) -> Column:
    """Every n signs of a text: one of them begins whatever of n signs or more it contains."""
    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Rows that a task holds before it hands them on.
HELD = 1 << 16


def first_of_each(rows: DataFrame, keep: int) -> DataFrame:
    """rows (query_id, score, year, num) without those that `keep` others of their task and query precede: by score and year from above, then num. A task holds its best so far, not its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch])
            both = both if best is None else pa.concat_tables([best, both])
            table = both.append_column("_some", pc.is_valid(both["num"]))
            by = [("query_id", "ascending"), ("score", "descending"), ("year", "descending"), ("_some", "ascending"), ("num", "ascending")]
            order = pc.sort_indices(table, sort_keys=by, null_placement="at_end")
            codes = pc.dictionary_encode(both["query_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()[order.to_numpy()]
            heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
            nth = np.arange(len(codes)) - np.repeat(heads, np.diff(np.r_[heads, len(codes)]))
            best = both.take(order.filter(pa.array(nth < keep)))
            if best.num_rows > HELD:
                yield from best.to_batches()
                best = None
        if best is not None:
            yield from best.to_batches()

    return rows.mapInArrow(run, rows.schema)


def register_search(asked: DataFrame, register: DataFrame) -> DataFrame:
    """asked (query_id, text) and register (num, holder, model, year): query_id, place, num, score of the best six rows.

    A number must stand alone in a row's model, or be its model or num; a word may stand
    anywhere in holder, model or num. Rows are ordered by their matches (a number in the
    model 3, a word in it 2, else the holder 1), then by year and num. Tokens meet rows by
    equal numbers, or by the token's first three signs (two, if it has no more), which a
    row that has the token must have: no pair is made that shares nothing.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[-,.]", " "), F.lit(" "))
    alone = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    q = asked.where("query_id IS NOT NULL").select("query_id", F.transform(register_tokens(F.col("text")), lambda t: F.lower(t)).alias("tokens"))
    t = q.select("query_id", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    t = t.withColumn("number", F.col("token").rlike("^[0-9]+$")).withColumn("key", F.when(F.col("number"), F.col("token")).otherwise(F.substring("token", 1, 3)))
    r = register.select("num", "year", *(F.coalesce(c, F.lit("")).alias(c) for c in ("holder", "model"))).distinct().withColumn("_num", F.coalesce(F.col("num").cast("string"), F.lit("")))
    fields = F.transform(F.array("holder", "model", "_num"), lambda c: F.lower(c))
    starts = lambda n: F.flatten(F.transform(fields, lambda f: starts_of(f, n)))
    r = r.withColumn("_words", F.array_union(F.filter(F.split(spaced("model"), " "), lambda w: w.rlike("^[0-9]+$")), F.array(F.lower("model"), F.lower("_num"))))
    entry = lambda keys, number: F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.lit(number).alias("number")))
    index = r.select("*", F.explode(F.concat(entry(F.col("_words"), True), entry(F.concat(starts(3), starts(2)), False))).alias("_k")).select(*r.columns, "_k.*")

    def has(token: Column) -> Column:
        inside = F.contains(F.lower("holder"), token) | F.contains(F.lower("model"), token) | F.contains(F.lower("_num"), token)
        return F.when(token.rlike("^[0-9]+$"), F.array_contains("_words", token)).otherwise(inside)

    # A row meets a question once for each token that it has; the first of these counts, so that no pair need be gathered to be known.
    pairs = t.join(index, ["key", "number"]).where(has(F.col("token"))).where(F.col("token") == F.get(F.filter("tokens", has), F.lit(0)))

    def worth(token: Column) -> Column:
        number = token.rlike("^[0-9]+$")
        inside = F.when(number, F.contains(alone("model"), F.concat(F.lit(" "), token, F.lit(" ")))).otherwise(F.contains(F.lower("model"), token))
        return F.when(inside, F.when(number, 3).otherwise(2)).when(F.contains(F.lower("holder"), token), 1).otherwise(0)

    score = F.aggregate(F.transform("tokens", worth), F.lit(0), lambda a, b: a + b)
    pairs = first_of_each(pairs.select("query_id", score.alias("score"), "year", "num"), REGISTER_ROWS)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("year"), "num")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= REGISTER_ROWS).select("query_id", "place", "num", "score")
