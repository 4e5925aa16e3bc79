"""Families of publications from their editions, and the passages that tell of a family and of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseq.functions.text import normalize_identifier

#: Sections that an overview quotes, how many, and how much of each.
OPENING = ("scope", "introduction", "foreword", "abstract", "field of application")
QUOTED, QUOTE = 3, 900


def _short(title: Column) -> Column:
    return F.when(F.contains(title, F.lit("—")), F.trim(F.split(title, "—")[0])).otherwise(title)


def identities(docs: DataFrame, prefix: str) -> DataFrame:
    """doctype, number, identity, title, first, part: the publications of each family, for each the title of its best edition.

    docs: place (their order), identifier, doctype, number, edition, language, title,
    corpus. Best is a curated one, then the newest edition, then an English one; of
    equals the first stays. `first` is the place where the identity comes up first. A part has
    a number behind the family's name; other names but the family's own are annexes (part false), its own has null.
    """
    base = F.concat(F.lit(f"{prefix} "), "doctype", F.lit(" "), "number")
    edition = F.trim(F.coalesce("edition", F.lit("")))
    rank = F.struct((F.col("corpus") == "clean").alias("curated"), F.when(edition.rlike("^[0-9]+$"), edition).otherwise("0000").alias("edition"), (F.col("language") == "en").alias("english"), (-F.col("place")).alias("p"))
    known = docs.where((F.coalesce("doctype", F.lit("")) != "") & (F.coalesce("number", F.lit("")) != ""))
    identity = normalize_identifier(F.coalesce(F.nullif("identifier", F.lit("")), base))
    of = known.select("doctype", "number", identity.alias("identity"), _short(F.coalesce("title", F.lit(""))).alias("title"), rank.alias("rank"), "place", base.alias("base"))
    best = of.groupBy("doctype", "number", "base", "identity").agg(F.max_by("title", "rank").alias("title"), F.min("place").alias("first"))
    suffix = F.trim(F.regexp_replace(F.expr("substring(identity, length(base) + 1)"), "^-+", ""))
    part = F.when(F.col("identity") != F.col("base"), suffix.rlike("^[0-9]"))
    return best.select("doctype", "number", "base", "identity", "title", "first", part.alias("part"))


def family_notes(docs: DataFrame, prefix: str) -> DataFrame:
    """doctype, number, base, parts, annexes, text: a passage for each family of two identities or more, in the order in which they come up."""
    found = identities(docs, prefix)
    line = F.struct("first", F.concat(F.lit("- "), "identity", F.lit(" — "), "title").alias("line"))
    # As many lines as a publication has parts and annexes.
    per = found.groupBy("doctype", "number", "base").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("part").alias("parts"), F.count_if(~F.col("part")).alias("annexes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), line))), lambda x: x["line"]).alias("lines"),
    ).where("n >= 2")
    base = F.concat(F.lit(f"{prefix} "), "doctype", F.lit(" "), "number")
    own = docs.withColumn("base", base).withColumn("_own", normalize_identifier(F.coalesce("identifier", F.lit(""))) == F.col("base"))
    head = F.max_by("title", F.struct("_own", (F.col("_own") & (F.col("corpus") == "clean")).alias("c"), (-F.col("place")).alias("p")))
    title = own.groupBy("doctype", "number").agg(head.alias("title"))
    many = lambda n, word, end: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, end).otherwise(""))
    what = F.concat(many(F.col("parts"), "part", "s"), F.when(F.col("annexes") > 0, F.concat(F.lit(" and "), many(F.col("annexes"), "annex", "es"))).otherwise(""))
    text = F.concat(
        F.trim(F.split("title", "—")[0]), F.lit(" ("), "base", F.lit(f") is a multi-part {prefix} publication. It comprises "), what, F.lit(":\n"), F.array_join("lines", "\n"),
        F.lit("\n\n"), "base", F.lit(" has "), what, F.lit(" ("), (F.col("parts") + F.col("annexes")).cast("string"), F.lit(" components total)."),
    )
    return per.join(title, ["doctype", "number"]).select("doctype", "number", "base", "parts", "annexes", text.alias("text"))


def overviews(docs: DataFrame, sections: DataFrame, prefix: str, kinds: dict[str, str], text: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, text: a passage for each document (place, doc_id, and the columns of identities) that says what it is.

    It has the title and name, the kind of its series (kinds: letter to name), the first three of its sections
    (doc_id, pos, title, text) that open a document, and its family's members, if it has any. Of a text no more is moved than is
    quoted; one that can be made of a section's title needs no column, but `text`, which makes it of the title where it is quoted.
    """
    rest = [F.left("text", F.lit(QUOTE)).alias("text")] if text is None else []
    opening = sections.where(F.lower("title").rlike(f"^({'|'.join(OPENING)})")).select("doc_id", "pos", "title", *rest)
    opening = opening.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("_i") <= QUOTED)
    quoted = opening.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_i", "title", *(["text"] if text is None else [])))).alias("quoted"))
    member = F.struct("first", F.concat("identity", F.lit(" — "), "title").alias("m"))
    family = identities(docs, prefix).groupBy("doctype", "number").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(member)), lambda x: F.concat(F.lit("- "), x["m"])).alias("members")).where("n >= 2")
    # Families first: few, and joined with many documents each, they would have the quotations gathered by family.
    j = docs.join(family, ["doctype", "number"], "left").join(quoted, "doc_id", "left")
    said = lambda x: F.concat(x["title"], F.lit(": "), x["text"] if text is None else F.left(text(x["title"]), F.lit(QUOTE)))
    name = F.coalesce(F.nullif("identifier", F.lit("")), F.concat(F.lit(f"{prefix} "), "doctype", F.lit(" "), "number"))
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("doctype")]
    first = F.array(F.concat("title", F.lit(" — "), name, F.lit(" ("), "language", F.lit(").")), F.concat(F.lit(f"An {prefix} "), kind, F.lit(".")))
    tail = F.array(F.concat(F.lit("Document family — "), "identifier", F.lit(" comprises:\n"), F.array_join("members", "\n")))
    parts = F.array_compact(F.concat(first, F.coalesce(F.transform("quoted", said), F.array().cast("array<string>")), tail))
    return j.select("doc_id", F.array_join(parts, "\n\n").alias("text"))
