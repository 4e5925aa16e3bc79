"""Chunks of documents: greedy packing of paragraphs, extractive compression, tables by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_long(text: Column, most: int = 2800) -> Column:
    """Parts of at most `most` characters: paragraphs (split at blank lines) packed in order with a separator of two characters; a longer paragraph is cut.

    A fold over one text's paragraphs: the state is the list of parts.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most)))
    pieces = F.flatten(F.transform(paragraphs, cut))

    def add(parts: Column, p: Column) -> Column:
        last = F.element_at(parts, -1)
        fits = (F.size(parts) > 0) & (F.char_length(last) + 2 + F.char_length(p) <= most)
        return F.when(fits, F.array_append(F.slice(parts, 1, F.size(parts) - 1), F.concat(last, F.lit("\n\n"), p))).otherwise(F.array_append(parts, p))

    # try_element_at keeps the first step, on an empty list, from failing.
    def safe(parts: Column, p: Column) -> Column:
        return F.when(F.size(parts) == 0, F.array(p)).otherwise(add(parts, p))

    return F.aggregate(pieces, F.array().cast("array<string>"), safe)


def chunk_documents(docs: DataFrame, key: str, title: str, text: str, most: int = 2800) -> DataFrame:
    """One row per chunk: key, part (0-based), chunk_id (key, with #part after the first), body under a header with the title."""
    parts = docs.select(key, F.col(title).alias("_t"), F.posexplode(split_long(F.coalesce(text, F.lit("")), most)).alias("part", "body"))
    name = F.concat(F.col(key).cast("string"), F.when(F.col("part") > 0, F.concat(F.lit("#"), "part")).otherwise(""))
    return parts.select(key, "part", name.alias("chunk_id"), F.concat_ws("\n", "_t", "body").alias("body"))


def compress(text: Column, terms: Column, budget: int) -> Column:
    """The text's sentences that say most about the terms, within a budget of characters, in reading order; the first always stays.

    A sentence's worth is the terms it has over the root of its words, and 0.35 if it has a digit. The best are taken first, each if it still fits.
    """
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")

    def worth(s: Column, i: Column) -> Column:
        words = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: w != "")
        value = F.size(F.array_intersect(words, terms)) / F.sqrt(F.greatest(F.size(words), F.lit(1))) + F.when(s.rlike("[0-9]"), 0.35).otherwise(0.0)
        return F.struct(F.when(i == 0, -1e9).otherwise(-F.round(value, 9)).alias("v"), i.alias("i"), s.alias("s"))

    ranked = F.array_sort(F.transform(sentences, worth))
    none = F.struct(F.lit(0).alias("used"), F.slice(ranked, 1, 0).alias("kept"))

    def take(state: Column, s: Column) -> Column:
        need = state["used"] + F.char_length(s["s"])
        room = (need <= budget) | (s["i"] == 0)
        return F.when(room, F.struct(need.alias("used"), F.array_append(state["kept"], s).alias("kept"))).otherwise(state)

    kept = F.aggregate(ranked, none, take)["kept"]
    return F.array_join(F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["s"].alias("s")))), lambda s: s["s"]), " ")
