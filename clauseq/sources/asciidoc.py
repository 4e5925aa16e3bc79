"""Headers and sections of AsciiDoc texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(text: Column) -> Column:
    """The first line that is a level-0 title, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^= (.+)$", 1)), F.lit(""))


def attributes(text: Column) -> Column:
    """The header's `:key: value` lines as a map, keys lower-cased; of a repeated key the last value counts."""
    lines = F.filter(F.split(F.element_at(F.split(text, "\n\n", 2), 1), "\n"), lambda s: s.rlike(r"^:[^:\s]+:"))
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, "^:([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(s, "^:[^:]+:(.*)$", 1)).alias("v")))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, last))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per `== ` section: key, pos (1-based), title, body. What stands before the first is no section."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n==[ \t]+"), 2, 1_000_000)
    rows = docs.select(key, F.posexplode(parts).alias("pos", "part"))
    return rows.select(key, (F.col("pos") + 1).alias("pos"), F.trim(F.element_at(F.split("part", "\n", 2), 1)).alias("title"), F.trim(F.coalesce(F.get(F.split("part", "\n", 2), F.lit(1)), F.lit(""))).alias("body"))


def tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per table row between `|===` lines: key, nth table, nth row, cells."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)\|===[ \t]*\n(.*?)\n\|==="), 1)
    t = docs.select(key, F.posexplode(blocks).alias("nth", "block"))
    rows = t.select(key, "nth", F.posexplode(F.filter(F.split("block", "\n"), lambda s: s.startswith("|"))).alias("row", "line"))
    return rows.select(key, "nth", "row", F.transform(F.slice(F.split("line", r"\|"), 2, 1_000_000), lambda c: F.trim(c)).alias("cells"))
