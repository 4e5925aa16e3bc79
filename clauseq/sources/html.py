"""Sections and tables of HTML texts, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markup whose text nobody reads. The patterns are of the kind that Spark and DuckDB read alike.
HIDDEN = r"(?is)<script[ >].*?</script>|<style[ >].*?</style>|<nav[ >].*?</nav>|<!--.*?-->"
HEADING, HEADING_END = r"(?i)<h[2-5](?:\s[^>]*)?>", r"(?i)</h[2-5]>"
TABLE, ROW, CELL = r"(?is)<table[ >].*?</table>", r"(?is)<tr[ >].*?</tr>", r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>"
BLOCK = r"(?is)<table[ >].*?</table>|<pre[ >].*?</pre>|<li[ >].*?(?:</li>|\z)|<p[ >].*?(?:</p>|\z)"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
NUMBER = r"^([0-9]+(?:\.[0-9]+)*)\.?\s"


def plain(html: Column) -> Column:
    """What a reader sees: no tags, the common entities as signs, single spaces."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _cells(row: Column) -> Column:
    return F.filter(F.transform(_all(row, CELL, 1), plain), lambda c: c != "")


def _parts(docs: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, title, anchor, rest: what follows each heading of level 2 to 5, and what stands before the first (pos 0, no title)."""
    rows = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), HEADING)).alias("pos", "part"))
    halves = F.split("part", HEADING_END, 2)
    rows = rows.select(key, "pos", F.when(F.col("pos") > 0, plain(F.get(halves, F.lit(0)))).otherwise("").alias("title"), F.when(F.col("pos") > 0, F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).otherwise(F.col("part")).alias("rest"))
    return rows.select(key, "pos", "title", F.regexp_extract(F.concat("title", F.lit(" ")), NUMBER, 1).alias("anchor"), "rest")


def sections(docs: DataFrame, key: str, html: str, boilerplate: str | None = None) -> DataFrame:
    """One row per section with text: key, pos, anchor (the heading's number), title, body.

    The body has a line for each paragraph, list item, preformatted text and table row.
    Paragraphs that match `boilerplate` are left out. A paragraph that is never closed runs to the
    next end of one, or of its section. A null text has no section.
    """

    def line(block: Column) -> Column:
        rows = F.filter(F.transform(_all(block, ROW), lambda r: F.array_join(_cells(r), " | ")), lambda r: r != "")
        text = plain(block)
        item = F.when(text != "", F.concat(F.lit("- "), text)).otherwise("")
        para = F.when(text.rlike(boilerplate), "").otherwise(text) if boilerplate else text
        return F.when(block.rlike("(?i)^<table"), F.array_join(rows, "\n")).when(block.rlike("(?i)^<li"), item).when(block.rlike("(?i)^<pre"), text).otherwise(para)

    body = F.array_join(F.filter(F.transform(_all(F.col("rest"), BLOCK), line), lambda x: x != ""), "\n")
    return _parts(docs, key, html).select(key, "pos", "anchor", "title", body.alias("body")).where("body <> ''")


def tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row per table with rows: key, pos (of its section), nth (in it), anchor, title, caption, columns, rows, guessed.

    The header is the last row of a thead that has text, or else the first row with a `th`,
    or else `Column i` (guessed). Empty cells and rows go. A table within a table ends it.
    """
    t = _parts(docs, key, html).select(key, "pos", "anchor", "title", F.posexplode(_all(F.col("rest"), TABLE)).alias("nth", "t"))
    # Generated columns are made once for a table; of plain ones each reader, each row of a lambda and a filter moved before them would make their own.
    once = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    cells = lambda rows: F.filter(F.transform(rows, lambda r: F.struct(_cells(r).alias("cells"), r.rlike(r"(?i)<th(?:\s|>)").alias("th"))), lambda r: F.size(r["cells"]) > 0)
    thead = r"(?is)<thead[ >].*?</thead>"
    caption = plain(F.regexp_extract("t", r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    t = once(t, caption=caption, _heads=cells(_all(F.regexp_extract("t", thead, 0), ROW)), _rows=cells(_all(F.regexp_replace("t", thead, ""), ROW)))
    first = F.array_position(F.transform("_rows", lambda r: r["th"]), True).cast("int")
    t = once(t, _at=F.when((F.size("_heads") == 0) & (first > 0), first).otherwise(0))
    rows = F.transform(F.filter("_rows", lambda r, i: i + 1 != F.col("_at")), lambda r: r["cells"])
    named = F.coalesce(F.try_element_at("_heads", F.lit(-1))["cells"], F.when(F.col("_at") > 0, F.get("_rows", F.col("_at") - 1)["cells"]))
    t = once(t, rows=rows, _named=named).where(F.size("rows") > 0)
    wide = F.array_max(F.transform("rows", F.size))
    columns = F.coalesce("_named", F.transform(F.sequence(F.lit(1), wide), lambda i: F.concat(F.lit("Column "), i)))
    return t.select(key, "pos", "nth", "anchor", "title", "caption", columns.alias("columns"), "rows", F.col("_named").isNull().alias("guessed"))


def embed_text(caption: Column, source: Column, columns: Column, rows: Column) -> Column:
    """A table for an embedding: each row as `label = value` pairs, empty values left out; a row without a pair as its cells."""

    def row(r: Column) -> Column:
        pairs = F.filter(F.zip_with(F.slice(columns, 1, F.size(r)), F.slice(r, 1, F.size(columns)), lambda c, v: F.when(v != "", F.concat(c, F.lit(" = "), v))), lambda p: p.isNotNull())
        return F.concat(F.lit("Row: "), F.when(F.size(pairs) > 0, F.array_join(pairs, "; ")).otherwise(F.array_join(r, " | ")), F.lit("."))

    name = F.when(caption != "", F.concat(caption, F.lit(". "))).otherwise("Table. ")
    head = F.concat(name, F.lit("Source: "), source, F.lit(". Columns: "), F.array_join(columns, "; "), F.lit("."))
    return F.array_join(F.concat(F.array(head), F.transform(rows, row)), "\n")


def display_text(caption: Column, columns: Column, rows: Column) -> Column:
    """A table as a grid whose cells are all as wide as the widest, three signs at least."""
    width = F.greatest(F.lit(3), F.array_max(F.transform(F.concat(columns, F.flatten(rows)), F.char_length)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.rpad(c, width, F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|-"), F.array_join(F.transform(columns, lambda _: F.repeat(F.lit("-"), width)), "-|-"), F.lit("-|"))
    title = F.when(caption != "", F.array(F.concat(F.lit("Table — "), caption))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(title, F.array(line(columns), rule), F.transform(rows, line)), "\n")


def selected_rows(columns: Column, rows: Column, terms: Column, cap: int = 10) -> Column:
    """The first rows that answer the terms, by a cell that has one, or by a filled cell under a column that names one."""
    asked = F.transform(columns, lambda c: F.exists(terms, lambda t: F.contains(F.lower(c), t)))

    def hit(r: Column) -> Column:
        cell = F.exists(r, lambda c: F.exists(terms, lambda t: F.contains(F.lower(c), t)))
        under = F.exists(F.zip_with(F.slice(asked, 1, F.size(r)), F.slice(r, 1, F.size(columns)), lambda a, c: a & (c != "")), lambda x: x)
        return F.coalesce(cell | under, F.lit(False))

    return F.slice(F.filter(rows, hit), 1, cap)
