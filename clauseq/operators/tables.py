"""Predicates, registers, intervals and telemetry over typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v, "in": lambda c, v: c.cast("string").isin([str(x) for x in v]), "like": lambda c, v: c.ilike(v), "between": lambda c, v: c.between(*v),
}
ORDERED = {"lt", "le", "gt", "ge", "between"}
TOTALS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def find(table: DataFrame, where=(), group_by=(), totals=(), order_by=(), limit: int = 10) -> DataFrame:
    """A typed predicate query. where: (column, operation, value), all of which hold. totals: (function, column or "*", alias).
    order_by: (column, descending). limit, 1 to 25, is the operator's own. Unknown names and ordered comparisons of text are errors."""
    kinds = dict(table.dtypes)

    def known(name: str) -> Column:
        if name not in kinds:
            raise ValueError(f"unknown column {name}; valid: {', '.join(sorted(kinds))}")
        return F.col(name)

    for name, op, value in where:
        if op not in COMPARE:
            raise ValueError(f"unknown operation {op}; valid: {', '.join(COMPARE)}")
        if op in ORDERED and known(name) is not None and kinds[name] == "string":
            raise ValueError(f"{op} needs a numeric column, {name} is text")
        table = table.where(COMPARE[op](known(name), value))
    if totals:
        made = [(TOTALS[f](F.lit(1) if c == "*" else known(c))).alias(a) for f, c, a in totals]
        table = table.groupBy(*(known(g) for g in group_by)).agg(*made)
    keys = [F.desc(c) if down else F.asc(c) for c, down in order_by]
    return table.orderBy(*keys).limit(max(1, min(25, limit))) if keys else table.limit(max(1, min(25, limit)))


def interval_lookup(rows: DataFrame, value: str, steps: list[tuple]) -> Column | DataFrame:
    """rows with `step`: the name of the first interval (name, low, high, low excluded) that holds the value; a null end is open, no interval gives null."""
    out = None
    for name, low, high, open_low in steps:
        c = F.col(value)
        fits = F.lit(True)
        if low is not None:
            fits = fits & ((c > low) if open_low else (c >= low))
        if high is not None:
            fits = fits & (c <= high)
        out = F.when(fits & c.isNotNull(), name) if out is None else out.when(fits & c.isNotNull(), name)
    return rows.withColumn("step", out)


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place min(n - 1, floor(share * n)) of the sorted values of each group.

    Values are counted first, so a group's sort is over its distinct values, and the running count is a window over them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col(value))).alias(a) for a, q in shares.items()]
    return ranked.groupBy(*by).agg(*picks)


def active_editions(docs: DataFrame, family: str, edition: str, key: str) -> DataFrame:
    """For each row its successor in the family (superseded_by) and whether it is the active edition: the latest, ties by key."""
    w = Window.partitionBy(family).orderBy(F.col(edition), F.col(key))
    return docs.select(family, edition, key, F.lead(key).over(w).alias("superseded_by")).withColumn("active", F.col("superseded_by").isNull())


def latest_of(rows: DataFrame, by: str, order: list[str], value: str, **states: Column) -> DataFrame:
    """Register totals: rows, those in each state and the latest one's value for each group; map-side partial."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(s) for s, c in states.items()), F.max_by(value, F.struct(*order)).alias("latest"))


def verdicts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule, passed, failed, unknown: how many rows each check holds for, does not, or has no value for. One scan; the checks of a row are folded before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), check.alias("ok")) for name, check in checks.items())))
    counts = F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unknown")
    return rows.select(each.alias("x")).select("x.*").groupBy("rule").agg(*counts)
