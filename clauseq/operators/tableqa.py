"""Questions answered from typed tables that are held as cells: which table, which operation, which column, which row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseq.operators import ranges
from clauseq.plans.folders import kept

#: Words of a question that name an operation, words that hint at a unit, parts of a name that say nothing.
COUNTS, LEAST_OF, MOST_OF = r"\bhow many\b|\bnumber of\b", r"\b(minimum|smallest|shortest|lowest|least)\b", r"\b(maximum|largest|longest|highest|greatest)\b"
UNIT_WORDS = {"kg": ("mass", "load", "weight"), "s": ("time", "duration", "second"), "km/h": ("speed", "velocity"), "v": ("load",), "degC": ("temperature",), "ppm": ("range", "fraction")}
SILENT = ("min", "max", "gt", "of")
NUMBER = r"-?\d+(?:[,\s]?\d{3})*(?:[.,]\d+)?"
#: Points of a table for a part of its name, a word of its title, the question's unit, its class.
NAME, TITLE, UNIT, CLASS = 2, 1, 3, 2
#: Tables, columns or classes that are sent to every task at most.
SENT = 20_000


def cell_number(raw: Column) -> Column:
    """A cell's number: blanks go, commas group digits by three or are a decimal point; null for other texts."""
    s = F.regexp_replace(raw, r"\s", "")
    plain = F.when(s.rlike(r"^\d{1,3}(,\d{3})+([.,]\d+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(s, "^([^,]*),", "$1."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))


def _parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "_"), lambda t: t != "")


def unsent(side: DataFrame) -> DataFrame:
    """A side that grows with the questions or the cells. Spark takes it for as small as the file it came from, and would send all of it to every task."""
    return side.hint("merge")


def sent_if_few(*counted: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How sides that grow with the counted tables only are joined: sent to every task if these have SENT rows at most, so that never the other side is."""
    return F.broadcast if all(c.limit(SENT + 1).count() <= SENT for c in counted) else unsent


def questions(asked: DataFrame) -> DataFrame:
    """asked (query_id, text) with low, operation, class (the word behind "class") and units, those that follow a number."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    operation = F.when(low.rlike(COUNTS), "count").when(low.rlike(LEAST_OF), "min").when(low.rlike(MOST_OF), "max").otherwise("lookup")
    units = F.regexp_extract_all(text, F.lit(rf"({NUMBER})\s*([%°a-zA-Z][a-zA-Z/.%°]*\b)"), 2)
    return asked.select("query_id", text.alias("text"), low.alias("low"), operation.alias("operation"), F.nullif(F.lower(F.regexp_extract(text, r"(?i)\bclass\s+([a-z0-9.]+)\b", 1)), F.lit("")).alias("class"), units.alias("units"))


def intervals_of(columns: DataFrame) -> DataFrame:
    """table_id, pair, low_col, high_col, open_low, unit: columns x_min or x_gt (its end is excluded) with x_max of the same unit, in the order of the first."""
    stem = lambda suffix: F.regexp_extract("name", rf"^(.*_){suffix}$", 1)
    low = columns.where(F.col("name").rlike("_(min|gt)$")).select("table_id", F.col("col").alias("low_col"), stem("(?:min|gt)").alias("stem"), F.col("name").endswith("_gt").alias("open_low"), F.coalesce("unit", F.lit("")).alias("unit"))
    high = columns.where(F.col("name").endswith("_max")).select("table_id", F.col("col").alias("high_col"), stem("max").alias("stem"), F.coalesce("unit", F.lit("")).alias("unit"))
    pairs = low.join(high, ["table_id", "stem", "unit"])
    # A table has as many pairs as columns at most.
    return pairs.withColumn("pair", F.row_number().over(Window.partitionBy("table_id").orderBy("low_col"))).drop("stem")


def class_columns(columns: DataFrame) -> DataFrame:
    """table_id, class_col, class_name: the first column that holds classes as values."""
    of = columns.where(F.col("name").isin("accuracy_class", "metrological_class") | F.col("name").endswith("_class"))
    return of.groupBy("table_id").agg(F.min(F.struct("col", "name")).alias("x")).select("table_id", F.col("x.col").alias("class_col"), F.col("x.name").alias("class_name"))


def pick_tables(q: DataFrame, candidates: DataFrame, tables: DataFrame, columns: DataFrame, cells: DataFrame, filled: DataFrame) -> DataFrame:
    """q with the table_id of each question's best candidate; questions whose candidates have no points are refused, but for a single candidate.

    candidates: query_id, table_id, place (of equal points the first place wins). filled: table_id of tables with cells.
    """
    sent = sent_if_few(tables, columns)
    pair_units = intervals_of(columns).where("unit <> ''").groupBy("table_id").agg(F.collect_set("unit").alias("pair_units"))
    as_names = columns.where(F.col("name").rlike(r"^class_[a-z0-9.]+$")).groupBy("table_id").agg(F.collect_set(F.substring("name", 7, 200)).alias("class_names"))
    filled = filled.select("table_id", F.lit(True).alias("filled"))
    cc = class_columns(columns).withColumnRenamed("class_col", "col")
    values = kept(cells.join(sent(cc), ["table_id", "col"]).select("table_id", F.lower(F.trim(F.coalesce("raw", F.lit("")))).alias("class")).distinct())
    known = sent_if_few(values)(values.withColumn("has_class", F.lit(True)))
    j = candidates.join(unsent(q), "query_id").join(sent(tables), "table_id").join(sent(filled), "table_id", "left").join(sent(pair_units), "table_id", "left").join(sent(as_names), "table_id", "left").join(known, ["table_id", "class"], "left")
    low = F.col("low")
    names = F.filter(_parts(F.replace("table_id", F.lit("/table/"), F.lit(""))), lambda t: (F.char_length(t) >= 3) & F.contains(low, t))
    words = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^a-z0-9.]+"), lambda w: (F.char_length(w) >= 4) & F.contains(low, w))
    unit = F.coalesce(F.arrays_overlap("pair_units", "units"), F.lit(False))
    classed = F.coalesce(F.exists("class_names", lambda n: n.startswith(F.col("class"))), F.lit(False)) | F.col("has_class").isNotNull()
    points = NAME * F.size(names) + TITLE * F.size(words) + UNIT * unit.cast("int") + CLASS * (F.col("class").isNotNull() & classed).cast("int")
    j = j.withColumn("points", F.when(F.col("filled"), points).otherwise(-1))
    best = j.groupBy("query_id").agg(F.max(F.struct("points", (-F.col("place")).alias("p"), "table_id")).alias("x"), F.count(F.lit(1)).alias("n"))
    picked = best.where((F.col("x.points") > 0) | (F.col("n") == 1)).select("query_id", F.col("x.table_id").alias("table_id"))
    return q.join(unsent(picked), "query_id")


def answer(asked: DataFrame, candidates: DataFrame, tables: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """query_id, operation, table_id, column, value, unit, row: what each question asks of its table; questions without an answer have no row.

    tables: table_id, title. columns: table_id, col, name, type, unit. cells: table_id, row, col,
    raw. candidates: query_id, table_id, place. Values are texts; numbers are given as Spark writes a double.

    `count`: the rows, or the distinct classes where these are asked for by the name of
    their column. `min`, `max`: of the column of the asked class, else of the numeric
    column that the question's words fit best. `lookup`: the first row of that class, if
    one is asked for, whose interval holds the number stated in its unit, found by a
    range join over the rows of all tables; of several intervals the first with such a
    row. Its value is the class's column, or the one numeric column that is left.
    """
    # What several steps read is made once, so that no plan holds it again for each.
    tables, columns = kept(tables), kept(columns)
    sent = sent_if_few(tables, columns)
    rows = kept(cells.join(sent(tables.select("table_id")), "table_id", "left_semi").groupBy("table_id").agg(F.count_distinct("row").alias("rows")))
    q = kept(pick_tables(questions(asked), candidates, tables, columns, cells, rows))
    low = F.col("low")
    cc = class_columns(columns)
    classes = cells.join(sent(cc.withColumnRenamed("class_col", "col")), ["table_id", "col"]).groupBy("table_id", "class_name").agg(F.count_distinct(F.lower(F.trim(F.coalesce("raw", F.lit(""))))).alias("classes"))
    counted = q.where("operation = 'count'").join(sent(rows), "table_id").join(sent(classes), "table_id", "left")
    by_class = low.rlike(r"\bclasses?\b") & F.coalesce(F.exists(_parts(F.col("class_name")), lambda t: (F.char_length(t) >= 3) & F.contains(low, t)), F.lit(False))
    none = F.lit(None).cast("string")
    count = counted.select("query_id", "operation", "table_id", F.when(by_class, F.col("class_name")).alias("column"), F.when(by_class, F.col("classes")).otherwise(F.col("rows")).cast("string").alias("value"), none.alias("unit"), F.lit(None).cast("int").alias("row"))

    # The column of the asked class: its own name first, then the first that begins with it.
    shaped = columns.where(F.col("name").rlike(r"^class_[a-z0-9.]+$")).select("table_id", "col", "name", "unit", F.substring("name", 7, 200).alias("id"))
    met = q.where("class IS NOT NULL").join(sent(shaped), "table_id").where(F.col("id").startswith(F.col("class")))
    of_class = met.groupBy("query_id").agg(F.min(F.struct((F.col("id") != F.col("class")).alias("o"), "col", "name", F.col("unit").alias("u"))).alias("x"))
    of_class = of_class.select("query_id", F.col("x.col").alias("class_as_col"), F.col("x.name").alias("class_as_name"), F.col("x.u").alias("class_as_unit"))
    numeric = columns.where(F.col("type").isin("number", "integer") | F.col("name").rlike(r"^class_[a-z0-9.]+$"))

    ends = q.where("operation IN ('min', 'max')").join(unsent(of_class), "query_id", "left")
    fit = F.size(F.filter(_parts(F.col("name")), lambda t: ~t.isin(*SILENT) & (F.char_length(t) >= 3) & F.contains(low, t)))
    hint = F.lit(False)
    for unit, words in UNIT_WORDS.items():
        hint = hint | ((F.col("unit") == unit) & low.rlike(rf"\b({'|'.join(words)})\b"))
    scored = ends.where("class_as_col IS NULL").join(sent(numeric), "table_id").withColumn("fit", fit + F.coalesce(hint, F.lit(False)).cast("int")).where("fit > 0")
    chosen = scored.groupBy("query_id", "operation", "table_id").agg(F.max(F.struct("fit", (-F.col("col")).alias("p"), "col", "name", "unit")).alias("x")).select("query_id", "operation", "table_id", "x.col", "x.name", "x.unit")
    chosen = chosen.unionByName(ends.where("class_as_col IS NOT NULL").select("query_id", "operation", "table_id", F.col("class_as_col").alias("col"), F.col("class_as_name").alias("name"), F.col("class_as_unit").alias("unit")))
    # Extremes of a column once, for all questions that ask for it.
    known = cells.join(sent(chosen.select("table_id", "col").distinct()), ["table_id", "col"]).withColumn("v", cell_number(F.col("raw"))).where("v IS NOT NULL")
    extremes = known.groupBy("table_id", "col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    extreme = chosen.join(sent(extremes), ["table_id", "col"]).select("query_id", "operation", "table_id", F.col("name").alias("column"), F.when(F.col("operation") == "min", F.col("lo")).otherwise(F.col("hi")).cast("string").alias("value"), F.nullif("unit", F.lit("")).alias("unit"), F.lit(None).cast("int").alias("row"))

    pairs = kept(intervals_of(columns))
    num = cells.withColumn("v", cell_number(F.col("raw")))
    side = lambda c, to: num.join(sent(pairs.select("table_id", "pair", F.col(c).alias("col"))), ["table_id", "col"]).select("table_id", "pair", "row", F.col("v").alias(to))
    all_rows = cells.select("table_id", "row").distinct().join(sent(pairs), "table_id").select("table_id", "pair", "row", "open_low")
    spans = all_rows.join(unsent(side("low_col", "low")), ["table_id", "pair", "row"], "left").join(unsent(side("high_col", "high")), ["table_id", "pair", "row"], "left")
    named = cells.join(sent(cc.withColumnRenamed("class_col", "col")), ["table_id", "col"]).select("table_id", "row", F.lower(F.trim(F.coalesce("raw", F.lit("")))).alias("key"))
    # Each row under its own class, and under no class in particular.
    keyed = spans.join(unsent(named), ["table_id", "row"]).unionByName(spans.withColumn("key", F.lit("*")))
    keyed = kept(keyed.withColumn("row_index", F.col("row")).withColumnRenamed("row", "found"))
    looked = q.where("operation = 'lookup'").join(sent(pairs.where("unit <> ''")), "table_id").join(sent(cc), "table_id", "left")
    pattern = F.concat(F.lit(rf"(?i)({NUMBER})\s*\Q"), F.col("unit"), F.lit(r"\E\b"))
    looked = looked.withColumn("stated", cell_number(F.nullif(F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1)), F.lit("")))).where("stated IS NOT NULL")
    looked = looked.withColumn("key", F.when(F.col("class").isNotNull() & F.col("class_col").isNotNull(), F.col("class")).otherwise("*"))
    hit = kept(ranges.first_interval(looked.drop("open_low"), "stated", keyed, ["found"], ["table_id", "pair", "key"]).where("found IS NOT NULL"))
    first = hit.groupBy("query_id").agg(F.min("pair").alias("pair"))
    hit = hit.join(unsent(first), ["query_id", "pair"]).join(unsent(of_class), "query_id", "left")
    used = F.when(F.col("key") != "*", F.col("class_col"))
    rest = hit.select("query_id", "table_id", "low_col", "high_col", used.alias("used")).join(sent(numeric), "table_id").where("col <> low_col AND col <> high_col AND NOT (col <=> used)")
    only = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("col", "name", F.col("unit").alias("u"))).alias("x")).where("n = 1").select("query_id", F.col("x.col").alias("one"), F.col("x.name").alias("one_name"), F.col("x.u").alias("one_unit"))
    hit = hit.join(unsent(only), "query_id", "left").withColumns({
        "col": F.coalesce("class_as_col", "one"), "column": F.coalesce("class_as_name", "one_name"), "_unit": F.when(F.col("class_as_col").isNotNull(), F.col("class_as_unit")).otherwise(F.col("one_unit")),
    }).drop("unit")
    cell = cells.select("table_id", F.col("row").alias("found"), "col", "raw")
    value = F.coalesce(cell_number(F.col("raw")).cast("string"), F.trim("raw"))
    lookup = hit.join(unsent(cell), ["table_id", "found", "col"], "left").select("query_id", "operation", "table_id", "column", value.alias("value"), F.nullif("_unit", F.lit("")).alias("unit"), F.col("found").cast("int").alias("row"))
    return count.unionByName(extreme).unionByName(lookup)
