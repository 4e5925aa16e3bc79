"""Checks held in tables, judged on the values that questions state: numbers at symbols, tolerances, units' dimensions, corners, safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of a number, of a unit, of what stands before a tolerance, signs between a symbol and its number.
NUMBER, UNIT, PLUS_MINUS, GAP = r"[0-9]+(?:[0-9 ,.]*[0-9])?", r"%|°?[A-Za-zµΩ]{0,6}", r"±|\bpm\b|\+/-", r"\D{0,14}?"
#: Symbols whose tolerances make corners, how far a tolerance is scaled in search of a flip, halvings, and the coverage factor.
BANDS, REACH, HALVINGS, COVERAGE = 3, 20.0, 12, 2.0


def leaf(symbol: Column) -> Column:
    """The last part of a dotted symbol, as questions write it."""
    return F.element_at(F.split(symbol, r"\."), -1)


def number(raw: Column) -> Column:
    """A stated number: blanks and commas group digits, and so does a point before exactly three last digits; null if no number is left."""
    bare = F.translate(raw, " ,", "")
    plain = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.(\d{3})$", "$1")).otherwise(bare)
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.cast("double"))


#: Symbols of a row, in their order, whose patterns stay compiled from row to row as long as they are the same; others are compiled for each row.
_PLACES = 4


def _what_follows(number: str, unit: str) -> str:
    """What follows a symbol: a number, and then a tolerance at once, a unit and a tolerance, or a unit at most."""
    return rf"{GAP}{number}(?:\s*(?:{PLUS_MINUS})\s*{number}\s*{unit}?|\s*{unit}\s*(?:{PLUS_MINUS})\s*{number}\s*{unit}?|\s*{unit}?)"


def _said_at(symbol: Column) -> Column:
    """The pattern of what a text says behind a symbol, from its end on; it looks ahead only, so each place is found where several overlap."""
    return F.concat(F.lit(r"(?iu)(?=\b\Q"), leaf(symbol), F.lit(rf"\E\b({_what_follows(f'(?:{NUMBER})', f'(?:{UNIT})')}))"))


def _stated(text: Column, symbols: Column) -> Column:
    """[(symbol, value, unit, tolerance, stated, relative)] of symbols, [(symbol, pattern)] with the pattern of _said_at.

    A text is searched once for each symbol, and what stands there taken apart by one pattern, which is the same for all.
    """
    field = lambda s, *names: [s[n].alias(n) for n in names]
    t, none = F.coalesce(text, F.lit("")), F.lit("")
    search = lambda s: F.struct(*field(s, "symbol"), F.regexp_extract_all(t, s["pattern"], F.lit(1)).alias("at"))
    first = F.slice(F.array(*(search(F.get(symbols, F.lit(i))) for i in range(_PLACES))), F.lit(1), F.least(F.size(symbols), F.lit(_PLACES)))
    found = F.concat(first, F.transform(F.slice(symbols, F.lit(_PLACES + 1), F.greatest(F.size(symbols) - _PLACES, F.lit(0))), search))
    # The groups: the number; tolerance, its unit; or unit, tolerance, its unit; or unit.
    apart = lambda p: F.split(F.regexp_replace(p, rf"(?iu)^{_what_follows(f'({NUMBER})', f'({UNIT})')}", "$1\n$2\n$3\n$4\n$5\n$6\n$7"), "\n")
    split = F.transform(found, lambda s: F.struct(*field(s, "symbol"), F.transform(s["at"], apart).alias("at")))
    # The first place with a tolerance at once counts, else the first with one behind a unit, else the first.
    one = lambda s: F.coalesce(F.get(F.filter(s["at"], lambda p: p[1] != ""), F.lit(0)), F.get(F.filter(s["at"], lambda p: p[4] != ""), F.lit(0)), F.get(s["at"], F.lit(0)))
    taken = F.transform(split, lambda s: F.struct(*field(s, "symbol"), one(s).alias("p")))

    def named(s: Column) -> Column:
        p = s["p"]
        case = lambda a, b, c: F.when(p[1] != "", a).when(p[4] != "", b).otherwise(c)
        some = lambda c: F.nullif(F.trim(c), none)
        return F.struct(*field(s, "symbol"), number(p[0]).alias("value"), some(case(p[2], p[3], p[6])).alias("unit"), case(p[1], p[4], F.lit(None)).alias("raw"), some(case(p[2], p[5], F.lit(None))).alias("tol_unit"))

    read = F.transform(taken, named)
    read = F.transform(read, lambda s: F.struct(*field(s, "symbol", "value", "unit", "raw", "tol_unit"), number(s["raw"]).alias("tol")))

    def entry(s: Column) -> Column:
        bound, percent = s["value"].isNotNull(), F.coalesce(s["tol_unit"] == "%", F.lit(False))
        told = bound & s["tol"].isNotNull()
        stated = F.concat(F.lit("± "), s["raw"], F.coalesce(F.concat(F.lit(" "), s["tol_unit"]), none))
        return F.struct(
            *field(s, "symbol", "value"), F.when(bound, s["unit"]).alias("unit"), F.when(bound, F.when(percent, F.abs(s["value"]) * s["tol"] / 100).otherwise(s["tol"])).alias("tolerance"),
            F.when(told, stated).alias("stated"), F.when(told, percent).alias("relative"),
        )

    return F.transform(read, entry)


def stated_values(asked: DataFrame) -> DataFrame:
    """asked (any columns, text, symbol) with value, unit, tolerance, stated and relative.

    The value is the number nearest behind the symbol, without another number between. A tolerance
    follows the number (then its unit is the value's too) or the value's unit; in
    percent it is a share of the value, else absolute. Nulls where nothing is stated.
    """
    one = F.array(F.struct(F.col("symbol").alias("symbol"), _said_at(F.col("symbol")).alias("pattern")))
    said = asked.withColumn("_said", F.get(_stated(F.col("text"), one), F.lit(0)))
    return said.withColumns({c: F.col("_said")[c] for c in ("value", "unit", "tolerance", "stated", "relative")}).drop("_said")


def _margin(values: Column) -> Column:
    """The sum of a check's terms, each its factor times its symbols' values, less the limit."""
    product = lambda t: F.aggregate(t["symbols"], t["factor"], lambda acc, s: acc * values[s])
    return F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + product(t)) - F.col("limit")


def _holds(margin: Column) -> Column:
    op = F.col("op")
    return F.when(op == "<=", margin <= 0).when(op == "<", margin < 0).when(op == ">=", margin >= 0).when(op == ">", margin > 0).when(op == "=", margin == 0)


def judge_checks(pairs: DataFrame, checks: DataFrame, units: DataFrame) -> DataFrame:
    """One row per question, node and check: query_id, node_id, check_no, values, missing, result, corners, symbol, stated, void_reason, margin_tolerance, bounded, safety.

    pairs: query_id, text, node_id. checks: node_id, check_no, terms (an array of factor
    and symbols, whose product is taken), op and limit: the sum of the terms is compared with
    the limit. units: unit, dimension.

    A node whose symbols are not all stated has no results, only `missing`. A check
    whose symbols' units have different known dimensions is void. Of its symbols with a tolerance the first
    three make corners, 2^k tuples of values; where one decides otherwise than the
    stated values, the check is void by the first of them. Where all agree, its
    tolerance is scaled up to 20 times until the result flips, by halving: the margin
    over twice the tolerance is the safety, not bounded if it never flips. `bounded` is null
    where safety is, and cheaper to filter by, as a filter makes what it reads on its own.
    """
    # A node's checks, and the symbols that they name, stand in one row, so that a question's values are read where it is and nothing of it is shuffled.
    per = checks.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("check_no", "terms", "op", "limit"))).alias("_checks"))
    names = F.sort_array(F.array_distinct(F.flatten(F.flatten(F.transform("_checks", lambda c: c["terms"]["symbols"])))))
    per = per.withColumn("_symbols", F.transform(names, lambda s: F.struct(s.alias("symbol"), _said_at(s).alias("pattern")))).where(F.size("_symbols") > 0)
    # The known units are one row.
    known = units.where("unit IS NOT NULL").groupBy(F.lower("unit").alias("u")).agg(F.min("dimension").alias("d")).agg(F.map_from_entries(F.collect_list(F.struct("u", "d"))).alias("_units"))
    read = pairs.join(per, "node_id").withColumn("_all", _stated(F.col("text"), F.col("_symbols"))).select("query_id", "node_id", "_all", "_checks").join(F.broadcast(known))
    bound = F.filter("_all", lambda e: e["value"].isNotNull())
    more = lambda e: F.named_struct(F.lit("tolerance"), e["tolerance"], F.lit("stated"), e["stated"], F.lit("dimension"), F.col("_units")[F.lower(e["unit"])])
    j = read.select(
        "query_id", "node_id", F.map_from_entries(F.transform(bound, lambda e: F.struct(e["symbol"], e["value"]))).alias("values"), F.map_from_entries(F.transform(bound, lambda e: F.struct(e["symbol"], more(e)))).alias("more"),
        F.transform(F.filter("_all", lambda e: e["value"].isNull()), lambda e: e["symbol"]).alias("missing"), F.explode("_checks").alias("_check"),
    ).select("query_id", "node_id", "values", "more", "missing", "_check.*").withColumn("_names", F.array_distinct(F.flatten("terms.symbols")))
    own = F.array_compact(F.transform("_names", lambda s: F.col("more")[s]["dimension"]))
    whole, mixed = F.size("missing") == 0, F.size(F.array_distinct(own)) > 1
    j = j.withColumn("result", F.when(whole & ~mixed, _holds(_margin(F.col("values")))))
    bands = F.slice(F.filter("_names", lambda s: F.col("more")[s]["tolerance"].isNotNull()), 1, BANDS)
    j = j.withColumns({"_bands": F.when(F.col("result").isNotNull(), bands).otherwise(F.array().cast("array<string>")), "_mixed": whole & mixed})
    key = ["query_id", "node_id", "check_no"]

    def corner(mask: Column) -> Column:
        side = lambda s: F.when(F.getbit(mask, F.array_position("_bands", s).cast("int") - 1) == 1, 1.0).otherwise(-1.0)
        moved = F.transform_values("values", lambda s, v: F.when(F.array_contains("_bands", s), v + side(s) * F.col("more")[s]["tolerance"]).otherwise(v))
        return _holds(_margin(moved))

    # Eight at most.
    j = j.withColumn("corners", F.when(F.size("_bands") > 0, F.transform(F.sequence(F.lit(0), F.expr("shiftleft(1, size(_bands)) - 1")), corner)))
    first = F.get("_bands", F.lit(0))
    j = j.withColumns({"symbol": first, "_tol": F.col("more")[first]["tolerance"], "stated": F.col("more")[first]["stated"]})
    crossed = F.exists("corners", lambda c: c != F.col("result"))
    reason = F.when(F.col("_mixed"), "mixed dimensions").when(F.coalesce(crossed, F.lit(False)), F.concat(F.lit("tolerance of "), leaf(F.col("symbol"))))
    # A generated column, which no filter of what follows passes; moved before the columns that it reads, it would make them again for each value and halving.
    j = j.select("*", F.inline(F.array(F.struct(reason.alias("void_reason")))))

    def flips(scale: Column) -> Column:
        at = lambda way: F.transform_values("values", lambda s, v: F.when(s == F.col("symbol"), v + way * scale * F.col("_tol")).otherwise(v))
        return (_holds(_margin(at(1))) != F.col("result")) | (_holds(_margin(at(-1))) != F.col("result"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        # Once for each halving, so that the expression does not double with each step.
        return F.aggregate(F.array(mid), s, lambda acc, m: F.when(flips(m), F.struct(acc["lo"].alias("lo"), m.alias("hi"))).otherwise(F.struct(m.alias("lo"), acc["hi"].alias("hi"))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(1.0).alias("lo"), F.lit(REACH).alias("hi")), halve)["hi"]
    robust = F.col("symbol").isNotNull() & F.col("void_reason").isNull() & (F.col("_tol") > 0)
    j = j.withColumn("bounded", F.when(robust, flips(F.lit(REACH))))
    scale = F.when(F.col("bounded"), found).when(~F.col("bounded"), REACH)
    return j.withColumn("_scale", scale).select(
        *key, "values", "missing", "result", "corners", "symbol", "stated", "void_reason", (F.col("_scale") * F.col("_tol")).alias("margin_tolerance"), "bounded", (F.col("_scale") / COVERAGE).alias("safety")
    )


def judge_nodes(judged: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per question and node of judge_checks: query_id, node_id, verdict, missing, void_reason, on_violation, violation_meaning.

    void where a symbol is not stated or a check is void (the first by number says why), fail
    where one fails, else pass. nodes: node_id, on_violation ("invalid" if null), violation_meaning; told where it fails.
    """
    per = judged.groupBy("query_id", "node_id").agg(
        F.first("missing").alias("missing"), F.min(F.when(F.col("void_reason").isNotNull(), F.struct("check_no", "void_reason")))["void_reason"].alias("void_reason"), F.bool_or(~F.col("result")).alias("failed")
    )
    verdict = F.when((F.size("missing") > 0) | F.col("void_reason").isNotNull(), "void").when(F.coalesce("failed", F.lit(False)), "fail").otherwise("pass")
    named = per.withColumn("verdict", verdict).join(nodes.select("node_id", "on_violation", "violation_meaning"), "node_id", "left")
    told = F.col("verdict") == "fail"
    return named.select("query_id", "node_id", "verdict", "missing", "void_reason", F.when(told, F.coalesce("on_violation", F.lit("invalid"))).alias("on_violation"), F.when(told, F.col("violation_meaning")).alias("violation_meaning"))


def quantities(text: Column) -> Column:
    """{kind: (stated, unit, si)} of what a question states: a temperature (°C before K), a relative humidity, a duration (hours before days)."""
    n = r"(-?\d+(?:[.,]\d+)?)"

    def of(pattern: str, unit: str, factor: float, offset: float = 0.0) -> Column:
        v = F.when(text.rlike(pattern), F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).cast("double"))
        return F.when(v.isNotNull(), F.struct(v.alias("stated"), F.lit(unit).alias("unit"), (v * factor + offset).alias("si")))

    kinds = {
        "temperature": F.coalesce(of(rf"{n}\s*(?:°\s*)?C\b", "degC", 1.0, 273.15), of(rf"{n}\s*K\b", "K", 1.0)),
        "relative_humidity": of(rf"(?i){n}\s*%\s*(?:RH\b|relative\s+humidity)?", "%", 0.01),
        "duration": F.coalesce(of(rf"(?i){n}\s*h\b", "h", 3600.0), of(rf"(?i){n}\s*days?\b", "d", 86400.0)),
    }
    return F.map_filter(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
