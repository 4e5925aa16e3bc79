"""Joins of values with tables of intervals, on slots of the value's axis; no pair of a value and an interval is made that is not looked at for a reason."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from clauseq.plans.folders import kept

#: Cuts of the axis at most, which are the only numbers that reach the driver, and intervals' ends for a cut.
CUTS, ENDS = 4096, 16
#: Of condition sets: entries that are sent to every task at most, pairs of a question and a set for a task, tasks at most.
SENT, PAIRS, TASKS = 20_000, 200_000, 10_000


class Axis:
    """Cuts at quantiles of the intervals' ends. Slots in order: below the first cut, the first cut itself, between it and the second, the second, and so on.

    An end that many intervals share is a cut, as it is a quantile, so the ends inside a slot
    between two cuts are about 2 * intervals / cuts, however the ends are spread.
    """

    def __init__(self, intervals: DataFrame, low: str = "low", high: str = "high") -> None:
        ends = intervals.select(F.explode(F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias("x")).where("x IS NOT NULL")
        cuts = max(1, min(CUTS, ends.count() // ENDS))
        got = ends.agg(F.percentile_approx("x", [i / cuts for i in range(cuts)] + [1.0], 20 * cuts)).first()[0]
        self.cuts = sorted(set(got or []))
        self.last = 2 * len(self.cuts)

    def slot(self, value: Column) -> Column:
        """The cuts go to the tasks with the function, so that they are no part of a plan."""
        if not self.cuts:
            return F.when(value.isNotNull(), 0)
        cuts = np.array(self.cuts)

        @F.arrow_udf("int")
        def find(v: pa.Array) -> pa.Array:
            x = v.to_numpy(zero_copy_only=False)
            below = np.searchsorted(cuts, x)
            at = cuts[np.minimum(below, len(cuts) - 1)] == x
            return pa.array((2 * below + at).astype(np.int32), mask=v.is_null().to_numpy(zero_copy_only=False))

        return find(value.cast("double"))

    def nodes(self, a: Column, z: Column) -> Column:
        """The slots from a to z as the fewest nodes of a binary tree over all slots, twice its depth at most; each slot is below one of them."""
        leaf, n = self.last + 1, F.lit(1 << (self.last + 1).bit_length())
        lo, hi = (a + n).cast("long"), (z + n + 1).cast("long")
        steps = F.array(*map(F.lit, range(leaf.bit_length() + 1)))

        def level(i: Column) -> Column:
            left, right = F.ceil(lo / F.pow(F.lit(2.0), i)), F.floor(hi / F.pow(F.lit(2.0), i))
            return F.array(F.when((left < right) & (left % 2 == 1), left), F.when((left < right) & (right % 2 == 1), right - 1))

        return F.array_compact(F.flatten(F.transform(steps, level)))

    def above(self, slot: Column) -> Column:
        """The nodes over a slot, its own first."""
        n = (self.last + 1).bit_length()
        return F.transform(F.array(*map(F.lit, range(n + 1))), lambda i: F.floor((slot + F.lit(1 << n)) / F.pow(F.lit(2.0), i)))


def _spans(intervals: DataFrame, axis: Axis) -> DataFrame:
    """intervals with the slots that they end in (part) and those that they cover whole (from, upto)."""
    a, z = F.coalesce(axis.slot(F.col("low")), F.lit(0)), F.coalesce(axis.slot(F.col("high")), F.lit(axis.last))
    spans = intervals.withColumns({"_a": a, "_z": z})
    in_gap_low, in_gap_high = F.col("low").isNotNull() & (F.col("_a") % 2 == 0), F.col("high").isNotNull() & (F.col("_z") % 2 == 0)
    opened = in_gap_low | (F.col("low").isNotNull() & F.col("open_low"))
    return spans.withColumns({
        "_part": F.array_distinct(F.array_compact(F.array(F.when(in_gap_low, F.col("_a")), F.when(in_gap_high, F.col("_z"))))),
        "_from": F.col("_a") + opened.cast("int"), "_upto": F.col("_z") - in_gap_high.cast("int"),
    })


def _holds(value: Column, x: Column) -> Column:
    above = x["low"].isNull() | (value > x["low"]) | ((value == x["low"]) & ~x["open_low"])
    return above & (x["high"].isNull() | (value <= x["high"]))


def first_interval(rows: DataFrame, value: str, intervals: DataFrame, payload: list[str], by: list[str] = ()) -> DataFrame:
    """rows with the payload of the first interval that holds the value; nulls where none does.

    intervals: `by` columns, row_index, low, high, open_low and the payload. First
    is by least row_index. A null end is open; the low end is excluded where
    open_low is true, the high end never. An interval whose low is above its high holds
    nothing. A null value, or a null in `by`, has no interval. Columns of rows keep
    their places; payload names must not clash with them.

    Two answers are compared: the first of the intervals that cover the value's slot
    whole, counted down before the shuffle (work for them is intervals times the slots
    they span), and the first of those that end in the slot. The latter are swept
    once for each slot, whose ends Axis bounds, into sections with one answer each; a
    value takes that of the section that begins last before it, in the order
    of the slot. Values are looked up once each, however many rows have them.
    """
    by, v = list(by), F.col(value).cast("double")
    ends = intervals.select(*by, "row_index", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.coalesce("open_low", F.lit(False)).alias("open_low"), *payload)
    ends = ends.where("low IS NULL OR high IS NULL OR low <= high")
    axis = Axis(ends)
    spans = _spans(ends, axis)
    said = F.struct("row_index", *payload)
    whole = spans.where("_from <= _upto").withColumn("_slot", F.explode(F.sequence("_from", "_upto"))).groupBy(*by, "_slot").agg(F.min(said).alias("_whole"))
    part = spans.withColumn("_slot", F.explode("_part"))
    part = part.withColumns({"low": F.when(F.col("_a") == F.col("_slot"), F.col("low")), "high": F.when(F.col("_z") == F.col("_slot"), F.col("high"))})
    part = part.groupBy(*by, "_slot", "low", "open_low", "high").agg(F.min(said).alias("_said"))
    part = part.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_slot").orderBy("_said")))
    keys = F.struct(*by, F.col("_slot").alias("_slot"))
    sections = part.select(keys.alias("_keys"), "low", "open_low", "high", "_nth", "_said").groupBy("_keys").applyInArrow(_sections, _sections_schema(part.select(keys.alias("_keys"), "_said")))
    sections = sections.select(*(F.col(f"_keys.{c}").alias(c) for c in [*by, "_slot"]), "_x", "_after", F.struct(F.col("_said").alias("said")).alias("_section"))
    asked = rows.select(*by, v.alias("_x")).where(F.col("_x").isNotNull()).distinct().withColumn("_slot", axis.slot(F.col("_x")))
    both = asked.withColumns({"_after": F.lit(0), "_section": F.lit(None).cast(sections.schema["_section"].dataType), "_asked": F.lit(1)}).unionByName(sections.withColumn("_asked", F.lit(0)))
    # A section that begins at a value holds it, one that begins behind it doesn't.
    upto = Window.partitionBy(*by, "_slot").orderBy(F.col("_x").asc_nulls_first(), "_after", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("_section", F.last("_section", ignorenulls=True).over(upto)).where("_asked = 1")
    # Spark takes both sides for as small as their files; they are not sent to every task.
    first = at.join(whole.hint("merge"), [*by, "_slot"], "left").select(*by, "_x", F.least("_section.said", "_whole").alias("_found"))
    got = rows.withColumn("_x", v).join(first.hint("merge"), [*by, "_x"], "left")
    return got.select(*rows.columns, *(F.col(f"_found.{p}").alias(p) for p in payload))


def _sections_schema(part: DataFrame) -> StructType:
    return StructType([part.schema["_keys"], StructField("_x", DoubleType()), StructField("_after", IntegerType()), part.schema["_said"]])


def _sections(part: pa.Table) -> pa.Table:
    """Where, in a slot, the first of the intervals over it changes: from _x on or, if _after is 1, just behind it; a null _x is the slot's beginning, a null _said none."""
    low, high = part["low"].to_pylist(), part["high"].to_pylist()
    nth, opened = part["_nth"].to_pylist(), part["open_low"].to_pylist()
    edge = -math.inf
    # At a place, beginnings and ends are all taken before the first is looked for.
    turns = sorted([((edge, 0) if x is None else (x, int(o)), i) for i, (x, o) in enumerate(zip(low, opened, strict=True))] + [((x, 1), ~i) for i, x in enumerate(high) if x is not None])
    over: list[tuple[int, int]] = []
    done, last, places, found = set(), -1, [], []
    for place, group in itertools.groupby(turns, key=lambda t: t[0]):
        for _, i in group:
            if i < 0:
                done.add(~i)
            else:
                heapq.heappush(over, (nth[i], i))
        while over and over[0][1] in done:
            heapq.heappop(over)
        now = over[0][1] if over else None
        if now != last:
            places.append(place)
            found.append(now)
            last = now
    keys = part["_keys"].combine_chunks().take(pa.array([0] * len(places), pa.int64()))
    return pa.table({
        "_keys": keys, "_x": pa.array([None if x == edge else x for x, _ in places], pa.float64()), "_after": pa.array([a for _, a in places], pa.int32()),
        "_said": part["_said"].combine_chunks().take(pa.array(found, pa.int64())),
    })


def all_intervals(rows: DataFrame, value: str, intervals: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each row with every interval that holds its value, one row a pair; rows without one are left out.

    intervals as in first_interval, with any other columns, whose names must not
    clash with those of rows. An interval is repeated for each slot that it
    touches, a row never; it suits intervals that are short against the axis.
    """
    by, v = list(by), F.col(value).cast("double")
    ends = intervals.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double"), "open_low": F.coalesce("open_low", F.lit(False))})
    ends = ends.where("low IS NULL OR high IS NULL OR low <= high")
    axis = Axis(ends)
    cover = _spans(ends, axis).withColumn("_slot", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z", "_part", "_from", "_upto")
    # Spark takes the intervals for as small as their file, however often each is repeated here; they are not sent to every task.
    pairs = rows.withColumn("_slot", axis.slot(v)).join(cover.hint("merge"), [*by, "_slot"])
    return pairs.where(_holds(v, {c: F.col(c) for c in ("low", "high", "open_low")})).drop("_slot")


def within_bands(rows: DataFrame, value: str, bands: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each row with every band (centre, tolerance) that holds its value: |value - centre| <= tolerance; a band without tolerance holds its centre alone."""
    t = F.coalesce("tolerance", F.lit(0.0))
    ends = bands.where("centre IS NOT NULL").withColumns({"low": F.col("centre") - t, "high": F.col("centre") + t, "open_low": F.lit(False)})
    return all_intervals(rows, value, ends, by).drop("low", "high", "open_low")


def band_totals(rows: DataFrame, value: str, bands: DataFrame, by: list[str], name: str) -> DataFrame:
    """Each pair of `by` and a value that a band of within_bands holds, once: n (how many do), the least `name` of these, and gap, the distance from their nearest centre.

    No pair of a value and a band is made but where the band ends, or has its centre,
    in the slot of the value, whose ends Axis bounds. The other bands over a slot
    are counted down for the slot before the shuffle: of their centres only the last below it and the first
    above it can be nearest. Work is values, and distinct bands times the slots that they span.
    """
    by, v, t = list(by), F.col(value).cast("double"), F.coalesce("tolerance", F.lit(0.0))
    own = bands.where("centre IS NOT NULL").select(*by, F.col("centre").cast("double").alias("centre"), (F.col("centre") - t).cast("double").alias("low"), (F.col("centre") + t).cast("double").alias("high"), F.col(name).alias("_name"))
    own = kept(own.where("low <= high").groupBy(*by, "centre", "low", "high").agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_name")).withColumn("open_low", F.lit(False)))
    axis = Axis(own)
    ends = own.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    # Not null, so that no filter for it looks for the slots of rows before they are made distinct.
    slot = F.coalesce(axis.slot(F.col("_x")), F.lit(-1))
    asked = rows.select(*by, v.alias("_x")).where(F.col("_x").between(*(F.lit(ends[c]).cast("double") for c in ("low", "high")))).distinct().withColumn("_slot", slot)
    spans = _spans(own, axis).withColumn("_c", axis.slot(F.col("centre")))
    inside = (F.col("_c") % 2 == 0) & F.col("_c").between(F.col("_from"), F.col("_upto"))
    whole = spans.where("_from <= _upto").withColumn("_slot", F.explode(F.sequence("_from", "_upto"))).where("NOT (_slot = _c AND _c % 2 = 0)")
    whole = whole.groupBy(*by, "_slot").agg(
        F.sum("_n").alias("n"), F.min("_name").alias(name), F.max(F.when(F.col("_c") <= F.col("_slot"), F.col("centre"))).alias("_below"), F.min(F.when(F.col("_c") > F.col("_slot"), F.col("centre"))).alias("_above")
    )
    part = spans.withColumn("_slot", F.explode(F.array_union("_part", F.when(inside, F.array("_c")).otherwise(F.array().cast("array<int>")))))
    # Spark takes the bands for as small as their file; they are not sent to every task.
    over = asked.join(whole.hint("merge"), [*by, "_slot"]).select(*by, "_x", "n", name, F.least(F.col("_x") - F.col("_below"), F.col("_above") - F.col("_x")).alias("gap"))
    near = asked.join(part.select(*by, "_slot", "low", "high", "centre", "_n", "_name").hint("merge"), [*by, "_slot"]).where("_x >= low AND _x <= high")
    near = near.select(*by, "_x", F.col("_n").alias("n"), F.col("_name").alias(name), F.abs(F.col("_x") - F.col("centre")).alias("gap"))
    return over.unionByName(near).groupBy(*by, F.col("_x").alias(value)).agg(F.sum("n").alias("n"), F.min(name).alias(name), F.min("gap").alias("gap"))


def admitted_sets(stated: DataFrame, entries: DataFrame) -> DataFrame:
    """question, set_id, admitted: the condition sets that name a stated quantity, and whether they admit every one they name.

    stated: question, kind, value, one for each kind of a question. entries: set_id,
    kind, centre, tolerance. Kinds that only one side has say nothing. Sets without
    any value in its band are not listed: the join finds bands by value, not sets by kind.
    """
    kinds = lambda t, k: t.groupBy(k).agg(F.sort_array(F.collect_set("kind")).alias(f"_{k}_kinds"))
    t, by_low = F.coalesce("tolerance", F.lit(0.0)), Window.partitionBy("set_id", "kind").orderBy("low", "high")
    bands = entries.select("set_id", "kind", (F.col("centre") - t).cast("double").alias("low"), (F.col("centre") + t).cast("double").alias("high")).where("set_id IS NOT NULL AND kind IS NOT NULL AND low <= high")
    # Bands of one kind of a set that overlap become one, so a value lies in one at most and pairs need no second counting.
    begins = F.coalesce(F.col("low") > F.max("high").over(by_low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    runs = bands.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(by_low.rowsBetween(Window.unboundedPreceding, 0)))
    bands = runs.groupBy("set_id", "kind", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("open_low", F.lit(False))
    axis = Axis(bands)
    cover = _spans(bands, axis).select("set_id", "kind", "low", "high", F.explode(axis.nodes(F.col("_a"), F.col("_z"))).alias("_node"))
    sizes = stated.agg(F.approx_count_distinct("question").alias("questions")).join(entries.agg(F.count(F.lit(1)).alias("entries"), F.approx_count_distinct("set_id").alias("sets"))).first()
    # The pairs of a question are made and counted where it is; only its values are shuffled. So many tasks that each has PAIRS of them.
    tasks = max(1, min(TASKS, sizes["questions"] * sizes["sets"] // PAIRS))
    # Slots first: behind a Python step Spark no longer knows that a question's rows are together.
    asked = stated.where("question IS NOT NULL").withColumn("value", F.col("value").cast("double")).withColumn("_slot", axis.slot(F.col("value"))).repartition(tasks, "question")
    asked = asked.withColumn("_question_kinds", F.sort_array(F.collect_set("kind").over(Window.partitionBy("question"))))
    asked = asked.where("value IS NOT NULL").withColumn("_node", F.explode(axis.above(F.col("_slot"))))
    sent = F.broadcast if sizes["entries"] <= SENT else lambda t: t.hint("merge")
    found = asked.join(sent(cover), ["kind", "_node"]).where("value >= low AND value <= high")
    inside = found.groupBy("question", "_question_kinds", "set_id").agg(F.count(F.lit(1)).alias("inside"))
    both = F.size(F.array_intersect("_question_kinds", "_set_id_kinds"))
    return inside.join(sent(kinds(entries, "set_id")), "set_id").select("question", "set_id", (F.col("inside") == both).alias("admitted"))
