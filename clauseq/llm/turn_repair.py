"""Repair of conversations by the cheapest edits: shortest paths whose backward costs are stored at checkpoints only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.staging import staged

#: Roles by initial. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation may end in 0 and 3.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KIND = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FITS = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
#: The state after a user or assistant put in here, and that turn's role.
TURN = (2, 2, 3, 2)
NAME = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Bits of a row's code, beside its kind of role.
TRUNCATED, GONE = 4, 8
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
FAR = 1 << 40
Costs = tuple[int, int, int, int]
#: Costs to reach the end after the last row.
LAST: Costs = (0, 2 * INSERT, INSERT, 0)


@cache
def edges(code: int, after: Costs, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost to the end, next state) of a row's own edits, in order of their initials."""
    out = [("D", DELETE + after[state], state)]
    if not code & GONE:
        extra = UNFINISHED if code & TRUNCATED else 0
        kept = FITS.get((state, code & 3))
        if kept is not None:
            out.append(("K", extra + after[kept], kept))
        out.append(("R", REROLE + extra + after[TURN[state]], TURN[state]))
    return tuple(out)


@cache
def before_row(code: int, after: Costs) -> Costs:
    """Costs from each state to the end in front of a row, given those behind it; turns may be put in before it."""
    own = [min(cost for _, cost, _ in edges(code, after, state)) for state in range(4)]
    user = min(own[2], INSERT + own[3])
    return min(own[0], INSERT + user, FAR), min(own[1], INSERT + user, FAR), min(user, FAR), min(own[3], INSERT + own[2], FAR)


def level(costs: Costs) -> tuple[Costs, int]:
    """The costs less the least of them, which keeps the number of different vectors small, and that least."""
    low = min(costs)
    return tuple(c - low if c < FAR else FAR for c in costs), low


def backward(codes: bytes, end: Costs) -> tuple[Costs, int]:
    costs, total = level(end)
    for code in reversed(codes):
        costs, low = level(before_row(code, costs))
        total += low
    return costs, total


@cache
def move(code: int, after: Costs, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest ways over a row: turns put in before it (I) and its own edit; and the next state."""
    best, said = before_row(code, after)[state], ""
    while True:
        tight = [(edit, to) for edit, cost, to in edges(code, after, state) if cost == best]
        if tight and tight[0][0] == "D":
            return said + "D", tight[0][1]
        put = TURN[state]
        if before_row(code, after)[put] + INSERT == best:
            said, state, best = said + "I", put, best - INSERT
            continue
        return said + tight[0][0], tight[0][1]


def walk(codes: bytes, end: Costs, state: int) -> tuple[str, int]:
    """(edits, state at the end).

    Going back, only the vector at every sqrt(n)-th row is stored; going forward,
    the vectors of one block at a time are computed again from the next checkpoint.
    """
    n = len(codes)
    size = isqrt(n) + 1
    costs = level(end)[0]
    marks = {n: costs}
    for i in range(n - 1, -1, -1):
        costs = level(before_row(codes[i], costs))[0]
        if i % size == 0:
            marks[i] = costs
    said = []
    for lo in range(0, n, size):
        hi = min(lo + size, n)
        block = [marks[hi]]
        for i in range(hi - 1, lo, -1):
            block.append(level(before_row(codes[i], block[-1]))[0])
        for i in range(lo, hi):
            edit, state = move(codes[i], block[hi - 1 - i], state)
            said.append(edit)
    return "".join(said), state


def ending(state: int) -> tuple[str, int]:
    """The turns put in after the last row."""
    said = ""
    while state in (1, 2):
        said, state = said + "I", TURN[state]
    return said, state


def damage(turns: DataFrame) -> DataFrame:
    """The damage that the contract does to one turn in four, by its key; a null in the key, a role or a text is one space."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        ).drop("copy")
    )


def _ends(text: Column) -> Column:
    """The text without white space at its end."""
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def marked(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).select(
        "*", F.unhex(F.sha2("text", 256)).alias("mark"), F.right(_ends(F.col("text")), F.lit(1)).alias("sign")
    )


def coded(rows: DataFrame) -> DataFrame:
    """One row for equal turns of a conversation: conv_id, turn, role, mark, copies, blank, again (seen at an earlier turn), cut.

    The rows of one conversation, role and text may be many: they are counted by
    turn before the shuffle, and the least turn of each is joined back, a join whose
    large side the engine may split.
    """
    blank = F.col("sign") == ""
    each = rows.groupBy("conv_id", "turn", "role", "mark").agg(
        F.count(F.lit(1)).alias("copies"), F.first(blank).alias("blank"), F.first(~F.col("sign").isin(".", "!", "?")).alias("cut")
    )
    first = rows.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("first"))
    same = each["conv_id"].eqNullSafe(first["conv_id"]) & (each["role"] == first["role"]) & (each["mark"] == first["mark"])
    return each.join(first, same).select(
        each["conv_id"], "turn", each["role"], each["mark"], "copies", "blank", (~F.struct("turn").eqNullSafe(F.col("first"))).alias("again"), "cut"
    )


_STRETCH = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("edge", pa.bool_()), ("codes", pa.binary())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns", "first_turn", "last_turn")]
    + [("first_sign", pa.string()), ("last_sign", pa.string()), ("passage", pa.list_(pa.int64()))]
)
_STRETCH_DDL = (
    "conv_id long, part int, edge boolean, codes binary, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, "
    "first_turn long, last_turn long, first_sign string, last_sign string, passage array<long>"
)


def passage(codes: bytes) -> list[int]:
    """Cheapest cost from each state before the rows (outer) to each state behind them (inner)."""
    columns = []
    for to in range(4):
        costs, total = backward(codes, tuple(0 if s == to else FAR for s in range(4)))
        columns.append([c + total if c < FAR else FAR for c in costs])
    return [columns[to][at] for at in range(4) for to in range(4)]


def stretches(rows: DataFrame, parts: int) -> DataFrame:
    """The rows in order, cut into one stretch for each conversation and range of rows; a row is one byte there.

    A conversation that spans several ranges has a stretch in each, with the costs
    of passing it from any state to any other; that is one row for a range.
    """
    order = ["conv_id", "turn", "role", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, codes, out = TaskContext.get().partitionId(), None, bytearray(), []

        def close(edge: bool) -> None:
            now["codes"] = bytes(codes)
            now["edge"] = edge
            if edge:
                now["passage"] = passage(now["codes"])
            out.append(now)

        opened = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "copies", "blank", "again", "cut")]
            for conv, turn, role, copies, blank, again, cut in zip(*columns, strict=True):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        close(opened == 1)
                    opened += 1
                    now, codes = dict.fromkeys(_STRETCH.names, 0), bytearray()
                    now |= {"conv_id": conv, "part": part, "least": None, "most": None, "first_turn": turn, "last_turn": None, "first_sign": role[:1], "last_sign": None, "passage": None}
                sign = role[:1]
                code = KIND.get(sign, OTHER)
                gone = blank or again
                codes.append(code | GONE if gone else code | TRUNCATED if cut else code)
                codes.extend(bytes([code | GONE]) * (copies - 1))
                now["blank"] += copies if blank else 0
                now["duplicate"] += 0 if blank else copies - (not again)
                now["truncated"] += bool(cut and not gone)
                now["illegal"] += copies - 1 + (now["last_sign"] is not None and now["last_sign"] + sign not in LEGAL)
                if turn is not None:
                    now["turns"] += turn != now["last_turn"]
                    now["least"] = turn if now["least"] is None else now["least"]
                    now["most"] = turn
                now["last_turn"], now["last_sign"] = turn, sign
            if out:
                yield pa.RecordBatch.from_pylist(out, _STRETCH)
                out = []
        if now is not None:
            close(True)
            yield pa.RecordBatch.from_pylist(out, _STRETCH)

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _STRETCH_DDL)


_PLAN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ends", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())])


def chained(edge: DataFrame) -> DataFrame:
    """The costs behind each stretch of the conversations that may span ranges: their passages are chained from the last back. At most one row for a range each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = list(LAST)
                for k in range(len(chain) - 1, -1, -1):
                    out.append({"conv_id": conv, "part": chain[k]["part"], "ends": ends, "first": k == 0, "last": k == len(chain) - 1})
                    way = chain[k]["passage"]
                    ends = [min(way[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_pylist(out, _PLAN)

    per = edge.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "passage"))).alias("chain"))
    return per.mapInArrow(run, "conv_id long, part int, ends array<long>, first boolean, last boolean")


_WALKED = "conv_id long, part int, cost long, audits array<string>, exits array<int>"


def walked(planned: DataFrame) -> DataFrame:
    """The edits of each stretch for each state that it may be entered in; a conversation's first stretch only from the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _WALKED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                ends, audits, exits = tuple(r["ends"]), [], []
                for state in range(1 if r["first"] else 4):
                    audit, state = walk(r["codes"], ends, state)
                    more, state = ending(state) if r["last"] else ("", state)
                    audits.append(audit + more)
                    exits.append(state)
                costs, total = backward(r["codes"], ends) if r["first"] else ((0,), 0)
                for column, value in zip(out, (r["conv_id"], r["part"], costs[0] + total, audits, exits), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return planned.select("conv_id", "part", "codes", "ends", "first", "last").mapInArrow(run, _WALKED)


def entered(ways: DataFrame) -> DataFrame:
    """The state in which each stretch of the conversations that may span ranges is entered; exits are followed from the first on."""
    per = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "exits"))).alias("chain"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<part:int,entry:int>>").alias("entries"))
    follow = F.aggregate(
        "chain", start,
        lambda acc, x: F.struct(
            F.get(x["exits"], acc["state"]).alias("state"),
            F.concat(acc["entries"], F.array(F.struct(x["part"].alias("part"), acc["state"].alias("entry")))).alias("entries"),
        ),
    )
    return per.select("conv_id", F.inline(follow["entries"]))


def edits(turns: DataFrame, parts: int) -> DataFrame:
    """One row per conversation and range: its statistics and edits."""
    s = staged(stretches(coded(marked(turns)), parts))
    edge = s.where("edge")
    plan = chained(edge).alias("p")
    here = edge.alias("s").join(plan, F.col("s.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("s.part") == F.col("p.part")))
    inner = s.where("NOT edge").select("conv_id", "part", "codes", F.array(*map(F.lit, LAST)).cast("array<long>").alias("ends"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    ways = staged(walked(here.select("s.conv_id", "s.part", "codes", "ends", "first", "last").unionByName(inner)))
    entry = entered(ways.alias("w").join(edge.select("conv_id", "part").alias("e"), F.col("w.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("w.part") == F.col("e.part"))).select("w.*"))
    of = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))
    at = F.coalesce("entry", F.lit(0))
    return (
        s.drop("codes", "passage", "edge").alias("s").join(ways.alias("w"), of("s", "w")).join(entry.alias("n"), of("s", "n"), "left")
        .select("s.*", "cost", F.get("audits", at).alias("audit"))
    )


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, position long, role string, text string, edit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Conversation:
    """What is known of the conversation that streams by: its edits first, then its turns in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.cost, self.audit = conv_id, 0, []
        self.sums, self.turns, self.least, self.most = dict.fromkeys(_COUNTS, 0), 0, None, None
        self.last: dict | None = None
        self.plan: str | None = None
        self.at = self.state = self.position = 0
        self.sha = hashlib.sha256()

    def stretch(self, r: dict) -> None:
        for c in _COUNTS:
            self.sums[c] += r[c]
        self.turns += r["turns"]
        if r["least"] is not None:
            self.least, self.most = r["least"] if self.least is None else self.least, r["most"]
        if self.last is not None:
            self.sums["illegal"] += self.last["last_sign"] + r["first_sign"] not in LEGAL
            self.turns -= r["first_turn"] is not None and self.last["last_turn"] == r["first_turn"]
        self.last = r
        self.cost += r["cost"]
        self.audit.append(r["audit"])

    def say(self, role: str, text: str, edit: str) -> tuple:
        self.sha.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
        self.position += 1
        return self.conv_id, self.position - 1, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        """The turns put in before the next turn, or at the end."""
        if self.plan is None:
            self.plan = "".join(self.audit)
        while self.at < len(self.plan) and self.plan[self.at] == "I":
            self.at, self.state = self.at + 1, TURN[self.state]
            yield self.say(NAME[self.state], "", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit, self.at = self.plan[self.at], self.at + 1
        if edit == "K":
            self.state = FITS[self.state, KIND[role[:1]]]
            yield self.say(role, text, edit)
        elif edit == "R":
            self.state = TURN[self.state]
            yield self.say(NAME[self.state], text, edit)

    def report(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, *self.sums.values(), self.cost, "".join(self.audit), self.sha.hexdigest()


def played(turns: DataFrame, every: DataFrame, parts: int, as_turns: bool) -> DataFrame:
    """The edits put on the texts: a conversation's edits and then its turns in order stream through one task, as its SHA-256 needs. Texts are shuffled once."""
    texts = marked(turns).select("conv_id", F.lit(2).alias("step"), F.lit(0).alias("part"), "turn", "role", "mark", "text")
    plan = edits(turns, parts).withColumn("step", F.lit(1))
    known = every.select("conv_id", F.lit(0).alias("step")).distinct()
    order = ["conv_id", "step", "part", "turn", "role", "mark"]
    ddl = _TURNS if as_turns else _REPORT
    types = {"long": pa.int64(), "string": pa.string()}
    out_schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None

        def put(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

        def done(c: Conversation) -> Iterator[tuple]:
            last = list(c.inserts())
            yield from last if as_turns else [c.report()]

        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    if now is not None:
                        out += done(now)
                    now = Conversation(r["conv_id"])
                if r["step"] == 1:
                    now.stretch(r)
                elif r["step"] == 2:
                    said = list(now.turn(r["role"], r["text"]))
                    out += said if as_turns else []
            if out:
                yield put(out)
        if now is not None:
            out = list(done(now))
            if out:
                yield put(out)

    both = known.unionByName(plan, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    return both.repartition(F.coalesce("conv_id", F.lit(-1))).sortWithinPartitions(*order).mapInArrow(run, ddl)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repair_report(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by `turn`, nulls first, then role and the text's SHA-256, so
    equal ones stand together. A null role or text is one space, so it is of no
    legal kind or blank. A role counts by its first letter; an empty role has none
    and is reroled or deleted. Turns without conv_id are one conversation. Other
    columns are ignored. `every` names conversations that have a row in any case (those
    of turns if not given); one without turns has zeros, an empty audit and the hash
    of the empty string. Texts of any length are moved, not gathered.

    A conversation may hold any share of all turns: its turns are sorted by ranges, a
    byte each, and solved range by range, the costs of passing a range being chained;
    only its result, one string and one hash, is made in one task, from a stream.
    """
    return played(turns, turns if every is None else every, _parts(turns), False)


def repair_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K kept, R with another role, I put in). As repair_report otherwise."""
    return played(turns, turns, _parts(turns), True)


def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(damage(turns), turns)
