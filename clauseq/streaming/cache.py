"""A cache of answers as state of a stream: entries expire, and a new generation of the corpus leaves the old ones behind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long an answer and a token's look-up live, in seconds; the generation where none is known.
ANSWER_TTL, TOKEN_TTL, NO_GENERATION = 6 * 3600, 45, "0"
REPLIES = "cache_key string, request_id long, ts timestamp, hit boolean, value string"


def key_material(query: Column, lang: Column | None = None, salt: Column | None = None) -> Column:
    """What an exact entry is known by: the query in lower case with single blanks, the pinned language, and what else changes the answer."""
    folded = F.btrim(F.regexp_replace(F.lower(query), r"\s+", " "))
    tail = F.lit("") if salt is None else F.when(F.coalesce(salt, F.lit("")) != "", F.concat(F.lit("|"), salt)).otherwise("")
    return F.concat(folded, F.lit("|"), F.lit("") if lang is None else F.coalesce(lang, F.lit("")), tail)


def exact_key(version: Column, generation: Column, space: Column, material: Column) -> Column:
    """The key of an entry: another version of the index or another generation of the corpus is another key."""
    return F.concat(F.lit("a:"), version, F.lit(":g"), F.coalesce(generation, F.lit(NO_GENERATION)), F.lit(":"), space, F.lit(":"), F.sha2(material, 256))


def fresh(flag: Column) -> Column:
    """Whether a request asks for a new answer: true or 1, as a text too."""
    return F.coalesce(F.lower(flag.cast("string")).isin("true", "1"), F.lit(False))


def with_generation(requests: DataFrame, generations: DataFrame) -> DataFrame:
    """requests (space and others) with the last generation of their space; generations: space, generation, since. Read anew for each batch of a stream."""
    last = generations.groupBy("space").agg(F.max_by("generation", "since").alias("generation"))
    return requests.join(last, "space", "left").withColumn("generation", F.coalesce("generation", F.lit(NO_GENERATION)))


class _Entry(StatefulProcessor):
    def __init__(self, ttl: int) -> None:
        self.ttl = pd.Timedelta(seconds=ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "value"], na_position="first", kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        value, until = held if held else (None, None)
        until, changed, out = pd.Timestamp(until) if held else None, False, []
        for r in got.itertuples(index=False):
            if r.value is None or pd.isna(r.value):
                hit = until is not None and r.ts < until and not r.fresh
                out.append((key[0], r.request_id, r.ts, hit, value if hit else None))
            else:
                value, until, changed = r.value, r.ts + self.ttl, True
        if changed:
            self.entry.update((value, until.to_pydatetime()))
            self.handle.registerTimer(int(until.timestamp() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["cache_key", "request_id", "ts", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and int(pd.Timestamp(self.entry.get()[1]).timestamp() * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield from ()

    def close(self) -> None:
        pass


def cached_answers(requests: DataFrame, ttl: int = ANSWER_TTL, late: str = "1 minute") -> DataFrame:
    """Replies to a stream of requests: cache_key, request_id, ts, hit, value.

    requests: cache_key, request_id, ts, fresh, value. A row with a value stores it
    under its key for `ttl` seconds from its ts; one without asks, and hits where an entry is
    there that its ts has not outlived, unless it asks for a fresh answer. Rows of
    one batch take effect in the order of ts, those that ask first among equals. State is
    held by key, one entry each, and let go by a timer when the watermark passes
    its end; a restart from the checkpoint finds it again. Null keys are left out.

    A session needs the RocksDB state store. Of one key a batch's rows are held at a
    time, so a hot key is bounded by what the source gives to a batch.
    """
    rows = requests.where("cache_key IS NOT NULL").select("cache_key", "request_id", "ts", F.coalesce("fresh", F.lit(False)).alias("fresh"), "value").withWatermark("ts", late)
    return rows.groupBy("cache_key").transformWithStateInPandas(_Entry(ttl), REPLIES, "append", "eventtime")
