"""Caches with a time limit, daily counters with retention, plans and uploads that go on, against plain Python."""

import datetime
import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauseq.plans import sync
from clauseq.streaming import cache
from clauseq.streaming.daily import DailyCounters

ROWS = "cache_key string, request_id long, ts timestamp, fresh boolean, value string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def test_entries_expire_and_a_restart_keeps_the_rest(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    source.mkdir()

    def batch(n, *rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"cache_key": k, "request_id": i, "ts": f"2024-01-01T00:{m:02}:{s:02}Z", "fresh": f, "value": v}) for k, i, m, s, f, v in rows))
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(source))
        q = cache.cached_answers(stream, ttl=300, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {r["request_id"]: r["value"] if r["hit"] else None for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    batch(1, ("a", 1, 0, 0, False, None), ("a", 0, 0, 1, False, "A1"), ("a", 2, 0, 2, False, None), ("a", 3, 0, 3, True, None), ("b", 0, 0, 5, False, "B1"), (None, 9, 0, 6, False, None))
    got = batch(2, ("b", 4, 4, 0, False, None), ("b", 0, 4, 30, False, "B2"), ("a", 5, 5, 0, False, None), ("a", 6, 5, 1, False, None), ("c", 7, 5, 2, False, None))
    assert got == {1: None, 2: "A1", 3: None, 4: "B1", 5: "A1", 6: None, 7: None}
    # A new query each time: what it knows comes from the checkpoint. B was stored anew, A has run out.
    got = batch(3, ("b", 8, 9, 29, False, None), ("b", 10, 9, 30, False, None), ("a", 11, 9, 0, False, None))
    assert (got[8], got[10], got[11]) == ("B2", None, None)


def test_keys_change_with_generation_language_and_salt(spark):
    rows = [("What  IS\tthis ", "en", None, "s1"), ("what is this", "en", "", "s1"), ("what is this", None, None, "s1"), ("what is this", "en", "scope", "s1"), ("what is this", "en", None, "s2"), ("what is this", "en", None, "s3")]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, lang string, salt string, space string")
    gens = spark.createDataFrame([("s1", "7", 1), ("s2", "7", 1), ("s2", "8", 2)], "space string, generation string, since int")
    key = cache.exact_key(F.lit("v3"), F.col("generation"), F.col("space"), cache.key_material(F.col("q"), F.col("lang"), F.col("salt")))
    got = {r["i"]: r["k"] for r in cache.with_generation(asked, gens).select("i", key.alias("k")).collect()}
    of = lambda gen, space, m: f"a:v3:g{gen}:{space}:{hashlib.sha256(m.encode()).hexdigest()}"
    assert [got[i] for i in range(6)] == [of(7, "s1", "what is this|en")] * 2 + [of(7, "s1", "what is this|"), of(7, "s1", "what is this|en|scope"), of(8, "s2", "what is this|en"), of(0, "s3", "what is this|en")]
    flags = spark.createDataFrame([("true",), ("1",), ("TRUE",), ("yes",), (None,)], "x string").select(cache.fresh(F.col("x")).alias("f"))
    assert [r["f"] for r in flags.collect()] == [True, True, True, False, False]


def test_daily_counters_restart_compact_and_retain(spark, tmp_path):
    table = DailyCounters(spark, str(tmp_path / "c"), ["kind"])
    assert table.rows() is None and table.retain(datetime.date(2024, 6, 1)) == []

    def events(*rows):
        return spark.createDataFrame([(k, datetime.datetime(2024, m, d, 12)) for k, m, d in rows] + [("x", None)], "kind string, ts timestamp")

    def stored():
        return {(r["kind"], r["day"].isoformat()): r["used"] for r in table.rows().collect()}

    one, two, three = [("a", 1, 1), ("a", 1, 1), ("b", 3, 1)], [("a", 1, 1), ("b", 5, 2)], [(None, 5, 2)]
    table.add(events(*one), 0)
    table.add(events(*two), 1)
    table.add(events(*two), 1)  # the same batch again
    table.add(events(*three), 2)
    want = Counter((k, f"2024-{m:02}-{d:02}") for k, m, d in one + two + three)
    assert stored() == want
    table.compact(1)
    table.add(events(*one), 0)  # a batch that the sum stands for
    assert stored() == want and sorted(x.name for x in (tmp_path / "c").iterdir()) == ["batch=2", "sum=1"]
    assert table.retain(datetime.date(2024, 5, 30)) == ["2024-01-01"]
    assert table.retain(datetime.date(2024, 5, 30)) == [] and stored() == {k: v for k, v in want.items() if k[1] > "2024-01-01"}


def test_counters_follow_a_stream(spark, tmp_path):
    table, source = DailyCounters(spark, str(tmp_path / "c"), ["kind"]), tmp_path / "in"
    for n in range(3):
        spark.createDataFrame([("a", datetime.datetime(2024, 1, n + 1))] * (n + 1), "kind string, ts timestamp").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        assert table.follow(stream, str(tmp_path / "check")).awaitTermination(120) is not False
    assert {r["day"].day: r["used"] for r in table.rows().collect()} == {1: 1, 2: 2, 3: 3}


def test_plan_and_drift(spark):
    h = lambda t: hashlib.sha1((t or "").encode()).hexdigest()[:16]
    done = spark.createDataFrame([("same", h("x")), ("other", h("old")), ("gone", h("y")), ("bare", None), ("null", h(None))], "id string, hash string")
    chunks = spark.createDataFrame([("same", "x"), ("other", "new"), ("fresh", "z"), ("bare", "b"), ("null", None)], "id string, text string")
    assert {r["id"]: (r["action"], r["hash"]) for r in sync.embed_plan(done, chunks).collect()} == {
        "same": ("keep", h("x")), "other": ("changed", h("new")), "fresh": ("new", h("z")), "gone": ("delete", None), "bare": ("keep", h("b")), "null": ("keep", h(None))
    }
    pins = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", "1", 5), ("d", "1", 5), ("n", None, None)], "key string, source_hash string, items int")
    now = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", "1", 6), ("e", "1", 5), ("n", None, None)], "key string, source_hash string, items int")
    assert {r["key"]: r["state"] for r in sync.drift(pins, now).collect()} == {"a": "current", "b": "moved", "c": "count moved", "d": "gone", "e": "never indexed", "n": "current"}


def test_an_upload_goes_on_where_it_stopped(spark, tmp_path):
    rows, sent, state, down = spark.range(1000).withColumn("v", F.col("id") * 2), [], str(tmp_path / "state"), [4]

    def send(batch, n):
        if n in down:
            down.clear()
            raise OSError("the line is down")
        sent.append((n, [r["id"] for r in batch.collect()]))

    with pytest.raises(OSError):
        sync.upload(rows, send, state)
    assert len(sent) == 4 and (tmp_path / "state").exists()
    assert sync.upload(rows.repartition(7), send, state) == 6 and not (tmp_path / "state").exists()
    assert sorted(x for _, ids in sent for x in ids) == list(range(1000)) and [n for n, _ in sent] == list(range(10))
    assert sync.upload(rows.limit(0), send, state) == 1
