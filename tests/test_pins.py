"""The pin of typed units on pools written out."""

from clauseq.operators import stages


def test_a_pin_takes_the_last_seat_and_its_clause_follows(spark):
    schema = "query_id long, pos int, id string, doc string, anchor string, family string, unit_id string, block string, score double, asked string"
    ask = "which figure shows it"
    prose = lambda q, pos, id, doc="d", anchor="1": (q, pos, id, doc, anchor, "0", None, None, 10.0 - pos, ask)
    unit = lambda q, pos, id, anchor="2", family="0": (q, pos, id, "d", anchor, family, id, "figure", 10.0 - pos, ask)
    three = lambda q: [prose(q, 1, "a"), prose(q, 2, "b"), prose(q, 3, "c")]
    rows = [
        *three(1), unit(1, 4, "other", family="9"), unit(1, 5, "u"), prose(1, 6, "k", anchor="2"), prose(1, 7, "later", anchor="2"),
        prose(2, 1, "a"), unit(2, 2, "u"), prose(2, 3, "c"), unit(2, 4, "v"),  # the best is in the pool
        *three(3),  # no unit
        prose(4, 1, "a", anchor="2"), prose(4, 2, "b"), prose(4, 3, "c"), unit(4, 4, "u"), prose(4, 5, "k", anchor="2"),  # its clause is in the pool
        *three(5), unit(5, 4, "u", anchor=""), prose(5, 5, "k", anchor=""),  # it stands nowhere
        *three(None), unit(None, 4, "u"),
    ]
    hits = stages.as_pool(spark.createDataFrame(rows, schema))
    pool = hits.where("pos <= 3").drop("block", "asked")
    got = stages.typed_pin(pool, hits, hits.drop("block", "asked"), ["0"], True, 3)
    seats = {}
    for r in sorted(got.collect(), key=lambda r: (str(r["query_id"]), r["pos"])):
        seats.setdefault(r["query_id"], []).append((r["pos"], r["id"], round(r["score"], 6)))
    same = [(1, "a", 9.0), (2, "b", 8.0), (3, "c", 7.0)]
    assert seats == {
        1: [(1, "a", 9.0), (2, "b", 8.0), (3, "u", 5.0), (4, "k", 2.8)], 2: [(1, "a", 9.0), (2, "u", 8.0), (3, "c", 7.0)], 3: same,
        4: [(1, "a", 9.0), (2, "b", 8.0), (3, "u", 6.0)], 5: [(1, "a", 9.0), (2, "b", 8.0), (3, "u", 6.0)], None: same,
    }
    assert got.columns == pool.columns and got.schema["pos"].dataType == pool.schema["pos"].dataType
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a query's rows are put together once


def test_a_pin_reads_the_pool_once_and_sorts_it_once(spark):
    from clauseq import retrieval

    plan = retrieval.typed_pin(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("FileScan parquet [l_orderkey") == 1
    hits = stages.as_pool(spark.createDataFrame([(1, 1, "a", "figure", 1.0, "which")], "query_id long, pos int, id string, block string, score double, asked string"))
    bare = hits.drop("block", "asked")
    plan = stages.typed_pin(bare, hits, bare, ["0"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
