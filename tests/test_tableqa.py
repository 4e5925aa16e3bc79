"""Questions to typed tables on cases written out."""

from clauseq.operators import tableqa

TABLES = {
    "/table/mpe_tiers": ("Maximum permissible errors (see 3.5)", [("accuracy_class", "string", ""), ("load_gt", "number", "v"), ("load_max", "number", "v"), ("mpe", "number", "v")],
                         [("A", "0", "50 000", "0,5"), ("A", "50000", "200000", "1"), ("A", "200000", None, "1.5"), ("B", "0", "5000", "0.5"), ("b ", "5000", "null", "1")]),
    "/table/warm_up": ("Warm-up times", [("temperature_min", "number", "degC"), ("temperature_max", "number", "degC"), ("class_c", "integer", "s"), ("class_cd", "integer", "s")],
                       [("-10", "20", "30", "45"), ("20", "40", "20", "1,200"), ("40", "", "x", "10")]),
    "/table/empty": ("Nothing of errors", [("mpe", "number", "v")], []),
}
BOTH = ["/table/mpe_tiers", "/table/warm_up", "/table/empty"]
CASES = [
    ("How many rows do the mpe tiers have?", BOTH, ("count", "/table/mpe_tiers", None, "5", None, None)),
    ("How many accuracy classes are in the mpe tiers?", BOTH, ("count", "/table/mpe_tiers", "accuracy_class", "2", None, None)),
    ("the largest mpe of the tiers", BOTH, ("max", "/table/mpe_tiers", "mpe", "1.5", "v", None)),
    ("the smallest warm-up of class cd", BOTH, ("min", "/table/warm_up", "class_cd", "10.0", "s", None)),
    ("highest warm-up time of class c", BOTH, ("max", "/table/warm_up", "class_c", "30.0", "s", None)),
    ("What is the lowest temperature of warm-up?", BOTH, ("min", "/table/warm_up", "temperature_min", "-10.0", "degC", None)),
    ("mpe for 60,000 v in class A", BOTH, ("lookup", "/table/mpe_tiers", "mpe", "1.0", "v", 1)),
    ("mpe for 50000 v in class a", BOTH, ("lookup", "/table/mpe_tiers", "mpe", "0.5", "v", 0)),
    ("mpe for 900000 v in class B", BOTH, ("lookup", "/table/mpe_tiers", "mpe", "1.0", "v", 4)),
    ("mpe for 100 v", BOTH, ("lookup", "/table/mpe_tiers", "mpe", "0.5", "v", 0)),
    ("mpe for 100 v in class Z", BOTH, None),
    ("at 20 degC, class cd", BOTH, ("lookup", "/table/warm_up", "class_cd", "45.0", "s", 0)),
    ("at 30 degC, class c", BOTH, ("lookup", "/table/warm_up", "class_c", "20.0", "s", 1)),
    ("at 50 degC in class c", BOTH, ("lookup", "/table/warm_up", "class_c", "x", "s", 2)),
    ("at 30 degC", BOTH, ("lookup", "/table/warm_up", None, None, None, 1)),
    ("How many are there?", BOTH, None),  # several tables, no points
    ("How many are there?", ["/table/warm_up"], ("count", "/table/warm_up", None, "3", None, None)),
    ("How many are there?", ["/table/empty"], None),
    ("Hello", BOTH, None), (None, BOTH, None), ("How many rows", [], None),
]


def test_answers(spark):
    tables = spark.createDataFrame([(k, t) for k, (t, *_) in TABLES.items()], "table_id string, title string")
    columns = spark.createDataFrame([(k, i, *c) for k, (_, cols, _) in TABLES.items() for i, c in enumerate(cols)], "table_id string, col int, name string, type string, unit string")
    cells = spark.createDataFrame([(k, r, c, v) for k, (*_, rows) in TABLES.items() for r, row in enumerate(rows) for c, v in enumerate(row)], "table_id string, row int, col int, raw string")
    asked = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CASES)], "query_id int, text string")
    candidates = spark.createDataFrame([(i, t, p) for i, (_, ts, _) in enumerate(CASES) for p, t in enumerate(ts)], "query_id int, table_id string, place int")
    got = {r["query_id"]: (r["operation"], r["table_id"], r["column"], r["value"], r["unit"], r["row"]) for r in tableqa.answer(asked, candidates, tables, columns, cells).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: want for i, (*_, want) in enumerate(CASES)}


def test_no_cells_and_no_questions_are_sent_to_every_task(spark):
    """Only what tables and columns bound is; Spark takes cells and questions for as small as the files they came from."""
    from clauseq import lookups

    lines = lookups.table_answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    sent = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            sent += 1
            for part in lines[i:end]:
                if "HashAggregate" in part:
                    break
                assert "explode(array(struct(col, 0, raw" not in part and "FileScan parquet [query_id" not in part
    assert sent and len(lines) < 1000
