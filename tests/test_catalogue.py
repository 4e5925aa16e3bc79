"""Each registered query gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries of all modules
import clauseq.catalogue as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalogue.SQL[name])
    cols = [c[0] for c in want.description]
    want = sorted(map(str, ([plain(v) for v in r] for r in want.fetchall())))
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(map(str, ([plain(v) for v in r] for r in df.select(*cols).collect())))
    assert got == want
