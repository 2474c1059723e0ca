"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from cadenza.plans import queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall()))


def test_number_words_of_large_tables(spark, tmp_path):
    ids = [None, -10_000, -5000, -4999, -7, -1, 0, 1, 24_999, 29_999, 51_281, 126_277_309, *range(10**6 - 40, 10**6 + 40), 10**9 + 4999, 10**11 + 1, 10**12]
    spark.createDataFrame([(k,) for k in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(queries.ORACLE["number_words"]).fetchall()
    got = [tuple(r) for r in queries.number_words(spark, str(tmp_path)).select("n", "words").collect()]
    assert len(got) == len(ids) and sum(n is not None and n >= 10**12 for n, _ in got) > 40
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
