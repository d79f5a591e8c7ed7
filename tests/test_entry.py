"""The driver's contract, and each query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from nestql import queries as dialect

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def value(x):
    if x is None or x != x:
        return None
    return round(x, 9) if isinstance(x, float) else str(x) if not isinstance(x, (int, bool)) else x


@pytest.mark.parametrize("name", sorted(dialect.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    df = dialect.queries()[name](spark, data)
    want = duck.execute(dialect.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([value(r[n]) for n in sorted(names)]) for r in df.collect())
    assert got == sorted(repr([value(v) for _, v in sorted(zip(names, r, strict=True))]) for r in want.fetchall())
