"""Every query with an SQL twin, against DuckDB on the small test tables; and every query's schema is stable."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def plain(rows):
    def one(x):
        return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(one(x) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = duck.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({SQL[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
