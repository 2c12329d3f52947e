"""Every query with SQL gives the rows that an independent engine gives, at the smallest scale."""

import duckdb
import pytest

from pairloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine = registry.queries()[name](spark, SF).toPandas()
    other = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, other))
    assert len(a) == len(b)
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if a[c].dtype.kind == "f":
            same |= (a[c] - b[c]).abs() < 2e-6
        assert same.all(), c
