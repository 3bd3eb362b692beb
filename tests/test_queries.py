"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""
import duckdb
import pytest

from textquarry.plans import catalogue
from textquarry.plans.base import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v).removesuffix("+00:00")
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalogue.ORACLES:
        sql = duck.sql(catalogue.ORACLES[name])
        assert got == rows(sql.columns, sql.fetchall())
    else:
        assert got[1]
