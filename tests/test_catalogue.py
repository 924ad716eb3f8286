"""Every catalogued query against its SQL, on the smallest tables."""

import duckdb
import pytest

from brookmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "customer lineitem nation orders part region supplier events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(rows, names, order):
    at = [names.index(c) for c in order]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    expected = duck.sql(catalogue.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    assert _rows(df.collect(), df.columns, order) == _rows(expected.fetchall(), expected.columns, order)
