"""Every query of the catalogue on the smallest test data, against its SQL where it has one."""

import os

import pandas as pd
import pytest

from catalens import queries as Q

SF = os.environ.get("CATALENS_TEST_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


def test_names():
    assert set(SQL) <= set(Q.queries())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = con.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
    else:
        assert len(df.columns) == len(set(df.columns))
