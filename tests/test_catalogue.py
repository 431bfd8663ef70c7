"""Every query of the catalogue on the smallest tables, against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from scriptorium.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


def norm(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in SQL:
        got = con.execute(SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in df.columns) for r in got.fetchall())
        assert Counter(tuple(norm(v) for v in r) for r in rows) == want
