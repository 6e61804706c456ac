"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from sparkwarden.plans import detection, generated, packages, relational

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PLANS = (detection, relational, packages, generated)
QUERIES, ORACLE = ({k: v for m in PLANS for k, v in getattr(m, x).items()} for x in ("QUERIES", "ORACLE"))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = tables.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLE) == {"rf_score"}
