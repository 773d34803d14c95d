"""Every base query against its SQL twin on the sf0.01 tables."""

import os

import duckdb
import pytest

from tessera import queries as base

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_against_sql(spark, db, name):
    got = base.queries()[name](spark, SF)
    cur = db.execute(base.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert norm(tuple(r) for r in got.select(*names).collect()) == norm(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(base.queries()) - set(base.oracle_sql())))
def test_runs(spark, name):
    assert base.queries()[name](spark, SF).count() > 0
