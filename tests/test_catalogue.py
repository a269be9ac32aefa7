"""Every registered query against the SQL registered with it."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    if name in catalogue.SQL:
        want = db.sql(catalogue.SQL[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert norm(got) == norm([tuple(r[i] for i in order) for r in want.fetchall()])
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned_and_filtered(spark):
    plan = catalogue.QUERIES["colstore_select"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "EqualTo(l_returnflag,R)" in plan and "l_shipdate" not in plan and "Exchange" not in plan
