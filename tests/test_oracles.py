"""Every registered query with SQL, side by side with DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from masthead import queries as screening

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(screening.ORACLES))
def test_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.status for r in rows} <= {"Approved", "Rejected", "Review Needed"}
