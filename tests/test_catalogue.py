"""Every catalogue query runs; those with an oracle equal it in DuckDB."""

import math

import duckdb
import pytest

from riskloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def key(row):
    return [("", 0.0) if v is None else ("n", round(float(v), 4)) if isinstance(v, (int, float)) and not isinstance(v, bool) else (str(v), 0.0) for v in row]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=key)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expect = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert len(got) == len(expect) > 0
    for a, b in zip(got, expect):
        assert all(map(same, a, b)), (columns, a, b)


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_without_oracle(spark, duck, name):
    """These are held against definitions in the other modules; here: they run on the tables, and what they count is all rows."""
    out = QUERIES[name](spark, SF)
    rows = out.collect()
    assert out.columns and rows
    if {"n", "bad", "bin"} <= {*out.columns}:
        n, bad = duck.execute("SELECT count(*), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem").fetchone()
        assert sum(r["n"] for r in rows) == n and sum(r["bad"] for r in rows) == bad
    if "calibrated" in out.columns:
        assert all(0 <= r["calibrated"] <= 1 for r in rows)
