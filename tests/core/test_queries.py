"""Every registered query of the library against its SQL in DuckDB, on the tables that the driver compares."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from orrery.plans import queries as plans

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool):
        return None if math.isnan(x) else float(x) + 0.0
    return x if x is None else str(x)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, tuple) and isinstance(b, tuple) else a == b


def coarse(row):
    """What rows are ordered by: numbers to five digits, so that the last ones don't decide."""
    return repr([f"{x:.5g}" if isinstance(x, float) else coarse(x) if isinstance(x, tuple) else x for x in row])


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in found), key=coarse)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    found = rows(got.columns, got.collect())
    if name not in ORACLES:
        assert got.columns
        return
    out = duck.execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(got.columns)
    want = rows(columns, out.fetchall())
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert all(map(same, a, b)), (a, b)
