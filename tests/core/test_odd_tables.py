"""Queries against their SQL on small tables that the driver's small ones don't stand for."""

from __future__ import annotations

import duckdb

from orrery.plans import queries as plans

from .test_queries import rows, same


def agrees(spark, folder, name, **tables):
    """Whether a query agrees with its SQL on these tables: their rows as SQL for DuckDB."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = plans.queries()[name](spark, str(folder))
    out = con.execute(plans.oracle_sql()[name])
    want = rows([d[0] for d in out.description], out.fetchall())
    found = rows(got.columns, got.collect())
    con.close()
    return bool(want) and len(found) == len(want) and all(map(same, map(tuple, found), map(tuple, want)))


PART = "SELECT k::BIGINT AS p_partkey, (1 + k % 50)::INT AS p_size, 900.0::DOUBLE + k % 7 AS p_retailprice FROM"


def test_places_of_the_last_station(spark, tmp_path):
    """Stations are numbered from one up to the number of suppliers, whose own numbers begin at nought."""
    assert agrees(
        spark, tmp_path, "dom31_rations", part=f"{PART} range(60) r(k)", supplier="SELECT k::BIGINT AS s_suppkey, 1 AS s_nationkey FROM range(6) r(k)",
        customer="SELECT k::BIGINT AS c_custkey, (k % 25)::INT AS c_nationkey, CASE WHEN k % 3 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS c_mktsegment FROM range(300) r(k)",
        lineitem="SELECT k::BIGINT AS l_orderkey, k % 60 AS l_partkey, k % 6 AS l_suppkey FROM range(200) r(k)",
    )


def test_numbers_of_wares_that_no_part_makes(spark, tmp_path):
    """They begin at a million and may be those of parts."""
    assert agrees(spark, tmp_path, "dom72_recipes", part=f"{PART} (SELECT unnest([3, 50, 51, 100, 1000050, 1000100, 1000101]) AS k)")
