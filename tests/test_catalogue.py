"""Every catalogue query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from sievecraft.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    frame = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    at = [names.index(c) for c in frame.columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=key)
    assert sorted(map(tuple, frame.collect()), key=key) == want


def test_flagship(spark):
    rows = QUERIES["pipeline_groups"](spark, SF).collect()
    assert rows and all(r["size"] >= 2 and r["proposed_keeper"] for r in rows)
