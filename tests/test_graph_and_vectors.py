from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.config import EngineConfig
from sievecraft.operators.bandjoin import band_pairs
from sievecraft.operators.components import connected_components
from sievecraft.operators.grouping import build_groups, no_group_hint
from sievecraft.operators.vectors import knn, neighbour_percentiles


@pytest.mark.parametrize("seed", range(4))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)] + [(5, None), (None, 6)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: root(k) for k in list(parent)} and len(got) == len(parent)


def test_components_of_strings_and_of_nothing(spark):
    got = connected_components(spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(spark, n=60, dim=8):
    x = np.random.default_rng(5).normal(size=(n, dim))
    x[10] = x[11] = x[12]
    return x, spark.createDataFrame([(f"k{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("none", None)], "media_key string, vector array<float>")


@pytest.mark.parametrize("least", [None, 0.4])
def test_knn_by_blocks_equals_broadcast_and_brute_force(spark, least):
    x, table = vectors(spark)
    cfg = EngineConfig()
    one = sorted(map(tuple, knn(table, 5, least, cfg).collect()))
    two = sorted(map(tuple, knn(table, 5, least, replace(cfg, broadcast_vector_bytes=0, vector_block_rows=13)).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two])
    f = x.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    want = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        want |= {(f"k{i:03d}", f"k{j:03d}") for j in order if least is None or sims[i, j] >= least}
    assert {r[:2] for r in one} == want


def test_percentiles_of_an_empty_table(spark):
    assert neighbour_percentiles(knn(vectors(spark)[1].limit(0), 3)).first()["n"] == 0


def test_band_pairs_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", rng.choice([None, rng.randrange(-50, 400)])) for i in range(150)]
    for window in (0, 7, 60):
        got = {(r["a"], r["b"], r["gap"]) for r in band_pairs(spark.createDataFrame(rows, "media_key string, t long"), window).collect()}
        want = {(a, b, tb - ta) for a, ta in rows for b, tb in rows if ta is not None and tb is not None and a != b and 0 <= tb - ta <= window and (tb > ta or a < b)}
        assert got == want


def test_groups_without_vectors_and_without_times(spark):
    photos = spark.createDataFrame([(f"k{i}", None, False, False, True) for i in range(4)], "media_key string, timestamp long, excluded boolean, is_video boolean, embedded boolean")
    same = spark.createDataFrame([("k0", [1.0, 0.0]), ("k1", [1.0, 0.01]), ("k2", [0.0, 1.0])], "media_key string, vector array<float>")
    found = build_groups(photos, same)
    assert found.counters == {"time_pairs": 0, "ann_pairs": 2, "groups": 1, "members": 2}
    assert build_groups(photos, same.limit(0)).counters == {"time_pairs": 0, "ann_pairs": 0, "groups": 0, "members": 0}
    assert no_group_hint(None) is None and no_group_hint(0.5) == 0.88 and no_group_hint(0.95) == pytest.approx(0.93)


def test_vector_plan_reads_only_what_it_needs(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(F.col("event_type") == "view").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
