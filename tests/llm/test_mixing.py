from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievecraft.llm import mixing
from sievecraft.llm.queries import mixed


def cheapest(patterns, demand, epochs):
    """Most flow, then least cost, by trying all flows (tiny cases)."""
    names = list(demand)
    best = None
    choices = [[x for x in itertools.product(range(epochs * size + 1), repeat=len(own)) if sum(x) <= epochs * size] for own, size in patterns]
    for pick in itertools.product(*choices):
        got = dict.fromkeys(names, 0)
        for (own, _), x in zip(patterns, pick, strict=True):
            for s, v in zip(own, x, strict=True):
                got[s] += v
        if any(got[s] > demand[s] for s in names):
            continue
        cost = sum(sum(max(0, sum(x) - e * size) for e in range(1, epochs)) for (_, size), x in zip(patterns, pick, strict=True))
        key = (-sum(got.values()), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_is_a_cheapest_maximum():
    rng = random.Random(4)
    for _ in range(40):
        names = ["a", "b", "c"]
        patterns = [(tuple(sorted(rng.sample(names, rng.randrange(1, 3)))), rng.randrange(0, 3)) for _ in range(3)]
        demand = {s: float(rng.randrange(0, 5)) for s in names}
        given = mixing.flow(patterns, demand, 2)
        assert all(0 <= x <= 2 * size for x, (_, size) in zip(given, patterns, strict=True))
        cost = sum(max(0, x - size) for x, (_, size) in zip(given, patterns, strict=True))
        assert (-sum(given), cost) == cheapest(patterns, demand, 2)


def plain_targets(sizes, total, weights=mixing.WEIGHTS, epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while len(full) < len(sizes):
        unit = (total - sum(epochs * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and weight[s] * unit > epochs * sizes[s]}
        if not more:
            break
        full |= more
    return {s: float(epochs * sizes[s]) if s in full else weight[s] * unit for s in sizes}


def targets_of(spark, sizes, total):
    rows = mixing.weighted(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    return {r["source"]: r["target"] for r in mixing.targets(rows, total).collect()}


def test_targets_stop_and_share_again(spark):
    got = targets_of(spark, {"a": 10, "b": 100, "c": 100, None: 90}, 300)
    assert got["a"] == 30 and abs(sum(got.values()) - 300) < 1e-9
    assert [round(got[k] / got["b"], 6) for k in ("b", "c", None)] == [1, 0.5, 2.5]
    assert targets_of(spark, {}, 0) == {} and targets_of(spark, {"a": 0}, 0) == {"a": 0.0}


def test_targets_and_order_over_ranges(spark, monkeypatch):
    """Weights follow the whole order of code points, also where it is dealt to several ranges."""
    monkeypatch.setattr(mixing, "RANGE", 7)
    rng = random.Random(8)
    sizes = {"".join(rng.choices("aZ\U0001f600\uffee\u00e4", k=4)): int(10 ** rng.uniform(0, 4)) for _ in range(60)} | {None: 5, "": 9}
    total = sum(sizes.values())
    got, want = targets_of(spark, sizes, total), plain_targets(sizes, total)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_many_sources_match_the_flow(documents, monkeypatch):
    """The closed form of single sources, and the plan without a broadcast, give what the driver's flow gives."""
    rng = random.Random(3)
    docs = documents([(k, " ".join(["w"] * rng.randrange(0, 30)), "en", "hot" if k % 3 else f"s{rng.randrange(40)}") for k in range(900)])
    whole = sorted(map(tuple, mixed(docs).collect()))
    monkeypatch.setattr(mixing, "HOT", 5)
    monkeypatch.setattr(mixing, "CUT_ROWS", 4)
    got = mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got) == [r[:4] for r in whole]
    sizes = {}
    for r in got:
        sizes[r["source"]] = r["source_size"]
    want = plain_targets(sizes, sum(sizes.values()))
    given = dict(zip(sizes, mixing.flow([((s,), n) for s, n in sizes.items()], want), strict=True))
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        least = min((r["size"] for r in mine if r["size"]), default=0)
        assert abs(sum(r["taken"] for r in mine) - given[s]) <= max(least, 30)


def test_null_ids_share_a_fate_and_too_many_patterns_raise(documents, monkeypatch):
    docs = documents([(None, "w w", "en", "a") for _ in range(700)] + [(k, "w", "en", "b") for k in range(50)])
    got = [(r["doc_id"], r["taken"]) for r in mixed(docs).collect()]
    assert len(got) == 750 and len({x for i, x in got if i is None}) == 1
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    assert mixed(docs).count() == 750
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(docs, sources=F.array(F.lit("x"), F.col("source")))


def table(documents, n=4000):
    rng = random.Random(6)
    return documents([(k, " ".join(["w"] * rng.randrange(1, 30)), "en", rng.choices(["a", "b", "c", None], [60, 20, 10, 10])[0]) for k in range(n)])


def test_taken_words_meet_the_targets(documents):
    docs = table(documents)
    rows = mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 4000 and all(0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    for s in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2


def test_reruns_agree_and_seeds_differ(documents):
    docs = table(documents)
    one, again, other = (sorted(map(tuple, mixing.mix(docs.repartition(n), seed=s).rows.select("doc_id", "taken").collect())) for n, s in ((3, 1), (7, 1), (3, 2)))
    assert one == again != other


def test_cut_matches_a_sort(spark, documents):
    """The cut by digits takes the documents that a whole sort would, up to those around it."""
    docs = table(documents)
    own = mixing.mix(docs, seed=9).rows.select("doc_id", "size", "taken", F.get("sources", F.lit(0)).alias("s"))
    rows = own.withColumn("rank", F.expr("pmod(xxhash64(9, cast(doc_id as string)), 1L << 60)")).collect()
    for s in ("a", "b"):
        mine = sorted((r for r in rows if r["s"] == s), key=lambda r: r["rank"])
        times = [r["taken"] // r["size"] for r in mine]
        falls = [k for k in range(1, len(times)) if times[k] != times[k - 1]]
        assert not falls or falls[-1] - falls[0] <= mixing.CUT_ROWS


def test_overlapping_sources(documents):
    docs = table(documents, 300)
    both = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    got = mixing.mix(docs, sources=both, weights=(1.0, 4.0))
    target = {r["source"]: r["target"] for r in got.sources.collect()}
    taken = got.rows.agg(F.sum("taken")).first()[0]
    assert abs(taken - sum(target.values())) < 60


def test_odd_rows_and_empty_tables(odd, empty):
    out = mixed(odd).collect()
    assert len(out) == odd.count() and all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mixed(empty).count() == 0
    assert len({(r["doc_id"], r["taken"]) for r in out if r["doc_id"] == 4}) == 1
