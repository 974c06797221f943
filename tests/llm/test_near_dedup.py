from __future__ import annotations

import random

import numpy as np
import pytest

from sievecraft.llm import near_dedup as nd


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent, width):
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, copies=60, short=False):
    """Groups of exact and near copies of many rates around the threshold, a passage that many share, and singles."""
    rng = random.Random(seed)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passage, out = fresh(40), []
    for group in range(6):
        base = fresh(rng.choice([8, 30, 60, 120]))
        for _ in range(copies if group == 0 else 8):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                own[rng.randrange(len(own))] = fresh(1)[0]
            out.append(own)
    out += [fresh(rng.randrange(5, 40)) + passage + fresh(rng.randrange(5, 40)) for _ in range(30)]
    out += [fresh(rng.randrange(1, 5)) for _ in range(10)] + [["a"], ["a"], ["A", "b"], ["a", "b"]]
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("percent", "width", "short"), [(85, 3, 24), (85, 3, 2), (80, 5, 24)])
def test_matches_brute_force(documents, monkeypatch, percent, width, short):
    monkeypatch.setattr(nd, "SHORT", short)
    docs = corpus(percent + short)
    got = nd.near_duplicates(documents([(i, t, "en", "s") for i, t in docs]), percent, width).collect()
    want = brute(docs, percent, width)
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(docs) - 40


def test_long_lists_in_several_blocks(documents, monkeypatch):
    monkeypatch.setattr(nd, "SHORT", 2)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    docs = corpus(11, copies=90)
    got = nd.near_duplicates(documents([(i, t, "en", "s") for i, t in docs]), 85, 3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 85, 3)


def test_least_matches_bounds_the_miss():
    import math

    for percent in (50, 80, 85, 95):
        t, p = nd.least_matches(percent), percent / 100
        tail = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(t))
        assert tail <= nd.MISS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    seen = []
    for _ in range(60):
        other = np.concatenate([base[rng.permutation(1000)[:850]], rng.integers(0, 2**63, 150, dtype=np.uint64)])
        seen.append((nd.signature(np.unique(base)) == nd.signature(np.unique(other))).mean())
    assert abs(np.mean(seen) - 850 / 1150) < 0.03


def test_keep_first_keeps_columns_and_one_of_each(documents):
    docs = documents([(5, "a b c d e f g h", "en", "s"), (3, "a b c d e f g h", "de", "t"), (9, "other words are here now ok fine", "en", "s")])
    kept = nd.keep_first(docs, 85, 3)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9]


def as_documents(rows, percent, width):
    """Brute force over (id, text) rows: (id, n, component) per row; texts of one id are one document."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            if sets[a] and sets[b] and (linked or (rows[a][0] is not None and rows[a][0] == rows[b][0])):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def test_ids_with_several_texts_and_rows_without_id(documents):
    rng = random.Random(5)
    fresh = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    a, b, c = fresh(60), fresh(60), fresh(60)
    near = lambda w: [*w[:-1], fresh(1)[0]]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(a)), (None, c), (None, near(c)), (None, c), (7, fresh(9)), (8, a), (8, c), (None, fresh(30)), (9, []), (None, [])]
    for drop in (set(), {9, 10}):
        own = [(i, " ".join(w)) for k, (i, w) in enumerate(rows) if k not in drop]
        table = documents([(i, t, "en", "s") for i, t in own])
        got = nd.near_duplicates(table, 85, 3).collect()
        order = lambda x: tuple((v is None, v) for v in x)
        assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=order) == sorted(as_documents(own, 85, 3), key=order)
        kept = sorted([(r["doc_id"], r["text"]) for r in nd.keep_first(table, 85, 3).collect()], key=order)
        # one row per component: id 1 (one of its texts), 7, the lone text without id, the rows without words; c's component without any id
        assert [i for i, _ in kept] == ([1, 7, 9, None, None] if not drop else [1, 7, 9, None, None, None])


@pytest.mark.parametrize("strays", [[1], [1, 1, 1], [40, 3, 1]])
def test_one_large_component_and_strays(spark, monkeypatch, strays):
    """Every two members of different components meet; a component's own blocks aren't compared with each other."""
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    component = [0] * 200 + [1000 + k for k, n in enumerate(strays) for _ in range(n)]
    rows = [(7, k, c, 10) for k, c in enumerate(component)]
    long_ = spark.createDataFrame(rows, "token long, key long, component long, size int")
    sets = spark.createDataFrame([(k, b"x") for k in range(len(component))], "key long, shingles binary")
    groups = {}
    for r in nd._pairs_in_blocks(long_, sets).collect():
        groups.setdefault((r["low"], r["high"]), set()).add(r["key"])
    met = {(x, y) for own in groups.values() for x in own for y in own if component[x] < component[y]}
    assert met == {(x, y) for x in range(len(component)) for y in range(len(component)) if component[x] < component[y]}
    if max(strays) == 1:  # one mixed block: each member is copied once
        assert sum(len(own & set(range(200))) for own in groups.values()) == 200


def test_recall_at_the_threshold(documents):
    """Pairs right at and over the threshold, one by one: all are found."""
    rng = random.Random(13)
    docs = []
    for k in range(300):
        base = [f"p{k}x{j}" for j in range(rng.choice((20, 60, 150)))]
        other = list(base)
        for _ in range(rng.randrange(1, 1 + len(base) // 30)) if len(base) >= 30 else range(1):
            other[rng.randrange(len(other))] = f"q{rng.randrange(10**9)}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = brute_pairs(docs, 85, 3)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(documents([(i, t, "en", "s") for i, t in docs]), 85, 3).collect()}
    assert len(want) > 100 and {k for k in got if got[k] != k} == want


def brute_pairs(docs, percent, width):
    text = dict(docs)
    out = set()
    for i in range(0, len(docs), 2):
        a, b = shingles(text[i], width), shingles(text[i + 1], width)
        if 100 * len(a & b) >= percent * len(a | b):
            out.add(i + 1)
    return out


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (1, "a b c d", 5), (2, "a b c d", 7), (3, None, 1), (3, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({"row": nd.F.lit(1), "rank": nd.F.lit(2), "hash": nd.F.lit(3)})
    kept = nd.keep_first(table, 85, 3)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 3]


def test_odd_rows_and_empty_tables(odd, empty):
    out = sorted((tuple(r) for r in nd.near_duplicates(odd, 85, 3).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=lambda r: (r[0] is not None, r))
    assert out[1:] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 5, 7, True), (8, 1, 8, True), (9, 8, 9, True)]
    assert out[0] == (None, 2, None, True)
    assert nd.near_duplicates(empty).count() == 0
    kept = nd.keep_first(odd, 85, 3)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
