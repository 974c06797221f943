from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from sievecraft.llm import lm_score as lm


def brute(rows, backoff=0.4):
    """id -> (n_words, n_seen, log_score), each document against counts of the others."""
    words, pairs, total = {}, {}, 0
    for i, t in rows:
        own = (t or "").lower().split()
        words.setdefault(i, Counter()).update((["<s>"] if own else []) + own)
        pairs.setdefault(i, Counter()).update(zip(["<s>", *own], own, strict=False))
        total += len(own)
    all_words, all_pairs = Counter(), Counter()
    for i in words:
        all_words.update(words[i])
        all_pairs.update(pairs[i])
    out = {}
    for i, mine in pairs.items():
        n = max(1, total - mine.total())
        seen, score = 0, 0.0
        for (v, w), k in mine.items():
            both, before, word = all_pairs[v, w] - k, all_words[v] - words[i][v], all_words[w] - words[i][w]
            seen += k * (both > 0)
            score += k * math.log(both / before if both else backoff * word / n if word else backoff**2 / n)
        out[i] = (mine.total(), seen, score)
    return out


def corpus(n=150):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    return [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)) + ["Hot"] * (k % 7) + ["the", "end"])) for k in range(n)]


def check(spark, docs, parts=None, **how):
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in lm.score_documents(table.repartition(parts) if parts else table, **how).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    for i, (n, seen, score) in want.items():
        assert (got[i]["n_words"], got[i]["n_seen"]) == (n, seen)
        assert math.isclose(got[i]["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i]["mean_log_score"] is None) == (n == 0)


@pytest.mark.parametrize("bucket", [lm.BUCKET, 40])
def test_matches_brute_force(spark, bucket):
    check(spark, corpus(), bucket=bucket)


def test_many_chunks(spark):
    check(spark, corpus(60), parts=13, bucket=100)


def test_many_words(spark):
    names = [f"r{k}" for k in range(270_000)]
    check(spark, [(k, " ".join(names[k * 9000 : (k + 1) * 9000])) for k in range(30)] + [(30 + k, " ".join(names[k::7])) for k in range(7)])


def test_rows_of_one_id_are_one_document(spark):
    rows = [(4, "same text here"), (5, "same text"), (4, "same text here"), (6, "other words here"), (None, "only null"), (4, "same text here"), (None, "only null"), (7, ""), (7, "text here"), (8, None)]
    for parts in (1, 5):
        check(spark, rows, parts=parts, bucket=4)


def test_noise_scores_below_rare_words_below_ordinary_text(spark):
    rng = random.Random(3)
    common, rare = [f"c{k}" for k in range(300)], [f"q{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choices(common, k=79) + [rare[k], rare[k + 200]])) for k in range(200)] + [(200 + k, " ".join(rng.sample(rare, 80))) for k in range(4)]
    docs += [(300 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(80))) for k in range(4)]
    got = {r["doc_id"]: r["mean_log_score"] for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    ordinary, unusual, noise = ([v for k, v in got.items() if a <= k < b] for a, b in ((0, 200), (200, 300), (300, 400)))
    assert min(ordinary) > max(unusual) > min(unusual) > max(noise)


def test_single_document(spark):
    check(spark, [(1, "all by itself")])


def test_odd_rows_and_empty_tables(odd, empty):
    out = {r["doc_id"]: r for r in lm.score_documents(odd).collect()}
    assert set(out) == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert out[1]["n_words"] == out[2]["n_words"] == 0 and out[1]["mean_log_score"] is None
    assert out[4]["n_words"] == 6 and out[6]["n_words"] == 30_000
    assert lm.score_documents(empty).count() == 0


def test_packing_round_trip():
    import numpy as np

    x = np.array([0, 1, 255, 256, 2**40, 2**47 + 3])
    y = np.array([3, 2**63, 2**64 - 2], dtype=np.uint64)
    assert (lm._unpack(lm._pack(x, 6), 6) == x).all() and (lm._unpack_sorted(lm._pack_sorted(y)) == y).all()
