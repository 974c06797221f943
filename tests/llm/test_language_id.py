from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sievecraft.llm import language_id as li

SYLLABLES = {"aa": "th er on an re he in ed nd ha at en".split(), "bb": "ción os ar ue ra ó es que do ñ".split(), "cc": "ein sch ung lich ü ä ver ge ach ß".split()}


def corpus(n=240):
    rng = random.Random(1)
    word = lambda s: "".join(rng.choices(s, k=rng.randrange(1, 4)))
    names = list(SYLLABLES)
    return [(k, " ".join(word(SYLLABLES[names[k % 3]]) for _ in range(rng.randrange(3, 60))), names[k % 3], "s") for k in range(n)]


def test_held_out_accuracy(documents):
    docs = documents(corpus())
    model = li.train(docs, F.col("doc_id") % 4 != 1)
    out = li.add_language(docs, model, "out").select("doc_id", "lang", "out.*").toDF("doc_id", "want", "lang", "score").collect()
    held = [r for r in out if r["doc_id"] % 4 == 1]
    assert sum(r["want"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 < r["score"] <= 1 for r in out)


def test_presence_is_a_set_of_ngrams():
    assert (li.presence("abab abab") == li.presence("abab  ABAB!")).all()
    assert len(li.presence("ab")) == len({" ", "a", "b", " a", "ab", "b ", " ab", "ab ", " ab "})
    whole = li.presence("x" * 10 + "abc" * 100_000)
    assert len(whole) < 60


def test_scores_are_the_kernel_expansion():
    """Weights per n-gram give what kernel ridge regression on whole texts gives, by its definition.

    With every text a landmark the map loses nothing, so the regression is that of the kernel: the margins minimise the
    weighted squared error and the ridge on the norm, which the solution in the span of the texts does.
    """
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, li.BUCKETS // 500, 150)) * 500 for _ in range(15)]
    new = [np.unique(rng.integers(0, li.BUCKETS // 500, 90)) * 500 for _ in range(5)]
    langs = [["a", "b", "c"][k % 3] for k in range(13)] + ["a", "a"]
    model = li.fit(rows, langs, landmarks=15)
    kernel = lambda p, q: len(set(p) & set(q)) / np.sqrt(len(p) * len(q))
    whole = np.array([[kernel(p, q) for q in rows] for p in rows])
    weight = np.array([len(langs) / (3 * langs.count(x)) for x in langs])
    y = np.array([[1.0 if x == m else -1.0 for m in "abc"] for x in langs])
    # Stationary point in (alpha, bias) of sum w (K alpha + b - y)^2 + ridge * n / 10 * alpha' K alpha.
    n, ridge = len(rows), li.RIDGE * len(rows) / 10
    system = np.block([[weight[:, None] * whole + ridge * np.eye(n), weight[:, None]], [weight[None, :] @ whole, np.array([[weight.sum()]])]])
    solved = np.linalg.solve(system, np.vstack([weight[:, None] * y, (weight @ y)[None, :]]))
    assert model.languages == ["a", "b", "c"]
    for r in rows + new:
        want = np.array([kernel(r, q) for q in rows]) @ solved[:-1] + solved[-1]
        assert np.allclose(model.weights[r].sum(0, dtype=np.float64) / np.sqrt(len(r)) + model.bias, want, atol=1e-3)


def test_batches_agree_with_single_texts(documents):
    texts = [t for _, t, _, _ in corpus(30)] + [None, "", "123 !? ½²"]
    rows = [li.presence(t) for t in texts[:30]]
    model = li.fit(rows, [x for _, _, x, _ in corpus(30)])
    names, scores = li.score_batch(model, texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        (one,), (s,) = li.score_batch(model, [t])
        assert one == name and abs(s - score) < 1e-9
    assert names[30:] == ["und"] * 3


def test_odd_rows_nothing_to_learn_and_empty_tables(odd, empty):
    model = li.train(odd, F.lit(True))
    got = {(r["doc_id"], r["out"]["lang"]) for r in li.add_language(odd, model, "out").collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and (7, "de") in got
    nothing = li.train(empty, F.lit(True))
    assert {r["out"]["lang"] for r in li.add_language(odd, nothing, "out").collect()} == {"und"}
    assert li.add_language(empty, model, "out").count() == 0
