from __future__ import annotations

import numpy as np

from sievecraft.llm.boosting import fit, isotonic


def test_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x[:1500], y[:1500])
    assert (((model.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean()) > 0.95


def plain_boost(x, y, trees, depth, rate, ridge):
    """Newton boosting with every split between two values tried, row sets as lists: margins of the rows."""
    margin = [float(np.log(y.mean() / (1 - y.mean())))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        weight = lambda rows: sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + ridge)  # noqa: B023, E731
        sets = [list(range(len(y)))]
        for _ in range(depth):
            parts = []
            for rows in sets:
                best, halves = 1e-9, (rows, [])
                for f in range(x.shape[1]):
                    values = sorted(set(x[:, f]))
                    for a, b in zip(values, values[1:], strict=False):
                        left, right = [r for r in rows if x[r, f] <= (a + b) / 2], [r for r in rows if x[r, f] > (a + b) / 2]
                        if sum(h[r] for r in left) < 1 or sum(h[r] for r in right) < 1:
                            continue
                        gain = weight(left) + weight(right) - weight(rows)
                        if gain > best + 1e-12:
                            best, halves = gain, (left, right)
                parts += halves
            sets = parts
        for rows in sets:
            for r in rows:
                margin[r] -= rate * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + ridge)
    return margin


def test_trees_match_an_exhaustive_split_search():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 9, size=(60, 3)).astype(float) ** 2
        y = (x[:, 0] + x[:, 1] * (x[:, 2] > 9) + rng.normal(scale=20, size=60) > 40).astype(float)
        got = fit(x, y, trees=5, depth=2, rate=0.3).margin(x)
        assert np.allclose(got, plain_boost(x, y, 5, 2, 0.3, 1.0))


def test_degenerate_inputs():
    x = np.zeros((5, 2))
    assert np.isfinite(fit(x, np.ones(5)).margin(x)).all()
    assert fit(np.zeros((0, 2)), np.zeros(0)).margin(np.zeros((3, 2))).tolist() == [0, 0, 0]
    assert np.allclose(fit(x, np.array([0, 1, 0, 1, 0.0])).margin(x), np.log(0.4 / 0.6))


def test_isotonic_is_the_least_squares_monotone_fit():
    score = np.array([1, 2, 3, 4, 5, 5, 6.0])
    y = np.array([0, 1, 0, 0, 1, 0, 1.0])
    x, p = isotonic(score, y)
    assert np.allclose(np.interp(score, x, p), [0, 1 / 3, 1 / 3, 1 / 3, 0.5, 0.5, 1])
    assert isotonic(np.zeros(0), np.zeros(0))[1].tolist() == [0.5]
