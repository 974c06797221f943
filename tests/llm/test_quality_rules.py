from __future__ import annotations

import random
import re

import pytest

from sievecraft.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    out = []
    for k in range(80):
        own = rng.choices(["a", "b", "c", "dé", "#x", "漢", "long*word"], k=rng.randrange(0, 90))
        out.append((k, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for w in own), "en", f"s{k % 5}"))
    return out


def test_counts_match_brute_force(documents):
    rows = q.add_counts(documents(texts())).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
    assert any(r["n_repeat_words"] for r in rows)


def host(k, bad, n):
    good = " ".join(f"w{j}" for j in range(60))
    return [(1000 * k + j, "short" if j < bad else good + f" {j}", "en", f"h{k}") for j in range(n)]


def test_host_verdicts_are_shrunk_and_joined_back(documents):
    rows = documents(host(1, 95, 100) + host(2, 5, 100) + host(3, 1, 1) + host(4, 3, 100) + host(5, 2, 100))
    rules = q.QualityRules()
    judged = q.add_failures(q.add_counts(rows), rules)
    found = {r["host"]: r for r in q.host_verdicts(judged, "source", rules).collect()}
    assert found["h1"]["host_rejected"] and not found["h2"]["host_rejected"]
    assert found["h1"]["host_rate"] < 0.95 and found["h2"]["host_rate"] > 0.05 and found["h3"]["host_rate"] < 1
    kept = {r["doc_id"] for r in q.judge(rows, rules).collect() if r["kept"]}
    assert kept == {1000 * k + j for k, bad in ((2, 5), (4, 3), (5, 2)) for j in range(bad, 100)}
    assert {r["doc_id"] for r in q.keep_good(rows, rules).collect()} == kept


def test_many_rejected_hosts_are_joined_by_shuffle(documents):
    rows = documents(host(1, 95, 100) + host(2, 5, 100))
    a = q.judge(rows, q.QualityRules(broadcast_hosts=0)).collect()
    assert sorted(a) == sorted(q.judge(rows).collect())


def test_plan_is_native(documents):
    plan = q.keep_good(documents(host(1, 95, 100)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_and_empty_tables(odd, empty):
    out = q.judge(odd).collect()
    assert len(out) == odd.count()
    by = {(r["doc_id"], r["n_words"]): r for r in out}
    assert by[1, 0]["base_failed"] and by[2, 0]["base_failed"] and by[3, 0]["base_failed"]
    assert by[6, 30_000]["n_repeat_words"] == 30_000 and by[6, 30_000]["base_failed"]
    assert q.keep_good(odd).columns == odd.columns
    assert q.judge(empty).count() == 0 and q.keep_good(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_short_texts(documents, n):
    r = q.add_counts(documents([(1, " ".join(["x"] * n), "en", "s")])).collect()[0]
    assert (r["n_words"], r["n_repeat_words"]) == (n, n if n > 3 else 0)


def test_texts_are_counted_once(documents, monkeypatch):
    seen = []
    real = q.add_counts
    monkeypatch.setattr(q, "add_counts", lambda *x: seen.append(1) or real(*x))
    plan = q.keep_good(documents(host(1, 95, 100)))._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "split(" not in plan  # the result reads what was counted
