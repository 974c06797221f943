from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sievecraft.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    """(words, hit words, items) by comparing every window with every position."""
    own = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, source in items:
        w = WORD.findall(lower(source))
        for k in range(max(1, len(w) - 12) if w else 0):
            window = w[k : k + 13]
            for p in range(len(own) - len(window) + 1):
                if own[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item))
    return len(own), len(hit), found


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Éa", "naïve", "X9", "漢字"]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((40, 13, 14, 5, 1, 20))] + [(6, ""), (7, None), (0, "again W1 w2 w3")]
    docs = []
    for k in range(60):
        own = rng.choices(words, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            w = WORD.findall(rng.choice([t for _, t in items if t]))
            a = rng.randrange(len(w))
            own[rng.randrange(len(own) + 1) : 0] = w[a : a + rng.randrange(1, 30)]
        docs.append((k, rng.choice([" ", ", ", " -- "]).join(own), "en", "s"))
    return docs, items


def check(spark, documents, block_words):
    docs, items = texts()
    table = spark.createDataFrame(items + [(None, "w1")], "item_id long, text string")
    rows = d.add_hits(documents(docs), table, "out", block_words=block_words).select("doc_id", "text", "out", d.contaminated(F.col("out")).alias("c")).collect()
    some = 0
    for r in rows:
        n, hit, found = brute(r["text"], items)
        assert (r["out"]["n_words"], r["out"]["n_hit"], set(r["out"]["items"])) == (n, hit, found)
        assert r["c"] == (hit > 0 and 20 * hit >= n)
        some += hit > 0
        inside = set()
        for s in r["out"]["spans"]:
            inside.update(m.start() for m in WORD.finditer(r["text"]) if s["start"] <= m.start() and m.end() <= s["end"])
        assert len(inside) == hit
    assert some > 10


def test_matches_brute_force(spark, documents):
    check(spark, documents, d.BLOCK_WORDS)


def test_blocks_of_the_benchmark_agree(spark, documents):
    check(spark, documents, 30)


def test_spans_are_offsets_of_the_original(spark, documents):
    rows = d.add_hits(documents([(1, "Say: 漢字,  The CAT sat! ok", "en", "s")]), spark.createDataFrame([(5, "the cat sat")], "item_id long, text string"), "out").collect()
    assert [(s["item"], rows[0]["text"][s["start"] : s["end"]]) for s in rows[0]["out"]["spans"]] == [("5", "The CAT sat")]


def test_very_long_texts_and_clashing_columns(spark, documents):
    bench = spark.createDataFrame([(5, "the cat sat")], "item_id long, text string")
    docs = documents([(1, "dog " * 200_000 + "the cat sat", "en", "s"), (2, "the cat sat", "en", "s")]).withColumns({"contamination": F.lit(4), "_decontaminate": F.lit(5)})
    got = {r["doc_id"]: r["out"] for r in d.add_hits(docs, bench, "out").collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["spans"][0]["start"]) == (200_003, 3, 800_000)
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [(r["doc_id"], r["contamination"], r["_decontaminate"]) for r in kept.collect()] == [(1, 4, 5)]
    blocks = d.add_hits(docs, spark.createDataFrame([(5, "the cat sat"), (6, "dog dog dog")], "item_id long, text string"), "hits", block_words=2)
    assert {r["doc_id"]: (r["hits"]["n_hit"], r["hits"]["items"]) for r in blocks.collect()} == {1: (200_003, ["5", "6"]), 2: (3, ["5"])}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    kept = d.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 9]
    assert d.drop_contaminated(empty, bench).count() == 0
    assert d.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
