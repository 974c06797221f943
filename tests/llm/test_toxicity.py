from __future__ import annotations

import random

from pyspark.sql import functions as F

from sievecraft.llm import toxicity as t
from sievecraft.llm.common import id_remainder


def rows(n=900, seed=5):
    """Neutral texts, and toxic ones by insults, stems or disguised insults."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ta", "mo", "ri", "se", "lu") for b in ("n", "k", "st", "p") for c in ("a", "er", "ing", "o")]
    docs, labels = [], []
    for k in range(n):
        own = rng.choices(words, k=rng.randrange(40, 120))
        toxic = k % 4 == 0
        if toxic:
            kind = k % 12
            bad = {0: ["idiot", "moron", "loser"], 4: ["grumbzer", "grumbzing", "grumbzan"], 8: ["idiot", "id1ot", "m0ron"]}[kind]
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        docs.append((k, " ".join(own), "en", "s"))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents):
    docs, labels = rows()
    table = documents(docs)
    model = t.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"), id_remainder(F.col("doc_id"), 4) != 2)
    out = t.add_score(table, model).select("doc_id", "score", (id_remainder(F.col("doc_id"), 4) == 2).alias("held")).collect()
    held = [(r["score"] >= t.THRESHOLD, r["doc_id"] % 4 == 0) for r in out if r["held"]]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert t.drop_toxic(table, model).columns == table.columns


def test_features_see_disguise_and_second_person():
    lexicon = t.Lexicon({"idiot": 5.0}, {})
    f = dict(zip(t.NAMES, t.Describer(lexicon)("You are an 1d1ot! YOU IDIOT"), strict=True))
    assert f["hidden_hits"] == 1 and f["strong_hits"] == 1 and f["near_you"] == 2 and f["shouted_share"] > 0
    assert len(t.Describer(lexicon)("")) == len(t.NAMES)
    one = t.Describer(lexicon, remember=1)
    assert all(one(x) == t.Describer(lexicon)(x) for x in ("idiot you", "a b c idiot", "you idiot 1d1ot", "") * 2)


def test_odd_rows_no_labels_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.train(odd, none, F.lit(True))
    assert {r["score"] for r in t.add_score(odd, model).collect()} == {0.0}
    some = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    model = t.train(odd, some, F.lit(True))
    assert t.add_score(odd, model).count() == odd.count() and t.add_score(empty, model).count() == 0


def test_sample_is_bounded(spark, documents):
    docs, labels = rows(100)
    got = t.sample(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), "doc_id", "text", "toxic", 30)
    assert got.count() == 30
