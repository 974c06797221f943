"""The pipeline's stages against plain Python on a small library."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from sievecraft.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Clean documents, toxic ones, short ones, copies, contaminated ones."""
    rng = random.Random(12)
    syllables = ["ta", "mo", "ri", "se", "lu", "ka", "no", "vi", "pe"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    bench = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    rows, labels, kind = [], [], {}
    for k in range(500):
        own = [word() for _ in range(rng.randrange(70, 140))]
        what = ("toxic", "short", "copy", "contaminated", "clean", "clean", "clean", "clean")[k % 8]
        if what == "toxic":
            for _ in range(6):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron", "scum"]))
        elif what == "short":
            own = own[:20]
        elif what == "copy" and k > 20:
            own = rows[k - 6][1].split()[:-1] + ["new"]  # of a clean one
        elif what == "contaminated":
            own[10:40] = rng.choice(bench)[1].split()
        kind[k] = what if what != "copy" or k > 20 else "clean"
        rows.append((k, " ".join(own), "en", f"s{k % 3}", 1))
        labels.append((k, 1, int(what == "toxic")))
    at = tmp_path_factory.mktemp("library")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", kind


def test_stages_drop_what_they_should(spark, library):
    at, kind = library
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, gone = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns
        gone[name] = before - {r["doc_id"] for r in docs.collect()}
    of = lambda what: {k for k, v in kind.items() if v == what}
    assert len(gone["toxicity"] ^ of("toxic")) <= 3
    assert gone["quality rules"] == of("short")
    assert gone["near duplicates"] <= of("copy") and len(gone["near duplicates"]) >= 0.8 * len(of("copy"))
    assert gone["benchmark decontamination"] == of("contaminated")
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert mix and all(0 < r["taken"] <= 3 * r["size"] for r in mix)


def test_run(spark, library):
    out = corpus_pipeline.run(spark, library[0])
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 100


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_odd_rows_clashing_columns_and_empty_tables(spark, library, odd, empty):
    """Nulls, repeated rows, ties and very long texts pass all stages; each but the last returns its input's columns."""
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, library[0])
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, library[0]).columns == ["doc_id", "size", "source_size", "target", "taken"]
        alone = corpus_pipeline.STAGES[-1][1](spark, table, library[0]).collect()
        assert all(0 < r["taken"] <= 3 * r["size"] for r in alone) and bool(alone) == (table is odd)
        assert docs.count() == 0  # every odd text is too short or repeats itself
