"""A corpus pipeline: toxicity, quality rules, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the first four return the columns
of documents, the last the mix. The labels, by which the toxicity stage learns, and the benchmark come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievecraft.llm import decontaminate, near_dedup, quality_rules, toxicity
from sievecraft.llm.common import table
from sievecraft.llm.queries import DEDUP, mixed, toxicity_model
from sievecraft.plans.lineage import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir, docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, **DEDUP)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words."""
    return mixed(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained scores and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
