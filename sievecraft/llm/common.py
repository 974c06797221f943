"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most: bounds a worker's memory when texts are long.
BATCH_ROWS = 256
BATCH_BYTES = 32 << 20

#: Pattern of a word: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let an Arrow batch hold few rows and bytes, as texts may be long.

    The setting stays with the session: results are lazy, so their plans read it after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it, so that a helper column replaces none."""
    own = {c.lower() for c in docs.columns}
    while name.lower() in own:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """Text as bytes: Python's bytes methods know ASCII case and white space only, as the operators want."""
    return text.cast("binary")


def words_of(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def count_words(text: Column) -> Column:
    """How many words: gaps between words, plus one, with no array built. 0 for null."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), GAP, "")
    return F.length(inner).cast("long")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: how folds are dealt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
