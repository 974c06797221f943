"""Sinks: JSON documents and reports, and flagged files moved or copied."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(row: DataFrame, path: str) -> None:
    """A one-row (value) frame as a single text file in the folder ``path``, by Spark's committer."""
    row.coalesce(1).write.mode("overwrite").text(path)


def write_report(verdicts: DataFrame, path: str) -> None:
    """One JSON object per verdict."""
    verdicts.write.mode("overwrite").json(path)


def accepted_text(flags: DataFrame, photos: DataFrame) -> DataFrame:
    """Accepted text photos in key order."""
    own = flags.where(F.col("is_text") & (F.col("review_status") == "accepted")).select("media_key", "line_count", "coverage", "ink_fraction")
    return own.join(photos.select("media_key", "dedup_key", "file_name"), "media_key").orderBy("media_key")


def plan_moves(files: DataFrame, root: str, to: str, taken: DataFrame | None = None) -> DataFrame:
    """(path, dest): relative paths under ``to``; a name that is taken gets _1, _2, ... before its suffix.

    Files already under ``to`` stay. Equal targets are ranked within their own name only.
    """
    root, to = root.rstrip("/"), to.rstrip("/")
    own = files.where(~F.col("path").startswith(to + "/")).select("path", F.concat(F.lit(to), F.substr("path", F.lit(len(root) + 1))).alias("want"))
    if taken is None:
        return own.select("path", F.col("want").alias("dest"))
    stem, suffix = F.regexp_replace("want", r"(\.[^./]*)$", ""), F.regexp_extract("want", r"(\.[^./]*)$", 1)
    used = taken.select(F.col("path").alias("_t"))
    pattern = F.concat(F.lit(r"^\Q"), stem, F.lit(r"\E(?:_(\d+))?\Q"), suffix, F.lit(r"\E$"))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    near = own.withColumn("_f", folder("want")).join(used.withColumn("_f", folder("_t")), "_f", "left")
    hit = F.when(F.expr("_t = want"), F.lit(0)).when(F.rlike("_t", pattern), F.regexp_extract("_t", r"_(\d+)(?:\.[^./]*)?$", 1).cast("int"))
    rows = near.groupBy("path", "want").agg(F.collect_set(hit).alias("n"))
    free = F.when(~F.array_contains("n", 0), F.lit(0)).otherwise(F.array_min(F.array_except(F.sequence(F.lit(1), F.size("n") + 1), F.col("n"))))
    return rows.withColumn("k", free).select("path", F.when(F.col("k") == 0, F.col("want")).otherwise(F.concat(stem, F.lit("_"), F.col("k"), suffix)).alias("dest"))


def mounted(path: str) -> str:
    """A folder as executors see it in their own file system; files of other schemes can't be written there."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in bare or (":" in bare.split("/", 1)[0]):
        raise ValueError(f"{path}: image files are written through the file system, so this has to be a folder that all executors mount")
    return bare


def relocate(moves: DataFrame, copy: bool = False) -> DataFrame:
    """Move or copy files; (path, dest, done). The folders must be ones that all executors mount."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda p: p.removeprefix("file:").replace("///", "/", 1) if p.startswith("file:") else p
        for b in batches:
            done = []
            for a, z in zip(b["path"].map(local), b["dest"].map(local), strict=True):
                os.makedirs(os.path.dirname(z), exist_ok=True)
                if os.path.exists(a):  # a task that runs again finds the file moved
                    part = z + ".partial"
                    shutil.copy2(a, part)
                    os.replace(part, z)
                    if not copy:
                        os.remove(a)
                done.append(os.path.exists(z))
            yield b.assign(done=done)

    return moves.select("path", "dest").mapInPandas(run, "path string, dest string, done boolean")
