"""Exclusion rules and what follows from them for groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig


def rules(cfg: EngineConfig) -> list[tuple[str, str, Column]]:
    """(reason, counter, condition) of the rules that are on, in order."""
    every = [
        ("favorite", "favorites", cfg.exclude_favorites, "is_favorite"),
        ("album", "album_members", cfg.exclude_album_members, "in_album"),
        ("video", "videos", cfg.exclude_videos, "is_video"),
        ("live_photo", "live_photos", cfg.exclude_live_photos, "is_live_photo"),
    ]
    return [(reason, counter, F.coalesce(F.col(flag), F.lit(False))) for reason, counter, on, flag in every if on]


def apply_exclusions(photos: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Set excluded and exclude_reason (reasons joined by commas, null if none) in one projection."""
    on = rules(cfg)
    reason = F.concat_ws(",", *[F.when(hit, F.lit(name)) for name, _, hit in on]) if on else F.lit("")
    return photos.drop("excluded", "exclude_reason").withColumn("exclude_reason", F.when(reason != "", reason)).withColumn("excluded", F.col("exclude_reason").isNotNull())


def exclusion_counts(photos: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row: how many photos each rule hits, and how many are excluded. Rules that are off count 0."""
    on = {counter: hit for _, counter, hit in rules(cfg)}
    hits = [F.count_if(on[c]).alias(c) if c in on else F.lit(0).cast("long").alias(c) for c in ("favorites", "album_members", "videos", "live_photos")]
    either = F.lit(False)
    for hit in on.values():
        either = either | hit
    return photos.agg(*hits, F.count_if(either).alias("total_excluded"))


def cascade(photos: DataFrame, groups: DataFrame, members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, members and decisions after excluded photos left: groups under two members go, with their decisions;
    excluded keepers become null; sizes are counted anew. Nothing changes if no photo is excluded.

    All conditions are joins and aggregates; whether any photo is excluded is one row that is broadcast.
    """
    gone = photos.where("excluded").select(F.col("media_key").alias("_x")).distinct()
    any_gone = photos.agg(F.coalesce(F.bool_or("excluded"), F.lit(False)).alias("_any"))
    left = members.join(gone, F.col("media_key") == F.col("_x"), "left_anti")
    counted = left.groupBy("group_id").agg(F.count("*").cast("int").alias("_n")).where("_n >= 2")
    kept = groups.join(F.broadcast(any_gone)).join(counted, "group_id", "left").where("not _any or _n is not null")
    kept = kept.join(gone, F.col("proposed_keeper") == F.col("_x"), "left")
    kept = kept.withColumns({"size": F.when(F.col("_any"), F.col("_n")).otherwise(F.col("size")), "proposed_keeper": F.when(F.col("_x").isNull(), F.col("proposed_keeper"))})
    kept = kept.drop("_any", "_n", "_x")
    ids = kept.select("group_id")
    return kept, left.join(ids, "group_id", "left_semi"), decisions.join(ids, "group_id", "left_semi")
