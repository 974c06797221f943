"""State-preserving upserts, as snapshot rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SOURCE_COLUMNS, STATE_COLUMNS

#: Review states that a new scan keeps while the item is still flagged.
CORRUPT_FINAL = ("kept", "trash", "skipped")
TEXT_FINAL = ("accepted", "rejected", "skipped")


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. Repeated keys are combined before the shuffle."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), order).alias("_last")).select("_last.*")


def upsert_photos(photos: DataFrame, items: DataFrame, order: str = "line_no") -> DataFrame:
    """Photos after an import: source columns of the last line of each key, state columns as they were."""
    source = [c for c in SOURCE_COLUMNS if c != "media_key"] + ["is_video"]
    new = last_per_key(items, "media_key", order).select("media_key", *[F.col(c).alias(f"_new_{c}") for c in source], F.lit(True).alias("_new"))
    both = photos.join(new, "media_key", "full_outer")
    is_new = F.coalesce("_new", F.lit(False))
    state = {c: F.coalesce(F.col(c), F.lit(False)) if kind == "boolean" else F.col(c) for c, kind in STATE_COLUMNS.items()}
    return both.select("media_key", *[F.when(is_new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in source], *[x.alias(c) for c, x in state.items()])


def import_counters(photos: DataFrame, items: DataFrame) -> DataFrame:
    """One row: lines, videos, live photos and favorites per line; inserted keys, and updated lines (a repeated key updates)."""
    known = photos.select(F.col("media_key").alias("_k"))
    fresh = items.select("media_key").distinct().join(known, F.col("media_key") == F.col("_k"), "left_anti").agg(F.count("*").alias("inserted"))
    lines = items.agg(F.count("*").alias("total"), F.count_if("is_video").alias("videos"), F.count_if("is_live_photo").alias("live_photos"), F.count_if("is_favorite").alias("favorites"))
    return lines.join(F.broadcast(fresh)).select("total", "videos", "live_photos", "favorites", "inserted", (F.col("total") - F.col("inserted")).alias("updated"))


def upsert_meta(meta: DataFrame, new: DataFrame, order: str = "line_no") -> DataFrame:
    latest = last_per_key(new, "key", order).select("key", "value")
    return meta.join(latest, "key", "left_anti").select("key", "value").unionByName(latest)


def upsert_flags(flags: DataFrame, verdicts: DataFrame, flagged: str, final: tuple[str, ...]) -> DataFrame:
    """Flags after a scan: verdicts win; a review state survives if it is final and the item is still flagged, else it is pending."""
    old = flags.select("media_key", F.col("review_status").alias("_old"))
    status = F.when(F.col(flagged) & F.col("_old").isin(*final), F.col("_old")).otherwise(F.lit("pending"))
    fresh = verdicts.drop("review_status").join(old, "media_key", "left").withColumn("review_status", status).drop("_old")
    rest = flags.join(verdicts.select("media_key"), "media_key", "left_anti")
    return rest.unionByName(fresh, allowMissingColumns=True)


def upsert_decisions(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """A new decision replaces its group's and is not applied; when the old one was applied is kept."""
    old = decisions.select("group_id", F.col("applied_at").alias("_at"))
    fresh = new.join(old, "group_id", "left").select("group_id", "keep_media_key", "trash_dedup_keys", "decided_at", F.lit(False).alias("applied"), F.col("_at").alias("applied_at"))
    return decisions.join(new.select("group_id"), "group_id", "left_anti").unionByName(fresh)


def upsert_vectors(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    return embeddings.join(new.select("media_key"), "media_key", "left_anti").unionByName(new)


def mark_cached(photos: DataFrame, valid: DataFrame, flag: str = "thumb_cached", repair: bool = False) -> DataFrame:
    """Set ``flag`` for keys with a valid blob; with ``repair``, clear it for the others."""
    known = valid.select(F.col("media_key").alias("_k")).distinct()
    has = F.col("_k").isNotNull()
    return photos.join(known, F.col("media_key") == F.col("_k"), "left").withColumn(flag, has if repair else has | F.coalesce(F.col(flag), F.lit(False))).drop("_k")
