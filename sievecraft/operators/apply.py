"""Export of decisions, the undo log, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gigabytes


def protected() -> Column:
    """Photos that an export never holds."""
    return F.coalesce("is_favorite", F.lit(False)) | F.coalesce("excluded", F.lit(False)) | F.coalesce("in_album", F.lit(False))


def photo_of_dedup_key(photos: DataFrame) -> DataFrame:
    """One photo per dedup key, the one of the least media key."""
    flags = ("is_favorite", "excluded", "in_album")
    return photos.groupBy("dedup_key").agg(F.min(F.struct("media_key", *flags)).alias("p")).select("dedup_key", "p.*")


def trash_items(decisions: DataFrame, photos: DataFrame, corrupt_flags: DataFrame) -> DataFrame:
    """(media_key, dedup_key, group_id): unapplied decisions' items, then corrupt ones marked trash; a photo's first entry counts."""
    keys = decisions.where(~F.coalesce("applied", F.lit(False))).select("group_id", F.posexplode("trash_dedup_keys").alias("at", "dedup_key"))
    decided = keys.join(photo_of_dedup_key(photos), "dedup_key").where(~protected()).select("media_key", "dedup_key", "group_id", F.lit(0).alias("o"), "at")
    marked = corrupt_flags.where(F.col("corrupted") & (F.col("review_status") == "trash")).select("media_key")
    corrupt = marked.join(photos, "media_key").where(~protected()).select("media_key", "dedup_key", F.lit("corrupt").alias("group_id"), F.lit(1).alias("o"), F.lit(0).alias("at"))
    first = F.min(F.struct("o", "group_id", "at", "dedup_key")).alias("x")
    return decided.unionByName(corrupt).groupBy("media_key").agg(first).select("media_key", "x.dedup_key", "x.group_id")


def dry_run(groups: DataFrame, decisions: DataFrame, photos: DataFrame, corrupt_flags: DataFrame) -> DataFrame:
    """One row: what applying the accepted decisions would do. Keys are counted as decided, an export may hold fewer."""
    open_ = decisions.where(~F.coalesce("applied", F.lit(False)))
    state = groups.agg(F.count_if(F.col("status") == "pending").alias("groups_pending_review"), F.count_if(F.col("status").isin("accepted", "overridden")).alias("groups_decided"))
    totals = open_.agg(F.coalesce(F.sum(F.size("trash_dedup_keys")), F.lit(0)).cast("long").alias("_keys"), F.count("*").alias("items_to_keep"))
    wanted = open_.select(F.explode("trash_dedup_keys").alias("dedup_key")).distinct()
    hit = photos.join(wanted, "dedup_key", "left_semi").agg(F.coalesce(F.sum("space_taken"), F.lit(0)).cast("long").alias("estimated_bytes"), F.count_if("is_favorite").alias("favorite_conflicts"))
    marked = corrupt_flags.where(F.col("corrupted") & (F.col("review_status") == "trash")).select("media_key")
    corrupt = photos.join(marked, "media_key", "left_semi").agg(F.count_if(~protected()).alias("corrupt_to_trash"))
    row = state.join(F.broadcast(totals)).join(F.broadcast(hit)).join(F.broadcast(corrupt))  # single rows
    items = F.col("_keys") + F.col("corrupt_to_trash")
    return row.select(
        "groups_pending_review", "groups_decided", items.alias("items_to_trash"), "items_to_keep", "corrupt_to_trash", "estimated_bytes",
        gigabytes(F.col("estimated_bytes")).alias("estimated_gb"), "favorite_conflicts", ((F.col("favorite_conflicts") == 0) & (items > 0)).alias("safe_to_apply"),
    )


def payload(items: DataFrame, run_id: str, created_at: str | None = None) -> DataFrame:
    """One row (value): the export as JSON, with a time and a count if a time is given. Items are written in key order;
    this is one file that a person uploads, so it is one row.
    """
    whole = items.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*items.columns))).alias("items"))
    head = [F.lit(run_id).alias("run_id")]
    if created_at:
        head += [F.lit(created_at).alias("created_at"), F.col("n").alias("item_count")]
    return whole.select(F.to_json(F.struct(*head, "items")).alias("value"))


def export_trash(groups: DataFrame, decisions: DataFrame, photos: DataFrame, corrupt_flags: DataFrame, run_id: str, created_at: str) -> DataFrame:
    """The trash payload; refused if a favorite would be trashed."""
    if dry_run(groups, decisions, photos, corrupt_flags).first()["favorite_conflicts"]:
        raise ValueError("refusing to export: favorites would be trashed")
    return payload(trash_items(decisions, photos, corrupt_flags), run_id, created_at)


def batches(items: DataFrame, size: int = 50) -> DataFrame:
    """Append batch: items in key order, ``size`` a batch. Ranks come from range partitions, so no task sorts all."""
    ordered = items.withColumn("_bucket", F.substring(F.sha1("media_key"), 1, 3))
    counts = ordered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))  # 4096 rows at most
    own = ordered.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("media_key")))
    joined = own.join(F.broadcast(before), "_bucket")
    return joined.withColumn("batch", F.floor((F.col("_rank") - 1 + F.coalesce("_before", F.lit(0))) / size)).drop("_bucket", "_n", "_before", "_rank")


def import_undo(undo_log: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The log with a run's items appended, numbered on from the last id. A repeated import repeats its rows."""
    last = undo_log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("position"))
    runs = new.groupBy("run_id").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = new.withColumn("_k", order).join(runs, "run_id").join(F.broadcast(last))
    rows = rows.select((F.col("_last") + F.col("_before") + F.col("_k")).alias("id"), "run_id", "dedup_key", "media_key", F.coalesce("trashed_at", F.lit(now)).alias("trashed_at"), F.lit(False).alias("restored"))
    return undo_log.unionByName(rows)


def mark_applied(decisions: DataFrame, now: str, covered: DataFrame | None = None) -> DataFrame:
    """All unapplied decisions become applied; with ``covered`` (dedup_key rows of a log), only those it holds in full."""
    open_ = ~F.coalesce("applied", F.lit(False))
    if covered is None:
        return decisions.withColumns({"applied_at": F.when(open_, F.lit(now)).otherwise(F.col("applied_at")), "applied": F.lit(True)})
    keys = decisions.where(open_).select("group_id", F.explode("trash_dedup_keys").alias("dedup_key"))
    short = keys.join(covered.select("dedup_key").distinct(), "dedup_key", "left_anti").select("group_id").distinct().withColumn("_short", F.lit(True))
    full = open_ & F.col("_short").isNull()
    joined = decisions.join(short, "group_id", "left")
    return joined.withColumns({"applied_at": F.when(full, F.lit(now)).otherwise(F.col("applied_at")), "applied": F.coalesce("applied", F.lit(False)) | full}).drop("_short")


def latest_run(undo_log: DataFrame) -> DataFrame:
    """One row (run_id): the run of the last entry that isn't restored."""
    return undo_log.where(~F.coalesce("restored", F.lit(False))).agg(F.max_by("run_id", "id").alias("run_id")).where("run_id is not null")


def restore_items(undo_log: DataFrame, run_id: str | None = None) -> DataFrame:
    """(media_key, dedup_key, trashed_at) of a run's unrestored entries; of the latest run without an id."""
    open_ = undo_log.where(~F.coalesce("restored", F.lit(False)))
    own = open_.where(F.col("run_id") == run_id) if run_id else open_.join(F.broadcast(latest_run(undo_log)), "run_id", "left_semi")
    return own.select("media_key", "dedup_key", "trashed_at")


def mark_restored(undo_log: DataFrame, run_id: str) -> DataFrame:
    return undo_log.withColumn("restored", F.coalesce("restored", F.lit(False)) | (F.col("run_id") == run_id))
