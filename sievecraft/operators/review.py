"""The review queue and its decisions, for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Review actions of single items: what they set.
CORRUPT_ACTIONS = {"keep": "kept", "trash": "trash", "skip": "skipped"}
TEXT_ACTIONS = {"accept": "accepted", "reject": "rejected", "skip": "skipped"}
GROUP_ACTIONS = ("accept", "override", "skip", "keep_all", "delete_all")


def is_pending(status: Column) -> Column:
    return F.coalesce(status, F.lit("pending")) == "pending"


def next_pending(queue: DataFrame, after: str | None = None, key: str = "group_id", status: str = "status") -> DataFrame:
    """The first pending row after ``after``, wrapping around to the first of all; no row if none is pending."""
    pending = queue.where(is_pending(F.col(status)))
    if after is None:
        return pending.orderBy(key).limit(1)
    return pending.orderBy(F.col(key) <= after, key).limit(1)


def queue_counts(queue: DataFrame, status: str = "status") -> DataFrame:
    return queue.agg(F.count("*").alias("total"), F.count_if(is_pending(F.col(status))).alias("pending"), F.count_if(~is_pending(F.col(status))).alias("decided"))


def next_flagged(flags: DataFrame, photos: DataFrame, flagged: str, after: str | None = None) -> DataFrame:
    """The next flagged item to review, with what its card shows."""
    found = next_pending(flags.where(F.col(flagged)), after, "media_key", "review_status")
    return found.join(photos.select("media_key", "dedup_key", "file_name", "thumb", "is_favorite"), "media_key")


def member_views(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(group_id, members): each group's members as an array, the proposed keeper first, then by score."""
    own = members.join(photos.select("media_key", "dedup_key", "thumb", "file_name", "is_favorite", "excluded"), "media_key")
    order = F.struct((~F.coalesce("is_proposed_keeper", F.lit(False))).alias("o1"), (-F.coalesce("score", F.lit(-1.0))).alias("o2"), F.col("media_key").alias("o3"))
    view = F.struct(order.alias("o"), *[F.col(c) for c in ("media_key", "dedup_key", "thumb", "file_name", "is_favorite", "excluded", "score", "is_proposed_keeper")])
    rows = own.groupBy("group_id").agg(F.sort_array(F.collect_list(view)).alias("v"))
    return rows.select("group_id", F.transform("v", lambda x: x.dropFields("o")).alias("members"))


def _member_arrays(members: DataFrame, photos: DataFrame) -> DataFrame:
    own = members.select("group_id", "media_key").join(photos.select("media_key", "dedup_key", "is_favorite", "excluded"), "media_key")
    safe = (F.coalesce("is_favorite", F.lit(False)) | F.coalesce("excluded", F.lit(False))).alias("safe")
    return own.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("media_key", "dedup_key", safe))).alias("m"))


def resolve_keep(members: Column, keep: Column, proposed: Column) -> Column:
    """A struct of status, keep, trash, override_keeper and error for an array of members (media_key, dedup_key, safe).

    Keys are kept in the order given; empty and repeated ones are dropped. Keeping all is ``kept_all``; keeping the
    proposed one alone is ``accepted``; else ``overridden``. Protected members never land in the trash.
    """
    keys = F.transform(members, lambda m: m["media_key"])
    wanted = F.array_distinct(F.filter(F.coalesce(keep, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")))
    error = F.when(F.size(F.array_except(wanted, keys)) > 0, "keep_media_key is not in this group").when(F.size(wanted) == 0, "no keeper available")
    primary = F.when(F.coalesce(F.array_contains(wanted, proposed), F.lit(False)), proposed).otherwise(F.get(wanted, F.lit(0)))
    all_kept = F.size(F.array_except(keys, wanted)) == 0
    status = F.when(all_kept, "kept_all").when((F.size(wanted) == 1) & (F.get(wanted, F.lit(0)).eqNullSafe(proposed)), "accepted").otherwise("overridden")
    trash = F.transform(F.filter(members, lambda m: ~F.array_contains(wanted, m["media_key"]) & ~m["safe"]), lambda m: m["dedup_key"])
    ok = error.isNull()
    return F.struct(
        F.when(ok, status).alias("status"),
        F.when(ok, primary).alias("keep"),
        F.when(ok, F.when(all_kept, F.array().cast("array<string>")).otherwise(trash)).alias("trash"),
        F.when(ok & (status == "overridden"), primary).alias("override_keeper"),
        error.alias("error"),
    )


def decide(actions: DataFrame, groups: DataFrame, members: DataFrame, photos: DataFrame) -> DataFrame:
    """(group_id, action, status, keep, trash, override_keeper, error, writes) of (group_id, action, keep_keys) rows.

    ``writes``: whether a decision row follows (a skip writes none and leaves an earlier one). An action on an unknown
    group, or an unknown action, is an error.
    """
    own = actions.join(groups.select("group_id", "proposed_keeper"), "group_id", "left").join(_member_arrays(members, photos), "group_id", "left")
    m = F.coalesce("m", F.array().cast("array<struct<media_key:string,dedup_key:string,safe:boolean>>"))
    first = F.get(m, F.lit(0))["media_key"]
    fallback = F.coalesce("proposed_keeper", first)
    keep = F.when(F.size(F.coalesce("keep_keys", F.array().cast("array<string>"))) > 0, F.col("keep_keys")).when(fallback.isNotNull(), F.array(fallback))
    own = own.withColumn("r", resolve_keep(m, keep, F.col("proposed_keeper")))
    safe_keys = F.transform(F.filter(m, lambda x: x["safe"]), lambda x: x["media_key"])
    loose = F.transform(F.filter(m, lambda x: ~x["safe"]), lambda x: x["dedup_key"])
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    picks = F.col("action").isin("accept", "override")
    found = F.col("m").isNotNull()
    error = F.when(~found, "group not found").when(~F.col("action").isin(*GROUP_ACTIONS), F.concat(F.lit("unknown action "), "action")).when(picks, F.col("r.error"))
    fine = error.isNull()
    by = lambda **x: F.when(fine, F.when(F.col("action") == "skip", x["skip"]).when(F.col("action") == "keep_all", x["keep_all"]).when(F.col("action") == "delete_all", x["delete_all"]).otherwise(x["pick"]))
    return own.select(
        "group_id",
        "action",
        by(skip=F.lit("skipped"), keep_all=F.lit("kept_all"), delete_all=F.lit("deleted_all"), pick=F.col("r.status")).alias("status"),
        by(skip=none, keep_all=F.coalesce(fallback, F.lit("")), delete_all=F.coalesce(F.get(safe_keys, F.lit(0)), F.lit("")), pick=F.col("r.keep")).alias("keep"),
        by(skip=F.lit(None).cast("array<string>"), keep_all=empty, delete_all=loose, pick=F.col("r.trash")).alias("trash"),
        by(skip=none, keep_all=none, delete_all=none, pick=F.col("r.override_keeper")).alias("override_keeper"),
        error.alias("error"),
        (fine & (F.col("action") != "skip")).alias("writes"),
    )


def decided_groups(groups: DataFrame, decided: DataFrame, now: str) -> DataFrame:
    """Groups with the states that valid actions set. A skip keeps the override."""
    new = decided.where("error is null").select("group_id", F.col("status").alias("_s"), F.col("override_keeper").alias("_o"), "writes")
    joined = groups.join(new, "group_id", "left")
    hit = F.col("_s").isNotNull()
    return joined.withColumns(
        {
            "status": F.coalesce("_s", "status"),
            "override_keeper": F.when(F.coalesce("writes", F.lit(False)), F.col("_o")).otherwise(F.col("override_keeper")),
            "reviewed_at": F.when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
        }
    ).drop("_s", "_o", "writes")


def new_decisions(decided: DataFrame, now: str) -> DataFrame:
    return decided.where("writes").select("group_id", F.col("keep").alias("keep_media_key"), F.col("trash").alias("trash_dedup_keys"), F.lit(now).alias("decided_at"))


def decide_items(flags: DataFrame, actions: DataFrame, flagged: str, names: dict[str, str]) -> DataFrame:
    """Flags after (media_key, action) reviews. An unknown action, or an item that isn't flagged, fails the query."""
    status = F.lit(None).cast("string")
    for action, to in names.items():
        status = F.when(F.col("action") == action, F.lit(to)).otherwise(status)
    new = actions.join(flags.select("media_key", F.col(flagged).alias("_f")), "media_key", "left")
    wrong = F.when(status.isNull(), F.concat(F.lit("unknown action "), "action")).when(~F.coalesce("_f", F.lit(False)), F.concat(F.lit("not flagged: "), "media_key"))
    new = new.select("media_key", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(status).alias("_status"))
    return flags.join(new, "media_key", "left").withColumn("review_status", F.coalesce("_status", "review_status")).drop("_status")
