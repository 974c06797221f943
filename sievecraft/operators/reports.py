"""Reports, each in one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.image_bytes import looks_like_image


def ready_to_embed() -> Column:
    return F.col("thumb_cached") & ~F.col("embedded") & ~F.col("is_video") & ~F.col("excluded")


def census_report(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of counts."""
    p = photos.agg(
        F.count("*").alias("total"), F.count_if("is_video").alias("videos"), F.count_if("is_live_photo").alias("live_photos"), F.count_if("is_favorite").alias("favorites"),
        F.count_if("is_archived").alias("archived"), F.count_if(~F.col("is_video")).alias("photos"), F.count_if("thumb_cached").alias("thumbs_cached"), F.count_if("embedded").alias("embedded"),
    )
    g = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("status") == "pending").alias("groups_pending"))
    return p.join(F.broadcast(g))


def status_funnel(photos: DataFrame, embeddings: DataFrame, groups: DataFrame, corrupt_flags: DataFrame, text_flags: DataFrame, missing: bool = False) -> DataFrame:
    """One row: how many items sit at each stage, and the next step. ``missing``: most sampled thumbs aren't there."""
    still = ~F.col("is_video")
    p = photos.agg(
        F.count("*").alias("photos_total"), F.count_if("is_video").alias("videos"), F.count_if("excluded").alias("excluded"),
        F.count_if(F.col("excluded") & F.col("exclude_reason").contains("favorite")).alias("excluded_favorite"), F.count_if(F.col("excluded") & F.col("exclude_reason").contains("album")).alias("excluded_album"),
        F.count_if(F.col("thumb").isNotNull() & still).alias("with_thumb_url"), F.count_if(F.col("thumb_cached") & still).alias("thumbs_cached"), F.count_if(ready_to_embed()).alias("ready_to_embed"),
        F.count_if(F.col("embedded") & still & ~F.col("excluded")).alias("embedded_flag"),
    )
    e = embeddings.select("media_key").join(photos.select("media_key", "excluded", "is_video"), "media_key", "left")
    e = e.agg(F.count("*").alias("embeddings_rows"), F.count_if(~F.col("excluded") & still).alias("usable_for_group"))
    g = groups.agg(F.count("*").alias("groups"))
    c = corrupt_flags.agg(F.count_if("corrupted").alias("corrupt_thumbs"))
    t = text_flags.agg(F.count_if("is_text").alias("text_thumbs"))
    row = p.join(F.broadcast(e)).join(F.broadcast(g)).join(F.broadcast(c)).join(F.broadcast(t))  # single rows
    return row.withColumn("next_step", next_step(F.lit(missing)))


def next_step(missing: Column | None = None) -> Column:
    """What to run next, from the funnel's counts; ``missing``: most sampled thumbs aren't there."""
    return (
        F.when(F.col("photos_total") == 0, "import")
        .when(missing if missing is not None else F.lit(False), "repair")
        .when(F.col("thumbs_cached") < 2, "fetch")
        .when((F.col("usable_for_group") < 2) & (F.col("ready_to_embed") > 0), "embed")
        .when((F.col("usable_for_group") < 2) & (F.col("excluded") > 0) & (F.col("thumbs_cached") > 0), "relax_exclusions")
        .when(F.col("usable_for_group") < 2, "embed")
        .when(F.col("groups") == 0, "group")
        .otherwise("review")
    )


def thumb_sample(photos: DataFrame, blobs: DataFrame, size: int = 50) -> DataFrame:
    """One row (valid, sampled): of some cached thumbs, how many hold an image. A sample is the feature."""
    some = photos.where(F.col("thumb_cached") & ~F.col("is_video")).select("media_key").orderBy("media_key").limit(size)
    good = blobs.where(looks_like_image(F.col("content"))).select(F.col("media_key").alias("_k"))
    return some.join(good, F.col("media_key") == F.col("_k"), "left").agg(F.count_if(F.col("_k").isNotNull()).alias("valid"), F.count("*").alias("sampled"))


def as_table(row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row report."""
    parts = ", ".join(f"'{c}', cast(`{c}` as string)" for c in row.columns)
    return row.select(F.expr(f"stack({len(row.columns)}, {parts}) as (metric, value)"))
