"""Image classifiers: features from pixels, verdicts in SQL with thresholds as parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import kernels
from ..functions.image_bytes import byte_reasons, decodable, is_webp
from ..sources.files import to_rgb

_FILL = "fill_raw double, fill_color array<int>, width int, height int"
_TEXT = (
    "line_count int, coverage double, ink_fraction double, coverage_raw double, ink_raw double, spacing_ok boolean, colourfulness double, saturation double, smooth_share double, width int, height int"
)


def _features(images: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """(path, features) of (path, width, height, channels, bgr) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [kernel(to_rgb(x, w, h, c)) for x, w, h, c in zip(b["bgr"], b["width"], b["height"], b["channels"], strict=True)]
            if rows:
                yield pd.DataFrame(rows).assign(path=b["path"].to_numpy())

    return images.select("path", "width", "height", "channels", "bgr").mapInPandas(run, schema + ", path string")


def fill_features(images: DataFrame) -> DataFrame:
    return _features(images, kernels.fill_features, _FILL)


def text_features(images: DataFrame) -> DataFrame:
    return _features(images, kernels.text_features, _TEXT)


def corrupt_verdicts(files: DataFrame, features: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, corrupted, reasons, fill_fraction, fill_color, width, height, error) of (path, content) files.

    What the bytes say comes first; a file that looks like an image but has no features didn't decode. A WebP file
    without features isn't judged (corrupted is null): there may be no decoder for it.
    """
    own = files.select("path", byte_reasons(F.col("content")).alias("_bytes"), decodable(F.col("content")).alias("_try"), is_webp(F.col("content")).alias("_webp"))
    own = own.join(features, "path", "left")
    seen = F.col("fill_raw").isNotNull()
    grey = F.array_max(F.transform("fill_color", lambda c: F.abs(c - kernels.DECODER_GREY))) <= 2
    fill = F.when((F.col("fill_raw") >= cfg.decoder_fill_min) & grey, F.array(F.lit("decoder_fill"))).when(F.col("fill_raw") >= cfg.min_fill, F.array(F.lit("trailing_fill"))).otherwise(F.array().cast("array<string>"))
    unknown = F.col("_try") & F.col("_webp") & ~seen
    reasons = F.when(~F.col("_try") | unknown, F.col("_bytes")).when(~seen, F.concat("_bytes", F.array(F.lit("unreadable")))).otherwise(F.concat("_bytes", fill))
    shown = F.col("_try") & seen
    return own.withColumn("reasons", reasons).select(
        "path",
        F.when(~unknown, F.size("reasons") > 0).alias("corrupted"),
        "reasons",
        F.when(shown, F.bround("fill_raw", 4)).otherwise(F.lit(0.0)).alias("fill_fraction"),
        F.when(shown & (F.col("fill_raw") > 0), F.col("fill_color")).alias("fill_color"),
        F.when(shown, F.col("width")).alias("width"),
        F.when(shown, F.col("height")).alias("height"),
        F.when(unknown, "format not supported").when(F.col("_try") & ~seen, "not decodable").alias("error"),
    )


def is_photographic() -> Column:
    return (F.col("colourfulness") >= 25.0) | (F.col("saturation") >= 0.25) | (F.col("smooth_share") >= 0.58)


def text_verdicts(files: DataFrame, features: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, is_text, reasons, line_count, coverage, ink_fraction, width, height, error) of files; undecoded ones are unreadable."""
    own = files.select("path", is_webp(F.col("content")).alias("_webp")).join(features, "path", "left")
    seen = F.col("line_count").isNotNull()
    text = (
        seen
        & ~is_photographic()
        & (F.col("line_count") >= cfg.text_min_lines)
        & (F.col("coverage_raw") >= cfg.text_min_coverage)
        & F.col("ink_raw").between(cfg.text_ink_min, cfg.text_ink_max)
        & F.col("spacing_ok")
    )
    text = F.coalesce(text, F.lit(False))
    reasons = F.when(text, F.array(F.lit("text_lines"))).when(~seen & ~F.col("_webp"), F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>"))
    return own.select(
        "path", text.alias("is_text"), reasons.alias("reasons"), F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("ink_fraction", F.lit(0.0)).alias("ink_fraction"), "width", "height", F.when(~seen & F.col("_webp"), "format not supported").when(~seen, "not decodable").alias("error"),
    )


def scan_stats(verdicts: DataFrame, flagged: str, expected: DataFrame | None = None, moved: int = 0, copied: int = 0) -> DataFrame:
    """One row: scanned, flagged, ok, missing (expected keys without a verdict), moved and copied files."""
    row = verdicts.agg(F.count("*").alias("scanned"), F.count_if(flagged).alias("flagged"), F.count_if(~F.col(flagged)).alias("ok"))
    gone = F.lit(0).cast("long") if expected is None else F.lit(expected.join(verdicts.select("media_key"), "media_key", "left_anti").count())
    return row.withColumns({"missing": gone, "moved": F.lit(moved).cast("long"), "copied": F.lit(copied).cast("long")})


def as_flags(verdicts: DataFrame, keys: DataFrame, scanned_at: str) -> DataFrame:
    """Verdicts by media key, for the flag tables; ``keys``: (media_key, path)."""
    found = verdicts.join(keys, "path").drop("path", "width", "height", "error")
    return found.withColumn("scanned_at", F.lit(scanned_at))
