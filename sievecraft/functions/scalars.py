"""Scalar functions of the media catalogue, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger timestamps are milliseconds.
MILLIS_FROM = 10_000_000_000
PIXELS_FULL_SCORE = 12e6
NORM_CLIP = 1e-12


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp in seconds or milliseconds; null stays null."""
    return F.when(ts > MILLIS_FROM, F.floor(ts / 1000)).otherwise(ts).cast("long")


def sized_url(url: Column, px: int) -> Column:
    """The url of an image rendered at ``px``; null and empty stay as they are."""
    base = F.get(F.split(F.get(F.split(url, "="), F.lit(0)), r"\?"), F.lit(0))
    return F.when(url == "", url).when(url.isNotNull(), F.concat(base, F.lit(f"=w{px}-h{px}-k-no?authuser=0")))


def safe_key(key: Column) -> Column:
    """A key as a file name: letters, digits, - and _ stay, anything else is _."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_")


def safe_browser_key(key: Column) -> Column:
    """A key as the browser script's file names have it."""
    return F.regexp_replace(key, r"""[/\\?%*:|"<>]""", "_")


def blob_path(key: Column, root: str, suffix: str = ".jpg") -> Column:
    """Where a key's blob is kept: two levels of its SHA-1, then its safe name."""
    digest = F.sha1(key)
    return F.concat_ws("/", F.lit(root), F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(safe_key(key), F.lit(suffix)))


def is_video(duration: Column, is_live: Column) -> Column:
    return F.coalesce((duration > 0) & ~F.coalesce(is_live, F.lit(False)), F.lit(False))


def pixel_count(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0))


def resolution_score(width: Column, height: Column, seen_width: Column | None = None, seen_height: Column | None = None) -> Column:
    """Pixels over 12 million, at most 1. Unknown or zero sizes fall back to those of the decoded image."""
    known = lambda x, seen: F.coalesce(F.when(x != 0, x), *([seen] if seen is not None else []), F.lit(0))
    return F.least(known(width, seen_width).cast("double") * known(height, seen_height) / PIXELS_FULL_SCORE, F.lit(1.0))


def weighted_score(weights: dict[str, float], prefix: str = "") -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.col(prefix + name)
    return total


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a flat range is 0.5."""
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))


def gigabytes(n_bytes: Column) -> Column:
    return F.round(n_bytes / float(1 << 30), 3)


def colour_text(rgb: Column) -> Column:
    """[r, g, b] as "r,g,b"; null stays null."""
    return F.when(rgb.isNotNull(), F.array_join(F.transform(rgb, lambda x: x.cast("string")), ","))


def colour_array(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.transform(F.split(text, ","), lambda x: x.cast("int")))


def reasons_array(text: Column) -> Column:
    """A JSON list of reasons; a text that isn't one is a single reason; null is none."""
    parsed = F.from_json(text, "array<string>")
    usable = F.trim(text).startswith("[") & parsed.isNotNull() & ~F.exists(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: x.isNull())
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(usable, parsed).otherwise(F.array(text))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    return F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(F.greatest(norm(vector), F.lit(NORM_CLIP)), F.size(vector)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def run_id(clock: Column, salt: Column) -> Column:
    """run-<UTC time>-<six hex digits>; the clock and the salt are the caller's, so that runs can be repeated."""
    return F.concat(F.lit("run-"), F.date_format(clock, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha1(salt), 1, 6))


def group_id(first_member: Column) -> Column:
    """A group's id follows from its least member."""
    return F.substring(F.sha1(first_member), 1, 8)
