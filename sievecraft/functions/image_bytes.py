"""What image bytes say before they are decoded, as Column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of the known formats, in hex. RIFF....WEBP is tested apart.
MAGIC = ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D")
LEAST_BYTES = 12


def _latin(data: Column) -> Column:
    """One character per byte, so that a search can't match across half bytes."""
    return F.decode(data, "ISO-8859-1")


def is_webp(data: Column) -> Column:
    """A format that Spark's image source can't decode, whatever its state."""
    head = F.hex(F.substring(data, 1, 12))
    return F.coalesce(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit(False))


def looks_like_image(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    known = F.lit(False)
    for magic in MAGIC:
        known = known | head.startswith(magic)
    return F.coalesce((F.octet_length(data) >= LEAST_BYTES) & (known | is_webp(data)), F.lit(False))


def jpeg_without_end(data: Column) -> Column:
    """A JPEG that holds no end-of-image marker anywhere."""
    return F.hex(F.substring(data, 1, 2)).eqNullSafe("FFD8") & (F.instr(_latin(data), "ÿÙ") == 0)


def png_without_end(data: Column) -> Column:
    """A PNG whose last 64 bytes don't hold IEND."""
    return F.hex(F.substring(data, 1, 4)).eqNullSafe("89504E47") & (F.instr(F.right(_latin(data), F.lit(64)), "IEND") == 0)


def describe_head(data: Column) -> Column:
    """Why a file isn't an image, for reports."""
    head = F.lower(F.ltrim(_latin(F.substring(data, 1, 60))))
    return (
        F.when(data.isNull() | (F.octet_length(data) == 0), "empty")
        .when(looks_like_image(data), "image")
        .when(head.startswith("<!doctype") | head.startswith("<html"), "html")
        .when(head.startswith("{") | head.startswith("["), "json")
        .otherwise("unknown")
    )


def byte_reasons(data: Column) -> Column:
    """Reasons, in order, that need no decoding; the first two end the inspection."""
    none = F.array().cast("array<string>")
    cut = F.array_compact(F.array(F.when(jpeg_without_end(data), "truncated_jpeg"), F.when(png_without_end(data), "truncated_png")))
    return F.when(data.isNull(), F.array(F.lit("unreadable"))).when(F.octet_length(data) < LEAST_BYTES, F.array(F.lit("empty"))).when(~looks_like_image(data), F.array(F.lit("not_an_image"))).otherwise(F.coalesce(cut, none))


def decodable(data: Column) -> Column:
    return F.coalesce((F.octet_length(data) >= LEAST_BYTES) & looks_like_image(data), F.lit(False))
