"""File sources: images, zips of images, cookies, undo logs, and a pluggable fetcher."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image_bytes import is_webp, looks_like_image
from ..functions.scalars import blob_path

# Suffixes of the image files that are scanned, and of those that are read from zips.
IMAGE_SUFFIXES = ("bmp", "jfif", "jpe", "jpeg", "jpg", "png", "tif", "tiff", "webp")
ZIP_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def plain(path: Column) -> Column:
    """A path as Spark's sources agree on it: local files without their scheme, which sources spell in two ways."""
    return F.regexp_replace(path, r"^file:/+", "/")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, length, content) of the image files under ``root``, any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(suffix_of(F.col("path")).isin(*suffixes)).select(plain(F.col("path")).alias("path"), "length", "content")


def decode_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, bgr) of the images that decode; ``bgr`` holds the rows one after the other."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, width int, height int, channels int, bgr binary")
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    return found.where((F.col("nChannels") >= 1) & (F.col("height") > 0)).select(plain(F.col("origin")).alias("path"), "width", "height", F.col("nChannels").alias("channels"), F.col("data").alias("bgr"))


#: Bytes of an image -> HxWx3 RGB, or None if they don't decode.
Decoder = Callable[[bytes], np.ndarray | None]


def pillow_decoder() -> Decoder | None:
    """The default decoder of formats that Spark's image source can't read; None where Pillow isn't installed."""
    try:
        from PIL import Image
    except ImportError:
        return None

    def decode(data: bytes) -> np.ndarray | None:
        try:
            with Image.open(io.BytesIO(data)) as image:
                return np.asarray(image.convert("RGB"))
        except (OSError, SyntaxError, ValueError):
            return None

    return decode


def decode_others(files: DataFrame, make_decoder: Callable[[], Decoder | None] = pillow_decoder) -> DataFrame:
    """Rows as of ``decode_images`` for (path, content) files in formats that need a decoder of their own (WebP)."""
    schema = "path string, width int, height int, channels int, bgr binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = make_decoder()
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                rgb = decode(data) if decode else None
                if rgb is not None and rgb.size:
                    yield pd.DataFrame([(path, rgb.shape[1], rgb.shape[0], 3, np.ascontiguousarray(rgb[..., ::-1], dtype=np.uint8).tobytes())], columns=["path", "width", "height", "channels", "bgr"])

    return files.where(is_webp(F.col("content"))).select("path", "content").mapInPandas(run, schema)


def to_rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def cached_blobs(spark: SparkSession, photos: DataFrame, root: str) -> DataFrame:
    """(media_key, path, content) of the keys that have a blob in the hashed folders. Hot folders don't matter: the path is the key."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, media_key string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain(F.col("path")).alias("path"), "content")
    named = photos.select("media_key", blob_path(F.col("media_key"), root.removeprefix("file://").rstrip("/")).alias("path"))
    return named.join(files, "path")


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    stem, _, suffix = PurePosixPath(name).name.rpartition(".")
                    if suffix.lower() in ZIP_SUFFIXES and not name.endswith("/"):
                        yield pd.DataFrame([(path, name, stem, z.read(name))], columns=["zip", "entry", "stem", "content"])


def zip_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(zip, entry, stem, content) of the image files in zips: those named thumbs_batch_* if there are any, else all.

    A zip is expanded image by image.
    """
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    batch = F.col("path").rlike(r"/thumbs_batch_[^/]*\.zip$")
    some = not zips.select("path").where(batch).isEmpty()
    return (zips.where(batch) if some else zips).mapInPandas(_expand, "zip string, entry string, stem string, content binary")


def judge_entries(entries: DataFrame, photos: DataFrame, cached: DataFrame) -> DataFrame:
    """(media_key, entry, content, outcome): an entry is known by its bare name, if a photo that isn't a video has that
    key; it is ``skipped`` if the key is cached, ``unknown_or_bad`` if it isn't known or no image, else ``ok``."""
    keys = photos.where(~F.col("is_video")).select(F.col("media_key").alias("_k")).distinct()
    have = cached.select(F.col("media_key").alias("_c")).distinct()
    rows = entries.join(keys, F.col("stem") == F.col("_k"), "left").join(have, F.col("stem") == F.col("_c"), "left")
    outcome = F.when(F.col("_k").isNull(), "unknown_or_bad").when(F.col("_c").isNotNull(), "skipped").when(looks_like_image(F.col("content")), "ok").otherwise("unknown_or_bad")
    return rows.select(F.col("stem").alias("media_key"), "zip", "entry", "content", outcome.alias("outcome"))


def read_zips(judged: DataFrame) -> DataFrame:
    """(media_key, content, entry) to import: of a key's entries the last one's."""
    good = judged.where("outcome = 'ok'")
    return good.groupBy("media_key").agg(F.max_by(F.struct("content", "entry"), F.struct("zip", "entry")).alias("e")).select("media_key", "e.*")


def zip_counters(judged: DataFrame) -> DataFrame:
    """One row: zips, ok, skipped, unknown_or_bad. Entries of a key after its first one are skipped."""
    ok = judged.where("outcome = 'ok'").agg(F.count_distinct("media_key").alias("ok"), (F.count("*") - F.count_distinct("media_key")).alias("again"))
    rest = judged.agg(F.count_distinct("zip").alias("zips"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "unknown_or_bad").alias("unknown_or_bad"))
    return rest.join(F.broadcast(ok)).select("zips", "ok", (F.col("skipped") + F.col("again")).alias("skipped"), "unknown_or_bad")


def read_cookies(spark: SparkSession, path: str) -> DataFrame:
    """Cookies of a Netscape file: domain, http_only, subdomains, path, secure, expires (null: session), name, value."""
    lines = spark.read.text(path).select(F.rtrim(F.col("value")).alias("line"))
    http_only = F.col("line").startswith("#HttpOnly_")
    parts = F.split(F.regexp_replace("line", "^#HttpOnly_", ""), "\t")
    rows = lines.where((F.col("line") != "") & (http_only | ~F.col("line").startswith("#"))).select(http_only.alias("http_only"), parts.alias("p")).where(F.size("p") == 7)
    flag = lambda k: F.upper(F.col("p")[k]) == "TRUE"
    expires = F.expr("try_cast(p[4] as bigint)")
    return rows.select(
        F.col("p")[0].alias("domain"), "http_only", flag(1).alias("subdomains"), F.col("p")[2].alias("path"), flag(3).alias("secure"),
        F.when(expires != 0, expires).alias("expires"), F.col("p")[5].alias("name"), F.col("p")[6].alias("value"),
    )


# Cookies of a signed-in session.
SESSION_COOKIES = ("SID", "HSID", "SSID", "APISID", "SAPISID", "__Secure-1PSID", "__Secure-3PSID")


def cookies_look_usable(cookies: DataFrame) -> DataFrame:
    """One row (usable): whether a session cookie is there."""
    wanted = F.array(*[F.lit(c) for c in SESSION_COOKIES])
    return cookies.agg((F.size(F.array_intersect(F.collect_set(F.when(F.col("name").isin(*SESSION_COOKIES), F.col("name"))), wanted)) > 0).alias("usable"))


def read_undo_log(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, dedup_key, media_key, trashed_at, position) of the browser's undo files."""
    schema = "run_id string, items array<struct<dedup_key:string, media_key:string, trashed_at:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return whole.select("run_id", F.posexplode_outer("items").alias("position", "i")).where("i is not null").select("run_id", "i.*", "position")


#: (url) -> (status, body); raises for a failed connection.
Fetcher = Callable[[str], tuple[int, bytes]]


def fetch_images(urls: DataFrame, make_fetcher: Callable[[], Fetcher], tasks: int = 16, retries: int = 4, auth_failure_limit: int = 8, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(media_key, ok, status, content, error) of (media_key, url) rows, fetched in ``tasks`` parallel streams.

    Each url is tried ``retries`` times; a 404 once. Failures wait 2, 4, 8 and at most 16 s. A 403, or a page where an
    image should be, is a refused sign-in; a stream that only sees those stops and says so for the rest of its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, refused, good = make_fetcher(), 0, 0
        for batch in batches:
            out = []
            for key, url in zip(batch["media_key"], batch["url"], strict=True):
                if refused >= auth_failure_limit and not good:
                    out.append((key, False, None, None, "stopped: sign-in refused"))
                    continue
                status, body, error, denied = None, None, "not tried", False
                for attempt in range(1, retries + 1):
                    try:
                        status, body = fetch(url)
                        page = status == 200 and any(x in body[:64].lower() for x in (b"<!doctype", b"<html"))
                        denied |= status == 403 or page
                        error = "not an image" if page else None if status == 200 else f"status {status}"
                    except OSError as e:
                        error = str(e)
                    if error is None or status == 404:
                        break
                    pause(min(2**attempt, 16))
                refused += denied and error is not None
                good += error is None
                out.append((key, error is None, status, body if error is None else None, error))
            yield pd.DataFrame(out, columns=["media_key", "ok", "status", "content", "error"]).astype({"status": "Int32"})

    dealt = urls.select("media_key", "url").repartition(tasks)
    fetched = dealt.mapInPandas(run, "media_key string, ok boolean, status int, content binary, error string")
    valid = F.col("ok") & looks_like_image(F.col("content"))
    return fetched.withColumns({"error": F.when(F.col("ok") & ~valid, F.lit("not an image")).otherwise(F.col("error")), "ok": valid})
