"""Queries of sources, sinks, classifiers, upserts and the store over the derived photo library, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import classify, embed, grouping, reports, review, scoring, upsert, vectors
from ..sources import census, files, sinks
from . import fixture
from .catalogue import _BAND, _COSINE, _HEADS_SQL, _heads, _with_near, query
from .fixture import CONFIG, with_sql
from .lineage import shared_dir
from .store import SnapshotStore

# ---- sources


@query(
    with_sql(
        "SELECT media_key, dedup_key, timestamp, res_width, CAST(is_favorite AS VARCHAR) AS is_favorite, CAST(is_live_photo AS VARCHAR) AS is_live_photo, vec_id % 4 / 2.0 AS duration, CAST(vec_id % 4 > 0 AND NOT is_live_photo AS VARCHAR) AS is_video, 'quota' || CAST(0 AS VARCHAR) AS origin FROM x UNION ALL SELECT 'meta', 'v', NULL, NULL, NULL, NULL, NULL, NULL, 'meta'",
        "x",
    )
)
def census_parse(spark, sf_dir):
    """Catalogue lines whose numbers and flags are written as strings, and a meta line."""
    own = fixture.photos(spark, sf_dir)
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')), F.lit("null"))
    fields = {"media_key": text("media_key"), "dedup_key": text("dedup_key"), "timestamp": text("timestamp"), "res_width": F.concat(F.col("res_width").cast("string"), F.lit(".0")),
        "is_favorite": F.when(F.col("is_favorite"), '"yes"').otherwise("false"), "is_live_photo": F.when(F.col("is_live_photo"), "1").otherwise('"off"'), "duration": (F.col("vec_id") % 4 / 2).cast("string")}
    line = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), x) for k, x in fields.items()]), F.lit("}"))
    extra = spark.createDataFrame([(-1, '{"_type":"meta","meta":"v"}')], "line_no long, line string")
    found = census.parse_lines(own.select(F.col("vec_id").alias("line_no"), line.alias("line")).unionByName(extra))
    flag = lambda c: F.col(c).cast("string").alias(c)
    items = found.items.select("media_key", "dedup_key", "timestamp", "res_width", flag("is_favorite"), flag("is_live_photo"), "duration", flag("is_video"), F.lit("quota0").alias("origin"))
    return items.unionByName(found.meta.select(F.col("key").alias("media_key"), F.col("value").alias("dedup_key"), F.lit("meta").alias("origin")), allowMissingColumns=True)


_SUFFIXES = ("jpg", "JPEG", "png", "gif", "jfif", "jpe", "webp", "heic", "tif", "TIFF", "bmp", "mp4", "txt", "")


@query(
    with_sql(
        f"""SELECT 'lib/' || media_key || '.' || list_extract({list(_SUFFIXES)}, vec_id % 14 + 1) AS path FROM p
    WHERE lower(list_extract({list(_SUFFIXES)}, vec_id % 14 + 1)) IN ('bmp', 'jfif', 'jpe', 'jpeg', 'jpg', 'png', 'tif', 'tiff', 'webp')""",
        "p",
    )
)
def image_suffixes(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("vec_id") % len(_SUFFIXES) + 1).cast("int"))
    rows = fixture.photos(spark, sf_dir).select(F.concat(F.lit("lib/"), "media_key", F.lit("."), suffix).alias("path"))
    return rows.where(files.suffix_of(F.col("path")).isin(*files.IMAGE_SUFFIXES))


_ZIPPED = f"""z AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'other ' || media_key ELSE media_key END AS stem, 'zip' || CAST(vec_id % 3 AS VARCHAR) AS zip, {_HEADS_SQL} AS b FROM x),
o AS (SELECT z.*, CASE WHEN k.media_key IS NULL OR k.is_video THEN 'unknown_or_bad' WHEN k.thumb_cached THEN 'skipped'
    WHEN octet_length(b) >= 12 AND regexp_matches(hex(b), '^(FFD8FF|89504E470D0A1A0A|474946383761|474946383961|424D|52494646.{{8}}57454250)') THEN 'ok' ELSE 'unknown_or_bad' END AS outcome FROM z LEFT JOIN x k ON z.stem = k.media_key)"""


def _judged(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    stem = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("other "), "media_key")).otherwise(F.col("media_key"))
    entries = own.select(F.concat(F.lit("zip"), (F.col("vec_id") % 3).cast("string")).alias("zip"), F.col("media_key").alias("entry"), stem.alias("stem"), _heads().alias("content"))
    return files.judge_entries(entries, own, own.where("thumb_cached"))


@query(with_sql("", "x").rstrip() + f",\n{_ZIPPED}\nSELECT stem AS media_key, zip, outcome FROM o")
def zip_outcomes(spark, sf_dir):
    return _judged(spark, sf_dir).select("media_key", "zip", "outcome")


@query(with_sql("", "x").rstrip() + f",\n{_ZIPPED}\nSELECT count(DISTINCT zip) AS zips, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'unknown_or_bad') AS unknown_or_bad FROM o")
def zip_counts(spark, sf_dir):
    return files.zip_counters(_judged(spark, sf_dir))


@query(with_sql("SELECT media_key, thumb_cached, vec_id % 13 < 5 AS valid FROM x WHERE thumb_cached AND NOT is_video", "x").replace("SELECT media_key, thumb_cached, vec_id % 13 < 5 AS valid FROM x", "SELECT count(*) FILTER (vec_id % 13 < 5) AS valid, count(*) AS sampled FROM (SELECT * FROM x").replace("AND NOT is_video", "AND NOT is_video ORDER BY media_key LIMIT 50)"))
def thumb_check(spark, sf_dir):
    """How many of some cached thumbs hold an image: the sample is the feature."""
    own = fixture.photos(spark, sf_dir)
    content = F.when(F.col("vec_id") % 13 < 5, F.unhex(F.lit("FFD8FF0001020304050607080900"))).otherwise(F.unhex(F.lit("00")))
    return reports.thumb_sample(own, own.select("media_key", content.alias("content")))


@query(with_sql("""SELECT media_key, CASE vec_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'html' WHEN 2 THEN 'empty' END AS found
    FROM (SELECT media_key, vec_id FROM x WHERE thumb_cached AND NOT embedded AND NOT is_video AND NOT excluded ORDER BY timestamp NULLS FIRST, media_key LIMIT 50) WHERE vec_id % 4 <> 3""", "x"))
def embed_sample(spark, sf_dir):
    """What is wrong with the oldest pending thumbs, before a model is made: the sample is the feature."""
    own = fixture.photos(spark, sf_dir)
    v = F.col("vec_id")
    content = F.when(v % 4 == 1, F.lit("<html>sign in").cast("binary")).when(v % 4 == 2, F.lit("").cast("binary")).otherwise(F.unhex(F.lit("FFD8FF0001020304050607080900")))
    blobs = own.where(v % 4 != 0).select("media_key", content.alias("content"))
    return embed.bad_thumbs(embed.first_pending(embed.pending(own, own.where("embedded"))), blobs)


# ---- sinks and the store


@query(with_sql("SELECT x.media_key, dedup_key, file_name, vec_id % 30 AS line_count, vec_id / 1000.0 AS coverage, vec_id / 2000.0 AS ink_fraction FROM x WHERE vec_id % 3 = 0 AND vec_id % 4 = 1", "x"))
def accepted_text(spark, sf_dir):
    own, v = fixture.photos(spark, sf_dir), F.col("vec_id")
    flags = own.select("media_key", (v % 3 == 0).alias("is_text"), F.when(v % 4 == 1, "accepted").when(v % 4 == 2, "rejected").alias("review_status"), (v % 30).alias("line_count"), (v / 1000).alias("coverage"), (v / 2000).alias("ink_fraction"))
    return sinks.accepted_text(flags, own)


@query(with_sql("SELECT media_key, group_id, CAST(NULL AS DOUBLE) AS score FROM m UNION ALL SELECT 'decisions', 'none', 0.0", "m"))
def store_round_trip(spark, sf_dir):
    """Members through the snapshot store: written twice, read from the last manifest; a table never written is empty."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    m = fixture.members(fixture.photos(spark, sf_dir)).select("group_id", "media_key")
    store.commit(group_members=m.limit(0), meta=spark.createDataFrame([("a", "b")], "key string, value string"))
    store.commit(group_members=m)
    empty = spark.createDataFrame([("decisions", "none", float(store.read("decisions").count()))], "media_key string, group_id string, score double")
    return store.read("group_members").select("media_key", "group_id", "score").unionByName(empty)


# ---- upserts


@query(with_sql("SELECT 'k' || CAST(n AS VARCHAR) AS key, coalesce(max_by('new' || CAST(vec_id AS VARCHAR), vec_id) FILTER (n >= 10), 'old') AS value FROM (SELECT vec_id, vec_id % 20 AS n FROM x) GROUP BY n", "x"))
def meta_upsert(spark, sf_dir):
    own, v = fixture.photos(spark, sf_dir), F.col("vec_id")
    key = F.concat(F.lit("k"), (v % 20).cast("string")).alias("key")
    old = own.select(key, F.lit("old").alias("value")).distinct()
    new = own.where(v % 20 >= 10).select(key, F.concat(F.lit("new"), v.cast("string")).alias("value"), v.alias("line_no"))
    return upsert.upsert_meta(old, new)


@query(
    with_sql(
        """SELECT coalesce(n.group_id, d.group_id) AS group_id, CASE WHEN n.group_id IS NULL THEN d.keep_media_key ELSE n.proposed_keeper END AS keep_media_key, n.group_id IS NULL AND d.applied AS applied
    FROM (SELECT * FROM g WHERE status IN ('pending', 'accepted')) n FULL JOIN d ON n.group_id = d.group_id""",
        "g",
        "d",
    )
)
def decisions_upsert(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    m = fixture.members(own)
    g = fixture.groups(m)
    old = fixture.decisions(m, g).withColumn("decided_at", F.lit("before"))
    new = g.where(F.col("status").isin("pending", "accepted")).select("group_id", F.col("proposed_keeper").alias("keep_media_key"), F.array().cast("array<string>").alias("trash_dedup_keys"), F.lit("now").alias("decided_at"))
    return upsert.upsert_decisions(old, new).select("group_id", "keep_media_key", "applied")


@query(with_sql("SELECT media_key FROM x WHERE thumb_cached AND NOT embedded AND NOT is_video AND NOT excluded AND NOT vectorised", "x"))
def embed_pending(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    return embed.pending(own, own.where("vectorised").select("media_key")).select("media_key")


@query(with_sql("SELECT media_key, len(vector) AS dim, round(CAST(CASE WHEN embedded THEN 0 ELSE 1 END + vector[2] AS DOUBLE), 5) AS second FROM x WHERE vectorised OR NOT embedded", "x"))
def vectors_upsert(spark, sf_dir):
    """Packed to float32 bytes and back, then merged: new vectors replace old ones."""
    own = fixture.photos(spark, sf_dir)
    pairs = own.select("media_key", "vector", "vectorised", "embedded")

    def pack(batches):
        for b in batches:
            yield b[["media_key"]].assign(vector=[embed.pack(v) for v in b["vector"]])

    old = embed.unpack(pairs.where("vectorised").select("media_key", "vector").mapInPandas(pack, "media_key string, vector binary"))
    shifted = pairs.where("not embedded").select("media_key", F.transform("vector", lambda x: (x + 1).cast("float")).alias("vector"))
    new = embed.unpack(shifted.mapInPandas(pack, "media_key string, vector binary"))
    return upsert.upsert_vectors(old, new).select("media_key", F.col("dim").cast("long").alias("dim"), F.round(F.col("vector")[1].cast("double"), 5).alias("second"))


# ---- classifiers


@query(with_sql("SELECT media_key, round_even(vec_id / 8.0, 2) AS half_even, round(space_taken / 1073741824.0, 3) AS gb, coalesce(res_width, 0) * coalesce(res_height, 0)::BIGINT AS pixels FROM p", "p"))
def rounded(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", F.bround(F.col("vec_id") / 8, 2).alias("half_even"), scalars.gigabytes(F.col("space_taken")).alias("gb"), scalars.pixel_count(F.col("res_width"), F.col("res_height")).alias("pixels"))


_CORRUPT = f"""f AS (SELECT media_key, {_HEADS_SQL} AS b, CASE WHEN vec_id % 9 <> 4 THEN vec_id % 50 / 200.0 END AS fill, CASE WHEN vec_id % 2 = 0 THEN 128 ELSE 7 END AS colour FROM x),
h AS (SELECT *, hex(b) AS h, octet_length(b) AS n FROM f),
i AS (SELECT *, n >= 12 AND regexp_matches(h, '^(FFD8FF|89504E470D0A1A0A|474946383761|474946383961|424D|52494646.{{8}}57454250)') AS image, regexp_matches(h, '^52494646.{{8}}57454250') AS webp FROM h),
j AS (SELECT *, CASE WHEN n < 12 THEN ['empty'] WHEN NOT image THEN ['not_an_image'] ELSE list_filter([CASE WHEN h LIKE 'FFD8%' AND NOT regexp_matches(h, '^(..)*FFD9') THEN 'truncated_jpeg' END, CASE WHEN h LIKE '89504E47%' AND NOT regexp_matches(h, '^(..)*49454E44') THEN 'truncated_png' END], lambda q: q IS NOT NULL) END AS said,
    CASE WHEN fill >= 0.08 AND colour = 128 THEN ['decoder_fill'] WHEN fill >= 0.12 THEN ['trailing_fill'] ELSE [] END AS filled FROM i),
r AS (SELECT *, CASE WHEN NOT image OR (webp AND fill IS NULL) THEN said WHEN fill IS NULL THEN list_concat(said, ['unreadable']) ELSE list_concat(said, filled) END AS reasons FROM j)"""


def _corrupt(spark, sf_dir):
    own, v = fixture.photos(spark, sf_dir), F.col("vec_id")
    found = own.select(F.col("media_key").alias("path"), _heads().alias("content"))
    features = own.where(v % 9 != 4).select(F.col("media_key").alias("path"), (v % 50 / 200).alias("fill_raw"), F.array_repeat(F.when(v % 2 == 0, 128).otherwise(7), 3).alias("fill_color"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    return classify.corrupt_verdicts(found, features, CONFIG)


@query(
    with_sql("", "x").rstrip()
    + f""",\n{_CORRUPT}\nSELECT media_key, CASE WHEN image AND webp AND fill IS NULL THEN 'unknown' ELSE CAST(len(reasons) > 0 AS VARCHAR) END AS corrupted, array_to_string(reasons, '+') AS reasons,
    CASE WHEN image AND fill IS NOT NULL THEN round_even(fill, 4) ELSE 0.0 END AS fill_fraction, CASE WHEN image AND webp AND fill IS NULL THEN 'format not supported' WHEN image AND fill IS NULL THEN 'not decodable' END AS error FROM r"""
)
def corrupt_rules(spark, sf_dir):
    return _corrupt(spark, sf_dir).select(F.col("path").alias("media_key"), F.coalesce(F.col("corrupted").cast("string"), F.lit("unknown")).alias("corrupted"), F.array_join("reasons", "+").alias("reasons"), "fill_fraction", "error")


@query(
    with_sql("", "x").rstrip()
    + f""",\n{_CORRUPT}\nSELECT count(*) AS scanned, count(*) FILTER (NOT (image AND webp AND fill IS NULL) AND len(reasons) > 0) AS flagged, count(*) FILTER (NOT (image AND webp AND fill IS NULL) AND len(reasons) = 0) AS ok,
    CAST(1 AS BIGINT) AS missing, CAST(2 AS BIGINT) AS moved, CAST(3 AS BIGINT) AS copied FROM r"""
)
def scan_counts(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    expected = own.select("media_key").unionByName(spark.createDataFrame([("nobody",)], "media_key string"))
    return classify.scan_stats(_corrupt(spark, sf_dir).withColumnRenamed("path", "media_key"), "corrupted", expected, 2, 3)


@query(
    with_sql(
        """SELECT media_key, CASE WHEN vec_id % 11 = 3 THEN false ELSE colourful < 25 AND saturation < 0.25 AND smooth < 0.58 AND lines >= 8 AND cover >= 0.08 AND ink BETWEEN 0.025 AND 0.55 AND even END AS is_text,
    CASE WHEN vec_id % 11 = 3 THEN 'unreadable' WHEN colourful < 25 AND saturation < 0.25 AND smooth < 0.58 AND lines >= 8 AND cover >= 0.08 AND ink BETWEEN 0.025 AND 0.55 AND even THEN 'text_lines' ELSE '' END AS reasons
    FROM (SELECT media_key, vec_id, vec_id * 7 % 31 AS colourful, vec_id * 3 % 28 / 100.0 AS saturation, vec_id * 5 % 64 / 100.0 AS smooth, 4 + vec_id % 17 AS lines, vec_id % 23 / 50.0 AS cover, vec_id % 29 / 45.0 AS ink, vec_id % 6 <> 1 AS even FROM x)""",
        "x",
    )
)
def text_rules(spark, sf_dir):
    own, v = fixture.photos(spark, sf_dir), F.col("vec_id")
    features = own.where(v % 11 != 3).select(F.col("media_key").alias("path"), (v * 7 % 31).alias("colourfulness"), (v * 3 % 28 / 100).alias("saturation"), (v * 5 % 64 / 100).alias("smooth_share"), (4 + v % 17).alias("line_count"),
        (v % 23 / 50).alias("coverage_raw"), (v % 29 / 45).alias("ink_raw"), (v % 6 != 1).alias("spacing_ok"), F.lit(0.5).alias("coverage"), F.lit(0.5).alias("ink_fraction"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    found = own.select(F.col("media_key").alias("path"), F.unhex(F.lit("FFD8FF000102030405060708")).alias("content"))
    return classify.text_verdicts(found, features, CONFIG).select(F.col("path").alias("media_key"), "is_text", F.array_join("reasons", "+").alias("reasons"))


@query(with_sql("SELECT media_key, is_text, CASE WHEN is_text THEN ['accepted', 'rejected', 'skipped'][CAST(substr(media_key, 3) AS BIGINT) // 20 % 3 + 1] END AS review_status FROM t", "t"))
def text_review(spark, sf_dir):
    flags = fixture.text_flags(fixture.photos(spark, sf_dir)).withColumn("review_status", F.lit(None).cast("string"))
    turn = F.floor(F.substring("media_key", 3, 8).cast("long") / 20) % 3
    actions = flags.where("is_text").select("media_key", F.when(turn == 0, "accept").when(turn == 1, "reject").otherwise("skip").alias("action"))
    return review.decide_items(flags, actions, "is_text", review.TEXT_ACTIONS).select("media_key", "is_text", "review_status")


@query(with_sql("SELECT media_key, CASE WHEN vec_id % 3 <> 1 THEN 'preview' ELSE 'thumb' END AS source FROM x WHERE vec_id % 3 <> 1 OR thumb_cached", "x"))
def image_choice(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    previews = own.where("vec_id % 3 != 1").select("media_key", F.lit("preview").alias("source"))
    return scoring.best_image(previews, own.where("thumb_cached").select("media_key", F.lit("thumb").alias("source")))


_H, _W = 8, 10


def _pixel(y: str, x: str) -> str:
    """A grey value that follows from the photo's number and the place; the last rows of some photos are plain."""
    return f"CASE WHEN {y} >= 6 AND vec_id % 4 = 0 THEN 128 ELSE (vec_id * 31 + ({y}) * 17 + ({x}) * 29 + ({y}) * ({x}) * (vec_id % 7)) % 256 END"


def _pixel_sql() -> str:
    near = lambda k, d, n: f"({n - 1} - abs({n - 1} - abs({k} + ({d}))))" if d else k  # noqa: E731  mirrored at the borders
    at = {(i, j): f"v{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1)}
    cells = ", ".join(f"CAST({_pixel(near('y', i, _H), near('x', j, _W))} AS DOUBLE) AS {n}" for (i, j), n in at.items())
    return f"""px AS (SELECT media_key, vec_id, y, x, {cells} FROM p, (SELECT unnest(range({_H})) AS y), (SELECT unnest(range({_W})) AS x)),
e AS (SELECT *, v01 + v21 + v10 + v12 - 4 * v11 AS lap, (v02 + 2 * v12 + v22) - (v00 + 2 * v10 + v20) AS gx, (v20 + 2 * v21 + v22) - (v00 + 2 * v01 + v02) AS gy FROM px),
s AS (SELECT media_key, 0.6 * least(var_pop(lap) / 500, 1) + 0.4 * least(avg(gx * gx + gy * gy) / 2000, 1) AS sharpness,
    greatest(0, (1 - 2 * abs(avg(v11) / 255 - 0.5)) * (1 - least(avg(CASE WHEN v11 >= 250 OR v11 < 5 THEN 1.0 ELSE 0.0 END), 1))) AS exposure FROM e GROUP BY media_key),
b AS (SELECT media_key, least(floor(sqrt(gx * gx + gy * gy) / 7.96875), 31) AS bin, count(*) AS n FROM e WHERE sqrt(gx * gx + gy * gy) <= 255 GROUP BY ALL),
d AS (SELECT media_key, n / sum(n) OVER (PARTITION BY media_key) / 7.96875 + 1e-9 AS q FROM b),
a AS (SELECT media_key, least((-sum(q * ln(q)) - (32 - count(*)) * 1e-9 * ln(1e-9)) / 4, 1) AS aesthetic FROM d GROUP BY media_key),
f AS (SELECT media_key, y, stddev_pop(v11) < 1.5 AS flat FROM e GROUP BY media_key, y),
t AS (SELECT media_key, ({_H} - coalesce(max(y) FILTER (NOT flat) + 1, 0)) / {_H}.0 AS fill FROM f GROUP BY media_key)
SELECT s.media_key, round(sharpness, 6) AS sharpness, round(exposure, 6) AS exposure, 0.5 AS eyes, 0.5 AS smile, round(coalesce(aesthetic, 0), 6) AS aesthetic, fill FROM s LEFT JOIN a ON s.media_key = a.media_key JOIN t ON s.media_key = t.media_key"""


@query(with_sql("", "p").rstrip() + ",\n" + _pixel_sql())
def pixel_kernels(spark, sf_dir):
    """Kernels over a small grey image of each photo, whose pixels follow from its number."""
    import numpy as np
    import pandas as pd

    from ..functions import kernels

    def run(batches):
        y, x = np.indices((_H, _W))
        for b in batches:
            rows = []
            for key, n in zip(b["media_key"], b["vec_id"], strict=True):
                grey = (n * 31 + y * 17 + x * 29 + y * x * (n % 7)) % 256
                if n % 4 == 0:
                    grey[6:] = 128
                rgb = np.repeat(grey[..., None].astype(np.uint8), 3, axis=2)
                rows.append({"media_key": key, **{k: float(v) for k, v in kernels.score(rgb).items() if k not in ("width", "height")}, "fill": kernels.trailing_fill(rgb)[0]})
            yield pd.DataFrame(rows)

    names = ("sharpness", "exposure", "eyes", "smile", "aesthetic", "fill")
    found = fixture.photos(spark, sf_dir).select("media_key", "vec_id").mapInPandas(run, "media_key string, " + ", ".join(f"{c} double" for c in names))
    return found.select("media_key", *[F.round(c, 6).alias(c) for c in names])


# ---- groups of usable photos, end to end

_USABLE = "uv AS (SELECT *, CASE WHEN timestamp > 10000000000 THEN timestamp // 1000 ELSE timestamp END AS t FROM x WHERE NOT excluded AND NOT is_video)"
_GROUPED = f"""{_USABLE},
s AS (SELECT a.media_key AS a, b.media_key AS b, round({_COSINE}, 12) AS sim FROM uv a JOIN uv b ON a.media_key <> b.media_key),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s),
w AS (SELECT a.media_key AS a, b.media_key AS b FROM uv a JOIN uv b ON {_BAND} WHERE a.embedded AND b.embedded AND {_COSINE} >= 0.35),
y AS (SELECT a, b FROM r WHERE rank <= 20 AND sim >= 0.45),
l AS (SELECT a, b FROM w UNION SELECT b, a FROM w UNION SELECT a, b FROM y UNION SELECT b, a FROM y),
z(k, root) AS (SELECT a, a FROM l UNION SELECT l.b, z.root FROM z JOIN l ON z.k = l.a WHERE z.root < l.b),
o AS (SELECT k, substr(sha1(min(root)), 1, 8) AS group_id FROM z GROUP BY k)"""


def _with_usable(body: str) -> str:
    return with_sql("", "x").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{_GROUPED}{body}"


@query(with_sql("", "x").rstrip() + f",\n{_USABLE}\nSELECT media_key, t, embedded, len(vector) AS dim FROM uv")
def usable_vectors(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    return grouping.usable_vectors(own, own.select("media_key", "vector")).select("media_key", "t", "embedded", F.size("vector").cast("long").alias("dim"))


@query(_with_usable("\nSELECT (SELECT count(*) FROM w) AS time_pairs, (SELECT count(*) FROM y) AS ann_pairs, (SELECT count(DISTINCT group_id) FROM o) AS groups, (SELECT count(*) FROM o) AS members"))
def group_counters(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    found = grouping.build_groups(own, own.select("media_key", "vector"), CONFIG)
    return spark.createDataFrame([tuple(found.counters.values())], ", ".join(f"{k} long" for k in found.counters))


@query(_with_near("SELECT round(greatest(0.88, quantile_cont(best, 0.99) - 0.02), 6) AS try_global_cosine FROM (SELECT a, max(sim) AS best FROM r WHERE rank <= 3 GROUP BY a)"))
def group_hint(spark, sf_dir):
    p99 = vectors.neighbour_percentiles(vectors.knn(fixture.photos(spark, sf_dir), 3, cfg=CONFIG)).first()["p99"]
    return spark.createDataFrame([(round(grouping.no_group_hint(p99), 6),)], "try_global_cosine double")


FLAGSHIP_SQL = _with_usable(
    """,
c AS (SELECT o.group_id, x.media_key, is_favorite, least(CAST(coalesce(nullif(res_width, 0), 640) AS DOUBLE) * coalesce(nullif(res_height, 0), 480) / 12e6, 1.0) AS resolution,
    vec_id * 37 % 101 / 101.0 AS sharpness, vec_id * 53 % 97 / 97.0 AS exposure, vec_id * 29 % 89 / 89.0 AS eyes, vec_id * 31 % 83 / 83.0 AS smile, vec_id * 41 % 79 / 79.0 AS aesthetic FROM o JOIN x ON o.k = x.media_key),
e AS (SELECT *, 0.35 * sharpness + 0.15 * exposure + 0.25 * eyes + 0.10 * smile + 0.10 * aesthetic + 0.05 * resolution AS total FROM c)
SELECT group_id, count(*) AS size, arg_min(media_key, (NOT is_favorite, -total, media_key)) AS proposed_keeper, round(max(total), 6) AS best_total FROM e GROUP BY group_id"""
)
