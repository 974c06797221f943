"""One query per engine operator over the derived photo library, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import image_bytes, scalars
from ..operators import apply, bandjoin, grouping, reports, review, safety, scoring, upsert, vectors
from ..operators.components import connected_components
from . import fixture
from .fixture import CONFIG, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _library(spark: SparkSession, sf_dir: str):
    own = fixture.photos(spark, sf_dir)
    m = fixture.members(own)
    g = fixture.groups(m)
    return own, m, g, fixture.decisions(m, g)


# ---- scalars and predicates


@query(with_sql("SELECT media_key, excluded, exclude_reason FROM x", "x"))
def safety_flags(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", "excluded", "exclude_reason")


@query(
    with_sql(
        """SELECT count(*) FILTER (is_favorite) AS favorites, CAST(0 AS BIGINT) AS album_members, count(*) FILTER (is_video) AS videos, count(*) FILTER (is_live_photo) AS live_photos,
        count(*) FILTER (excluded) AS total_excluded FROM x""",
        "x",
    )
)
def safety_counts(spark, sf_dir):
    return safety.exclusion_counts(fixture.photos(spark, sf_dir), CONFIG)


@query(with_sql("SELECT media_key, CASE WHEN timestamp > 10000000000 THEN timestamp // 1000 ELSE timestamp END AS epoch FROM p", "p"))
def epoch_norm(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", scalars.epoch_seconds(F.col("timestamp")).alias("epoch"))


@query(
    with_sql(
        """SELECT media_key, CASE WHEN thumb = '' THEN '' WHEN thumb IS NOT NULL THEN split_part(split_part(thumb, '=', 1), '?', 1) || '=w256-h256-k-no?authuser=0' END AS thumb_url,
        CASE WHEN thumb = '' THEN '' WHEN thumb IS NOT NULL THEN split_part(split_part(thumb, '=', 1), '?', 1) || '=w4096-h4096-k-no?authuser=0' END AS full_url FROM p""",
        "p",
    )
)
def url_rewrite(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", scalars.sized_url(F.col("thumb"), CONFIG.thumb_px).alias("thumb_url"), scalars.sized_url(F.col("thumb"), CONFIG.full_px).alias("full_url"))


@query(with_sql("SELECT media_key, 'root/' || substr(sha1(media_key), 1, 2) || '/' || substr(sha1(media_key), 3, 2) || '/' || media_key || '.jpg' AS path FROM p", "p"))
def blob_path(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", scalars.blob_path(F.col("media_key"), "root").alias("path"))


@query(
    with_sql(
        """SELECT media_key, regexp_replace(file_name, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe, regexp_replace(file_name, '[/\\\\?%*:|"<>]', '_', 'g') AS browser FROM p""",
        "p",
    )
)
def key_sanitise(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", scalars.safe_key(F.col("file_name")).alias("safe"), scalars.safe_browser_key(F.col("file_name")).alias("browser"))


@query(
    with_sql(
        """SELECT media_key, CASE WHEN reasons IS NULL OR reasons = '' THEN '' WHEN reasons LIKE '[%' THEN array_to_string(CAST(CAST(reasons AS JSON) AS VARCHAR[]), '+') ELSE reasons END AS reasons,
        fill_color, CASE WHEN fill_color IS NOT NULL THEN CAST(split_part(fill_color, ',', 1) AS BIGINT) + CAST(split_part(fill_color, ',', 3) AS BIGINT) END AS red_blue FROM c""",
        "c",
    )
)
def json_reasons(spark, sf_dir):
    c = fixture.corrupt_flags(fixture.photos(spark, sf_dir))
    rgb = scalars.colour_array(F.col("fill_color"))
    return c.select("media_key", F.array_join(scalars.reasons_array(F.col("reasons")), "+").alias("reasons"), scalars.colour_text(rgb).alias("fill_color"), (rgb[0] + rgb[2]).cast("long").alias("red_blue"))


@query(with_sql("SELECT media_key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM p", "p"))
def json_props(spark, sf_dir):
    return fixture.photos(spark, sf_dir).select("media_key", F.from_json("props", "k long")["k"].alias("k"))


def _heads() -> F.Column:
    """Byte heads of every kind, dealt by number."""
    kinds = ["FFD8FF", "FFD8FFAAFFD9", "89504E470D0A1A0A", "89504E470D0A1A0A49454E44", "474946383961", "474946383761", "424D", "524946460000000057454250", "5249464600000000", "3C21444F43545950", "0FFD90", ""]
    tail = F.when(F.col("vec_id") % 7 == 0, "").otherwise("000102030405060708090A0B")
    return F.unhex(F.concat(F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("vec_id") % len(kinds) + 1).cast("int")), tail))


_HEADS_SQL = """unhex(list_extract(['FFD8FF', 'FFD8FFAAFFD9', '89504E470D0A1A0A', '89504E470D0A1A0A49454E44', '474946383961', '474946383761', '424D', '524946460000000057454250', '5249464600000000',
    '3C21444F43545950', '0FFD90', ''], vec_id % 12 + 1) || CASE WHEN vec_id % 7 = 0 THEN '' ELSE '000102030405060708090A0B' END)"""


@query(
    with_sql(
        f"""SELECT media_key, octet_length(b) >= 12 AND (hex(b) LIKE 'FFD8FF%' OR hex(b) LIKE '89504E470D0A1A0A%' OR hex(b) LIKE '474946383761%' OR hex(b) LIKE '474946383961%' OR hex(b) LIKE '424D%'
        OR (hex(b) LIKE '52494646%' AND substr(hex(b), 17, 8) = '57454250')) AS is_image,
        hex(b) LIKE 'FFD8%' AND NOT regexp_matches(hex(b), '^(..)*FFD9') AS jpeg_cut, hex(b) LIKE '89504E47%' AND NOT regexp_matches(hex(b), '^(..)*49454E44') AS png_cut
        FROM (SELECT media_key, {_HEADS_SQL} AS b FROM p)""",
        "p",
    )
)
def image_magic(spark, sf_dir):
    b = F.col("b")
    rows = fixture.photos(spark, sf_dir).select("media_key", _heads().alias("b"))
    return rows.select("media_key", image_bytes.looks_like_image(b).alias("is_image"), image_bytes.jpeg_without_end(b).alias("jpeg_cut"), image_bytes.png_without_end(b).alias("png_cut"))


# ---- vectors, bands, groups

_COSINE = "list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))))"
_NEAR = f"""s AS (SELECT a.media_key AS a, b.media_key AS b, round({_COSINE}, 12) AS sim FROM p a JOIN p b ON a.media_key <> b.media_key),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s)"""


def _with_near(body: str, *parts: str) -> str:
    head = with_sql("", *(parts or ("p",))).rstrip()
    return f"{head},\n{_NEAR}\n{body}"


@query(with_sql("SELECT media_key, round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS norm, round(vector[1] / sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS first FROM p", "p"))
def l2_normalise(spark, sf_dir):
    v = F.col("vector")
    return fixture.photos(spark, sf_dir).select("media_key", F.round(scalars.norm(v), 6).alias("norm"), F.round(scalars.normalise(v)[0], 6).alias("first"))


@query(_with_near("SELECT a, b, rank, round(sim, 6) AS sim FROM r WHERE rank <= 3"))
def knn_topk(spark, sf_dir):
    return vectors.knn(fixture.photos(spark, sf_dir), 3, cfg=CONFIG).select("a", "b", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@query(_with_near("SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(sim), 6) AS sim, count(*) AS directed FROM r WHERE rank <= 20 AND sim >= 0.45 GROUP BY least(a, b), greatest(a, b)"))
def knn_edges(spark, sf_dir):
    near = vectors.knn(fixture.photos(spark, sf_dir), CONFIG.topk, CONFIG.global_cosine, CONFIG)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("sim"), 6).alias("sim"), F.count("*").alias("directed"))


@query(
    _with_near(
        """SELECT count(*) AS n, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.9), 6) AS p90, round(quantile_cont(best, 0.99), 6) AS p99, round(max(best), 6) AS max,
        count(*) FILTER (best >= 0.3) AS at_30, count(*) FILTER (best >= 0.35) AS at_35, count(*) FILTER (best >= 0.4) AS at_40 FROM (SELECT a, max(sim) AS best FROM r WHERE rank <= 3 GROUP BY a)"""
    )
)
def best_neighbour_pcts(spark, sf_dir):
    row = vectors.neighbour_percentiles(vectors.knn(fixture.photos(spark, sf_dir), 3, cfg=CONFIG), (0.30, 0.35, 0.40))
    return row.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


_TIMES = "t AS (SELECT media_key, vector, embedded, CASE WHEN timestamp > 10000000000 THEN timestamp // 1000 ELSE timestamp END AS t FROM p)"
_BAND = "a.t <= b.t AND b.t - a.t <= 3600 AND (a.t < b.t OR a.media_key < b.media_key)"


@query(with_sql("", "p").rstrip() + f",\n{_TIMES}\nSELECT a.media_key AS a, b.media_key AS b, b.t - a.t AS gap FROM t a JOIN t b ON {_BAND}")
def time_band_pairs(spark, sf_dir):
    own = fixture.photos(spark, sf_dir).select("media_key", scalars.epoch_seconds(F.col("timestamp")).alias("t"))
    return bandjoin.band_pairs(own, CONFIG.time_window_s)


@query(with_sql("", "p").rstrip() + f",\n{_TIMES}\nSELECT a.media_key AS a, b.media_key AS b, round({_COSINE}, 6) AS sim FROM t a JOIN t b ON {_BAND} WHERE {_COSINE} >= 0.35")
def burst_edges(spark, sf_dir):
    own = fixture.photos(spark, sf_dir).select("media_key", "vector", scalars.epoch_seconds(F.col("timestamp")).alias("t"))
    return grouping.burst_edges(own, CONFIG.time_window_s, CONFIG.time_cosine).select("a", "b", F.round("sim", 6).alias("sim"))


_GROUPS = f"""{_NEAR},
{_TIMES},
e AS (SELECT a, b FROM r WHERE rank <= 20 AND sim >= 0.45 UNION SELECT a.media_key, b.media_key FROM t a JOIN t b ON {_BAND} WHERE a.embedded AND b.embedded AND {_COSINE} >= 0.35),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
z(k, root) AS (SELECT a, a FROM l UNION SELECT l.b, z.root FROM z JOIN l ON z.k = l.a WHERE z.root < l.b),
o AS (SELECT k, min(root) AS root FROM z GROUP BY k)"""


def _with_groups(body: str) -> str:
    return with_sql("", "p").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{_GROUPS}\n{body}"


def _edges(spark, sf_dir) -> DataFrame:
    own = fixture.photos(spark, sf_dir).select("media_key", "vector", "embedded", scalars.epoch_seconds(F.col("timestamp")).alias("t"))
    timed = grouping.burst_edges(own.where("embedded"), CONFIG.time_window_s, CONFIG.time_cosine).select("a", "b")
    return timed.union(vectors.knn(own, CONFIG.topk, CONFIG.global_cosine, CONFIG).select("a", "b"))


@query(_with_groups("SELECT k AS node, root AS component FROM o"))
def components(spark, sf_dir):
    return connected_components(_edges(spark, sf_dir), "a", "b")


@query(_with_groups("SELECT substr(sha1(root), 1, 8) AS group_id, k AS media_key FROM o"))
def dup_groups(spark, sf_dir):
    return grouping.group_members(_edges(spark, sf_dir), CONFIG.min_group_size)


@query(_with_groups("SELECT n AS size, count(*) AS groups FROM (SELECT root, count(*) AS n FROM o GROUP BY root HAVING count(*) >= 2) GROUP BY n"))
def group_sizes(spark, sf_dir):
    return dup_groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query(with_sql("SELECT CAST(quantile_cont(timestamp, 0.5) AS DOUBLE) AS median_ts, CASE WHEN quantile_cont(timestamp, 0.5) > 10000000000 THEN 'ms' ELSE 's' END AS unit FROM p", "p"))
def ts_median_unit(spark, sf_dir):
    return grouping.timestamp_unit(fixture.photos(spark, sf_dir))


# ---- scores and keepers

_SCORED = """s AS (SELECT *, least(CAST(coalesce(nullif(res_width, 0), 640) AS DOUBLE) * coalesce(nullif(res_height, 0), 480) / 12e6, 1.0) AS resolution FROM m),
w AS (SELECT *, 0.35 * sharpness + 0.15 * exposure + 0.25 * eyes + 0.10 * smile + 0.10 * aesthetic + 0.05 * resolution AS total FROM s),
n AS (SELECT *, CASE WHEN max(total) OVER q - min(total) OVER q < 1e-9 THEN 0.5 ELSE (total - min(total) OVER q) / (max(total) OVER q - min(total) OVER q) END AS score FROM w WINDOW q AS (PARTITION BY group_id))"""


def _with_scores(body: str) -> str:
    return with_sql("", "m").rstrip() + f",\n{_SCORED}\n{body}"


def _scored(spark, sf_dir) -> DataFrame:
    own = fixture.photos(spark, sf_dir)
    m = fixture.members(own)
    features = m.select("media_key", "sharpness", "exposure", "eyes", "smile", "aesthetic", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return scoring.score_members(m, own, features, CONFIG)


@query(_with_scores("SELECT group_id, media_key, round(resolution, 6) AS resolution, round(total, 6) AS total FROM w"))
def weighted_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("group_id", "media_key", F.round("resolution", 6).alias("resolution"), F.round("total", 6).alias("total"))


@query(_with_scores("SELECT group_id, media_key, round(score, 6) AS score FROM n"))
def group_minmax(spark, sf_dir):
    return scoring.pick_keepers(_scored(spark, sf_dir)).select("group_id", "media_key", F.round("score", 6).alias("score"))


@query(_with_scores("SELECT group_id, media_key FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY is_favorite DESC, score DESC, media_key) AS rn FROM n) WHERE rn = 1"))
def keeper_pick(spark, sf_dir):
    return scoring.pick_keepers(_scored(spark, sf_dir)).where("is_proposed_keeper").select("group_id", "media_key")


@query(_with_scores("SELECT group_id, string_agg(media_key, ',' ORDER BY is_favorite DESC, score DESC, media_key) AS shown, count(*) AS n FROM n GROUP BY group_id"))
def group_view(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    picked = scoring.pick_keepers(_scored(spark, sf_dir)).select("group_id", "media_key", F.col("is_favorite").alias("is_proposed_keeper"), "score")
    v = review.member_views(picked, own)
    return v.select("group_id", F.array_join(F.transform("members", lambda x: x["media_key"]), ",").alias("shown"), F.size("members").cast("long").alias("n"))


# ---- decisions and review

_ARRAYS = """k AS (SELECT m.group_id, min(g.proposed_keeper) AS proposed, min(g.n) AS n, list(m.media_key ORDER BY m.media_key) AS keys, list(m.dedup_key ORDER BY m.media_key) AS dedups,
    list(m.is_favorite OR m.excluded ORDER BY m.media_key) AS safe FROM m JOIN g ON m.group_id = g.group_id GROUP BY m.group_id),
w AS (SELECT *, CASE n % 6 WHEN 0 THEN [keys[1]] WHEN 1 THEN [keys[2], keys[1], '', keys[2]] WHEN 2 THEN keys WHEN 3 THEN [keys[len(keys)]] WHEN 4 THEN ['nobody'] ELSE [''] END AS keep FROM k),
v AS (SELECT *, list_distinct(list_filter(keep, lambda q: q IS NOT NULL AND q <> '')) AS own FROM w)"""


def _actions(g: DataFrame, m: DataFrame) -> DataFrame:
    own = m.groupBy("group_id").agg(F.sort_array(F.collect_list("media_key")).alias("k")).join(g, "group_id")
    n, k = F.col("n") % 6, F.col("k")
    second = F.get(k, F.lit(1))
    keep = F.when(n == 0, F.array(k[0])).when(n == 1, F.array(second, k[0], F.lit(""), second)).when(n == 2, k).when(n == 3, F.array(F.element_at(k, -1))).when(n == 4, F.array(F.lit("nobody"))).otherwise(F.array(F.lit("")))
    return own.select("group_id", F.lit("override").alias("action"), keep.alias("keep_keys"))


@query(
    with_sql("", "g").rstrip()
    + f""",\n{_ARRAYS}
SELECT group_id, CASE WHEN NOT list_has_all(keys, own) THEN 'keep_media_key is not in this group' WHEN len(own) = 0 THEN 'no keeper available' END AS error,
    CASE WHEN NOT list_has_all(keys, own) OR len(own) = 0 THEN NULL WHEN list_has_all(own, keys) THEN 'kept_all' WHEN len(own) = 1 AND own[1] = proposed THEN 'accepted' ELSE 'overridden' END AS status,
    CASE WHEN NOT list_has_all(keys, own) OR len(own) = 0 THEN NULL WHEN list_contains(own, proposed) THEN proposed WHEN n % 6 = 1 AND keys[2] IS NOT NULL THEN keys[2] ELSE own[1] END AS keep,
    CASE WHEN NOT list_has_all(keys, own) OR len(own) = 0 THEN NULL ELSE array_to_string(list_transform(list_filter(range(1, len(keys) + 1), lambda i: NOT list_contains(own, keys[i]) AND NOT safe[i]), lambda i: dedups[i]), ',') END AS trash
FROM v"""
)
def keep_decision(spark, sf_dir):
    own, m, g, _ = _library(spark, sf_dir)
    d = review.decide(_actions(g, m), g, m, own)
    return d.select("group_id", "error", "status", "keep", F.array_join("trash", ",").alias("trash"))


@query(
    with_sql("", "g").rstrip()
    + f""",\n{_ARRAYS}
SELECT group_id, 'deleted_all' AS status, coalesce(keys[list_position(safe, true)], '') AS keep, array_to_string(list_transform(list_filter(range(1, len(keys) + 1), lambda i: NOT safe[i]), lambda i: dedups[i]), ',') AS trash FROM v"""
)
def delete_all_decision(spark, sf_dir):
    own, m, g, _ = _library(spark, sf_dir)
    d = review.decide(g.select("group_id", F.lit("delete_all").alias("action"), F.array().cast("array<string>").alias("keep_keys")), g, m, own)
    return d.select("group_id", "status", "keep", F.array_join("trash", ",").alias("trash"))


@query(with_sql("SELECT group_id FROM g WHERE coalesce(status, 'pending') = 'pending' ORDER BY group_id <= 'g058', group_id LIMIT 1", "g"))
def queue_next(spark, sf_dir):
    return review.next_pending(_library(spark, sf_dir)[2], "g058").select("group_id")


@query(with_sql("SELECT count(*) AS total, count(*) FILTER (coalesce(status, 'pending') = 'pending') AS pending, count(*) FILTER (coalesce(status, 'pending') <> 'pending') AS decided FROM g", "g"))
def queue_counts(spark, sf_dir):
    return review.queue_counts(_library(spark, sf_dir)[2])


@query(with_sql("SELECT c.media_key, x.dedup_key FROM c JOIN x ON c.media_key = x.media_key WHERE corrupted AND coalesce(review_status, 'pending') = 'pending' ORDER BY c.media_key <= 'mk00000200', c.media_key LIMIT 1", "c"))
def corrupt_next(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    return review.next_flagged(fixture.corrupt_flags(own), own, "corrupted", "mk00000200").select("media_key", "dedup_key")


@query(with_sql("SELECT media_key, corrupted, CASE WHEN corrupted THEN CASE (CAST(substr(media_key, 3) AS BIGINT) // 20) % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'trash' ELSE 'skipped' END ELSE review_status END AS review_status FROM c", "c"))
def review_items(spark, sf_dir):
    flags = fixture.corrupt_flags(fixture.photos(spark, sf_dir))
    turn = F.floor(F.substring("media_key", 3, 8).cast("long") / 20) % 3
    actions = flags.where("corrupted").select("media_key", F.when(turn == 0, "keep").when(turn == 1, "trash").otherwise("skip").alias("action"))
    return review.decide_items(flags, actions, "corrupted", review.CORRUPT_ACTIONS).select("media_key", "corrupted", "review_status")


# ---- export, undo, restore


@query(
    with_sql(
        """, w AS (SELECT unnest(trash_dedup_keys) AS k FROM d WHERE NOT applied),
h AS (SELECT CAST(coalesce(sum(space_taken), 0) AS BIGINT) AS b, count(*) FILTER (is_favorite) AS f FROM x WHERE dedup_key IN (SELECT k FROM w)),
q AS (SELECT count(*) AS n FROM c JOIN x ON c.media_key = x.media_key WHERE corrupted AND review_status = 'trash' AND NOT is_favorite AND NOT excluded AND NOT in_album)
SELECT (SELECT count(*) FROM g WHERE status = 'pending') AS groups_pending_review, (SELECT count(*) FROM g WHERE status IN ('accepted', 'overridden')) AS groups_decided,
    (SELECT count(*) FROM w) + q.n AS items_to_trash, (SELECT count(*) FROM d WHERE NOT applied) AS items_to_keep, q.n AS corrupt_to_trash, h.b AS estimated_bytes,
    round(h.b / 1073741824.0, 3) AS estimated_gb, h.f AS favorite_conflicts, h.f = 0 AND (SELECT count(*) FROM w) + q.n > 0 AS safe_to_apply FROM h, q""",
        "d",
        "c",
    ).replace("\n, w AS", ",\nw AS")
)
def dry_run(spark, sf_dir):
    own, _, g, d = _library(spark, sf_dir)
    return apply.dry_run(g, d, own, fixture.corrupt_flags(own))


_TRASH = """, f AS (SELECT dedup_key, min(media_key) AS media_key FROM x GROUP BY dedup_key),
w AS (SELECT group_id, unnest(trash_dedup_keys) AS dedup_key, unnest(range(len(trash_dedup_keys))) AS pos FROM d WHERE NOT applied),
i AS (SELECT f.media_key, w.dedup_key, w.group_id, 0 AS o, pos FROM w JOIN f ON w.dedup_key = f.dedup_key UNION ALL
      SELECT x.media_key, x.dedup_key, 'corrupt', 1, 0 FROM c JOIN x ON c.media_key = x.media_key WHERE corrupted AND review_status = 'trash'),
j AS (SELECT i.*, row_number() OVER (PARTITION BY i.media_key ORDER BY o, i.group_id, pos) AS rn FROM i JOIN x ON i.media_key = x.media_key WHERE NOT x.is_favorite AND NOT x.excluded AND NOT x.in_album),
y AS (SELECT media_key, dedup_key, group_id FROM j WHERE rn = 1)"""


def _with_trash(body: str) -> str:
    return with_sql(_TRASH + "\n" + body, "d", "c").replace("\n, f AS", ",\nf AS")


@query(_with_trash("SELECT * FROM y"))
def trash_export(spark, sf_dir):
    own, _, _, d = _library(spark, sf_dir)
    return apply.trash_items(d, own, fixture.corrupt_flags(own))


@query(_with_trash("SELECT media_key, (row_number() OVER (ORDER BY substr(sha1(media_key), 1, 3), media_key) - 1) // 50 AS batch FROM y"))
def trash_batches(spark, sf_dir):
    return apply.batches(trash_export(spark, sf_dir)).select("media_key", F.col("batch").cast("long").alias("batch"))


@query(with_sql("SELECT min(media_key) AS media_key, dedup_key, count(*) AS copies FROM x GROUP BY dedup_key", "x"))
def dedup_lookup(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    copies = own.groupBy("dedup_key").agg(F.count("*").alias("copies"))
    return apply.photo_of_dedup_key(own).join(copies, "dedup_key").select("media_key", "dedup_key", "copies")


@query(with_sql("SELECT max_by(run_id, id) AS run_id FROM u WHERE NOT restored", "u"))
def undo_latest_run(spark, sf_dir):
    return apply.latest_run(fixture.undo_log(fixture.photos(spark, sf_dir)))


@query(with_sql("SELECT media_key, dedup_key, trashed_at FROM u WHERE NOT restored AND run_id = (SELECT max_by(run_id, id) FROM u WHERE NOT restored)", "u"))
def restore_items(spark, sf_dir):
    return apply.restore_items(fixture.undo_log(fixture.photos(spark, sf_dir)))


@query(with_sql("SELECT id, run_id, restored OR run_id = 'run-2' AS restored FROM u", "u"))
def mark_restored(spark, sf_dir):
    return apply.mark_restored(fixture.undo_log(fixture.photos(spark, sf_dir)), "run-2").select("id", "run_id", "restored")


@query(
    with_sql(
        """SELECT * FROM (SELECT id, run_id, dedup_key, trashed_at FROM u UNION ALL
    SELECT (SELECT max(id) FROM u) + row_number() OVER (ORDER BY vec_id), 'run-new', dedup_key, CASE WHEN vec_id % 2 = 0 THEN 'then' ELSE 'now' END FROM x)""",
        "u",
    )
)
def undo_import(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    new = own.select(F.lit("run-new").alias("run_id"), "dedup_key", "media_key", F.when(F.col("vec_id") % 2 == 0, "then").alias("trashed_at"), F.col("vec_id").alias("position"))
    return apply.import_undo(fixture.undo_log(own), new, "now").select("id", "run_id", "dedup_key", "trashed_at")


@query(with_sql("SELECT group_id, applied OR NOT EXISTS (SELECT 1 FROM (SELECT unnest(trash_dedup_keys) AS k) WHERE k NOT IN (SELECT dedup_key FROM u WHERE NOT restored)) AS applied FROM d", "d", "u"))
def mark_applied_covered(spark, sf_dir):
    own, _, _, d = _library(spark, sf_dir)
    return apply.mark_applied(d, "now", fixture.undo_log(own).where("not restored")).select("group_id", "applied")


# ---- reports


@query(
    with_sql(
        """SELECT (SELECT count(*) FROM x) AS total, count(*) FILTER (is_video) AS videos, count(*) FILTER (is_live_photo) AS live_photos, count(*) FILTER (is_favorite) AS favorites, count(*) FILTER (is_archived) AS archived,
    count(*) FILTER (NOT is_video) AS photos, count(*) FILTER (thumb_cached) AS thumbs_cached, count(*) FILTER (embedded) AS embedded, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE status = 'pending') AS groups_pending FROM x""",
        "g",
    )
)
def census_report(spark, sf_dir):
    own, _, g, _ = _library(spark, sf_dir)
    return reports.census_report(own, g)


@query(
    with_sql(
        """SELECT count(*) AS photos_total, count(*) FILTER (is_video) AS videos, count(*) FILTER (excluded) AS excluded, count(*) FILTER (exclude_reason LIKE '%favorite%') AS excluded_favorite,
    count(*) FILTER (exclude_reason LIKE '%album%') AS excluded_album, count(*) FILTER (thumb IS NOT NULL AND NOT is_video) AS with_thumb_url, count(*) FILTER (thumb_cached AND NOT is_video) AS thumbs_cached,
    count(*) FILTER (thumb_cached AND NOT embedded AND NOT is_video AND NOT excluded) AS ready_to_embed, count(*) FILTER (embedded AND NOT is_video AND NOT excluded) AS embedded_flag,
    count(*) FILTER (vectorised) AS embeddings_rows, count(*) FILTER (vectorised AND NOT excluded AND NOT is_video) AS usable_for_group, (SELECT count(*) FROM g) AS groups,
    (SELECT count(*) FROM c WHERE corrupted) AS corrupt_thumbs, (SELECT count(*) FROM t WHERE is_text) AS text_thumbs, 'review' AS next_step FROM x""",
        "g",
        "c",
        "t",
    )
)
def status_funnel(spark, sf_dir):
    own, _, g, _ = _library(spark, sf_dir)
    return reports.status_funnel(own, own.where("vectorised").select("media_key"), g, fixture.corrupt_flags(own), fixture.text_flags(own))


@query(with_sql("SELECT metric, CAST(value AS VARCHAR) AS value FROM (SELECT count(*) AS total, count(*) FILTER (coalesce(status, 'pending') = 'pending') AS pending, count(*) FILTER (coalesce(status, 'pending') <> 'pending') AS decided FROM g) UNPIVOT (value FOR metric IN (total, pending, decided))", "g"))
def report_table(spark, sf_dir):
    return reports.as_table(queue_counts(spark, sf_dir))


# ---- imports and cascades

_ITEMS = """, old AS (SELECT * FROM x WHERE known),
new AS (SELECT *, vec_id * 2 + 0 AS line_no, false AS again FROM x WHERE arriving UNION ALL SELECT *, vec_id * 2 + 1, true FROM x WHERE arriving_again)"""


def _items(own: DataFrame) -> DataFrame:
    base = own.select("*", F.lit(None).cast("long").alias("timezone_offset"), F.lit(None).cast("long").alias("creation_timestamp"), F.lit(True).alias("is_owned"), F.lit(None).cast("double").alias("duration"),
        F.lit(None).cast("string").alias("description_short"), F.lit(None).cast("boolean").alias("is_original_quality"))
    first = base.where("arriving").withColumn("line_no", F.col("vec_id") * 2)
    again = base.where("arriving_again").withColumn("line_no", F.col("vec_id") * 2 + 1).withColumn("is_favorite", ~F.col("is_favorite"))
    return first.unionByName(again).withColumn("thumb", F.concat(F.lit("new-"), F.coalesce("thumb", F.lit("none"))))


@query(
    with_sql(
        _ITEMS
        + """, latest AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY media_key ORDER BY line_no DESC) = 1)
SELECT coalesce(l.media_key, o.media_key) AS media_key, CASE WHEN l.media_key IS NOT NULL THEN 'new-' || coalesce(l.thumb, 'none') ELSE o.thumb END AS thumb,
    CASE WHEN l.media_key IS NOT NULL THEN l.is_favorite <> l.again ELSE o.is_favorite END AS is_favorite, coalesce(o.thumb_cached, false) AS thumb_cached, coalesce(o.embedded, false) AS embedded,
    coalesce(o.excluded, false) AS excluded, o.exclude_reason FROM latest l FULL JOIN old o ON l.media_key = o.media_key""",
        "x",
    ).replace("\n, old AS", ",\nold AS")
)
def census_upsert(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    items = _items(own)
    old = _items_as_photos(own)
    return upsert.upsert_photos(old, items).select("media_key", "thumb", "is_favorite", "thumb_cached", "embedded", "excluded", "exclude_reason")


def _items_as_photos(own: DataFrame) -> DataFrame:
    return own.where("known").select("*", F.lit(False).alias("preview_cached"), F.lit(None).cast("long").alias("timezone_offset"), F.lit(None).cast("long").alias("creation_timestamp"), F.lit(True).alias("is_owned"),
        F.lit(None).cast("double").alias("duration"), F.lit(None).cast("string").alias("description_short"), F.lit(None).cast("boolean").alias("is_original_quality"))


@query(
    with_sql(
        _ITEMS
        + """
SELECT count(*) AS total, count(*) FILTER (is_video) AS videos, count(*) FILTER (is_live_photo) AS live_photos, count(*) FILTER (is_favorite <> again) AS favorites,
    count(DISTINCT media_key) FILTER (media_key NOT IN (SELECT media_key FROM old)) AS inserted, count(*) - count(DISTINCT media_key) FILTER (media_key NOT IN (SELECT media_key FROM old)) AS updated FROM new""",
        "x",
    ).replace("\n, old AS", ",\nold AS")
)
def census_counters(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    return upsert.import_counters(own.where("known"), _items(own))


@query(
    with_sql(
        """SELECT x.media_key, CASE WHEN x.rescanned THEN x.vec_id % 3 = 0 ELSE c.corrupted END AS corrupted,
    CASE WHEN x.rescanned THEN CASE WHEN x.vec_id % 3 = 0 AND c.review_status IN ('kept', 'trash', 'skipped') THEN c.review_status ELSE 'pending' END ELSE c.review_status END AS review_status
    FROM x LEFT JOIN c ON x.media_key = c.media_key WHERE x.rescanned OR c.media_key IS NOT NULL""",
        "c",
    )
)
def flag_upsert_merge(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    flags = fixture.corrupt_flags(own).select("media_key", "corrupted", "review_status")
    verdicts = own.where("rescanned").select("media_key", (F.col("vec_id") % 3 == 0).alias("corrupted"))
    return upsert.upsert_flags(flags, verdicts, "corrupted", upsert.CORRUPT_FINAL)


@query(with_sql("SELECT x.media_key, x.thumb_cached OR x.blob_valid AS thumb_cached, x.blob_valid AS repaired FROM x", "x"))
def mark_cached(spark, sf_dir):
    own = fixture.photos(spark, sf_dir)
    valid = own.where("blob_valid").select("media_key")
    both = upsert.mark_cached(own, valid).select("media_key", "thumb_cached")
    return both.join(upsert.mark_cached(own, valid, repair=True).select("media_key", F.col("thumb_cached").alias("repaired")), "media_key")


@query(
    with_sql(
        """, left_ AS (SELECT group_id, media_key FROM m WHERE NOT excluded), cnt AS (SELECT group_id, count(*) AS n FROM left_ GROUP BY group_id HAVING count(*) >= 2)
SELECT g.group_id, CAST(cnt.n AS INT) AS size, CASE WHEN NOT x.excluded THEN g.proposed_keeper END AS proposed_keeper FROM g JOIN cnt ON g.group_id = cnt.group_id JOIN x ON x.media_key = g.proposed_keeper""",
        "g",
    ).replace("\n, left_ AS", ",\nleft_ AS")
)
def safety_cascade(spark, sf_dir):
    own, m, g, d = _library(spark, sf_dir)
    kept, _, _ = safety.cascade(own, g, m, d)
    return kept.select("group_id", "size", "proposed_keeper")


@query(with_sql("SELECT x.media_key, EXISTS (SELECT 1 FROM u WHERE u.media_key = x.media_key AND NOT u.restored) AS in_album FROM x", "u"))
def album_flag(spark, sf_dir):
    from ..sources.census import flag_album_members

    own = fixture.photos(spark, sf_dir)
    return flag_album_members(own, fixture.undo_log(own).where("not restored")).select("media_key", "in_album")


# ---- end to end


def flagship(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Exclusions, grouping, scores and the proposed keeper of each group, end to end."""
    own = fixture.photos(spark, sf_dir, cfg)
    found = grouping.build_groups(own, own.select("media_key", "vector"), cfg)
    features = own.select("media_key", *[(F.col("vec_id") * a % b / float(b)).alias(c) for c, a, b in (("sharpness", 37, 101), ("exposure", 53, 97), ("eyes", 29, 89), ("smile", 31, 83), ("aesthetic", 41, 79))], F.lit(640).alias("width"), F.lit(480).alias("height"))
    picked = scoring.pick_keepers(scoring.score_members(found.members, own, features, cfg))
    return picked.groupBy("group_id").agg(F.count("*").alias("size"), F.max(F.when(F.col("is_proposed_keeper"), F.col("media_key"))).alias("proposed_keeper"), F.round(F.max("total"), 6).alias("best_total"))


QUERIES["pipeline_groups"] = flagship

from . import intake  # noqa: E402  registers its queries here

ORACLES["pipeline_groups"] = intake.FLAGSHIP_SQL
