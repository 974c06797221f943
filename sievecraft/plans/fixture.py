"""A photo library derived from the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.safety import apply_exclusions

#: Thresholds that give groups on these vectors.
CONFIG = EngineConfig(time_window_s=3600, time_cosine=0.35, global_cosine=0.45, topk=20)

# The same expressions serve Spark and DuckDB, so that both sides start from equal rows.
_PHOTO_COLUMNS = """
    e.vec_id AS vec_id,
    concat('mk', lpad(CAST(e.vec_id AS STRING), 8, '0')) AS media_key,
    concat('dk', CAST(e.vec_id % 400 AS STRING)) AS dedup_key,
    CASE WHEN e.vec_id % 17 = 0 THEN NULL WHEN e.vec_id % 3 = 0 THEN {epoch} * 1000 ELSE {epoch} END AS timestamp,
    v.event_type = 'purchase' AS is_favorite,
    v.event_type = 'signup' AS in_album,
    v.event_type = 'error' AS is_video,
    v.event_type = 'view' AND e.vec_id % 5 = 0 AS is_live_photo,
    e.vec_id % 7 = 0 AS is_archived,
    CASE WHEN e.vec_id % 23 = 0 THEN NULL ELSE CAST(round(v.value * 1000) AS BIGINT) END AS space_taken,
    CASE WHEN e.vec_id % 11 = 0 THEN NULL WHEN e.vec_id % 11 = 1 THEN '' ELSE concat('https://img.example.net/p', CAST(e.vec_id AS STRING), '=w100-h100-no?x=1') END AS thumb,
    CAST(e.vec_id % 13 * 400 AS INT) AS res_width,
    CASE WHEN e.vec_id % 19 = 0 THEN NULL ELSE CAST(e.vec_id % 9 * 300 AS INT) END AS res_height,
    concat('IMG ', CAST(e.vec_id AS STRING), '/ä*.jpg') AS file_name,
    e.vec_id % 4 <> 0 AS thumb_cached,
    e.vec_id % 6 <> 0 AS embedded,
    e.vec_id % 6 <> 5 AS vectorised,
    e.vec_id % 3 <> 0 AS known,
    e.vec_id % 2 = 0 AS arriving,
    e.vec_id % 10 = 0 AS arriving_again,
    e.vec_id % 4 < 2 AS rescanned,
    e.vec_id % 16 = 4 AS blob_valid,
    e.embedding AS vector,
    v.props AS props"""

PHOTOS_SQL = f"""SELECT {_PHOTO_COLUMNS.replace("STRING", "VARCHAR").format(epoch="CAST(floor(epoch(v.ts)) AS BIGINT)")}
    FROM embeddings e JOIN events v ON e.vec_id = v.event_id"""

#: Groups, decisions and flags that follow from a photo's number.
_MEMBER_COLUMNS = """concat('g', lpad(CAST(vec_id % 60 AS STRING), 3, '0')) AS group_id, media_key, dedup_key, is_favorite, in_album, excluded, vec_id,
    vec_id * 37 % 101 / 100.0D0 AS sharpness, vec_id * 53 % 97 / 96.0D0 AS exposure, vec_id * 29 % 89 / 88.0D0 AS eyes, vec_id * 31 % 83 / 82.0D0 AS smile, vec_id * 41 % 79 / 78.0D0 AS aesthetic,
    res_width, res_height"""


def with_sql(body: str, *parts: str) -> str:
    """A query over the named parts of the fixture."""
    known = {
        "p": PHOTOS_SQL,
        "x": """SELECT *, nullif(concat_ws(',', CASE WHEN is_favorite THEN 'favorite' END, CASE WHEN is_video THEN 'video' END, CASE WHEN is_live_photo THEN 'live_photo' END), '') AS exclude_reason,
            is_favorite OR is_video OR is_live_photo AS excluded FROM p""",
        "m": f"SELECT {_MEMBER_COLUMNS.replace('STRING', 'VARCHAR').replace('D0', '::DOUBLE')} FROM x",
        "g": """SELECT group_id, CAST(count(*) AS INT) AS size, min(media_key) AS proposed_keeper,
            CASE min(vec_id % 60) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'overridden' WHEN 3 THEN 'skipped' END AS status, CAST(min(vec_id % 60) AS BIGINT) AS n FROM m GROUP BY group_id""",
        "d": """SELECT m.group_id, min(g.proposed_keeper) AS keep_media_key, list(m.dedup_key ORDER BY m.media_key) FILTER (m.media_key <> g.proposed_keeper AND (NOT m.is_favorite OR m.vec_id % 120 = 1)) AS trash_dedup_keys,
            min(g.n) % 10 = 2 AS applied FROM m JOIN g ON m.group_id = g.group_id WHERE g.status IN ('accepted', 'overridden') GROUP BY m.group_id""",
        "c": """SELECT media_key, vec_id % 20 = 3 AS corrupted, CASE WHEN vec_id % 30 = 3 THEN 'trash' WHEN vec_id % 30 = 13 THEN 'kept' WHEN vec_id % 4 = 3 THEN NULL ELSE 'pending' END AS review_status,
            CASE vec_id % 5 WHEN 0 THEN '["truncated_jpeg","decoder_fill"]' WHEN 1 THEN 'not json' WHEN 2 THEN NULL WHEN 3 THEN '[]' ELSE '' END AS reasons, CASE WHEN vec_id % 2 = 0 THEN '128,127,129' END AS fill_color
            FROM x""",
        "t": "SELECT media_key, vec_id % 3 = 0 AS is_text FROM x",
        "u": """SELECT vec_id AS id, concat('run-', CAST(vec_id * 7 % 5 AS VARCHAR)) AS run_id, dedup_key, media_key, concat('2024-01-0', CAST(1 + vec_id % 9 AS VARCHAR)) AS trashed_at, vec_id % 4 = 0 AS restored FROM x""",
    }
    needs = {"x": "p", "m": "x", "g": "m", "d": "g", "c": "x", "t": "x", "u": "x"}
    wanted: list[str] = []

    def add(k: str) -> None:
        if k in needs:
            add(needs[k])
        if k not in wanted:
            wanted.append(k)

    for k in parts:
        add(k)
    return "WITH " + ",\n".join(f"{k} AS ({known[k]})" for k in wanted) + "\n" + body


def photos(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CONFIG) -> DataFrame:
    """Photos with their vectors, excluded by the rules."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").alias("e")
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value", "props").alias("v")
    epoch = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', v.ts)"
    columns = [c.strip().rstrip(",") for c in _PHOTO_COLUMNS.format(epoch=epoch).strip().split("\n")]
    return apply_exclusions(e.join(v, F.col("e.vec_id") == F.col("v.event_id")).selectExpr(*columns), cfg)


def members(own: DataFrame) -> DataFrame:
    return own.selectExpr(*_rejoin([c.strip() for c in _MEMBER_COLUMNS.replace("D0", "D").split(",")]))


def _rejoin(columns: list[str]) -> list[str]:
    """Split a select list at its top-level commas only."""
    out, depth = [], 0
    for c in columns:
        if depth:
            out[-1] += ", " + c
        else:
            out.append(c)
        depth += c.count("(") - c.count(")")
    return out


def groups(member_rows: DataFrame) -> DataFrame:
    n = F.min(F.col("vec_id") % 60)
    status = F.when(n % 5 == 0, "pending").when(n % 5 == 1, "accepted").when(n % 5 == 2, "overridden").when(n % 5 == 3, "skipped")
    return member_rows.groupBy("group_id").agg(F.count("*").cast("int").alias("size"), F.min("media_key").alias("proposed_keeper"), status.alias("status"), n.alias("n"))


def decisions(member_rows: DataFrame, group_rows: DataFrame) -> DataFrame:
    own = member_rows.join(group_rows.where("status in ('accepted', 'overridden')").select("group_id", "proposed_keeper", "n"), "group_id")
    loose = (F.col("media_key") != F.col("proposed_keeper")) & (~F.col("is_favorite") | (F.col("vec_id") % 120 == 1))
    trash = F.transform(F.sort_array(F.collect_list(F.when(loose, F.struct("media_key", "dedup_key")))), lambda x: x["dedup_key"])
    return own.groupBy("group_id").agg(F.min("proposed_keeper").alias("keep_media_key"), trash.alias("trash_dedup_keys"), (F.min("n") % 10 == 2).alias("applied"), F.lit(None).cast("string").alias("applied_at"))


def corrupt_flags(own: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    status = F.when(v % 30 == 3, "trash").when(v % 30 == 13, "kept").when(v % 4 == 3, None).otherwise("pending")
    reasons = F.when(v % 5 == 0, '["truncated_jpeg","decoder_fill"]').when(v % 5 == 1, "not json").when(v % 5 == 2, None).when(v % 5 == 3, "[]").otherwise("")
    return own.select("media_key", (v % 20 == 3).alias("corrupted"), status.alias("review_status"), reasons.alias("reasons"), F.when(v % 2 == 0, "128,127,129").alias("fill_color"))


def text_flags(own: DataFrame) -> DataFrame:
    return own.select("media_key", (F.col("vec_id") % 3 == 0).alias("is_text"))


def undo_log(own: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return own.select(
        v.alias("id"), F.concat(F.lit("run-"), (v * 7 % 5).cast("string")).alias("run_id"), "dedup_key", "media_key", F.concat(F.lit("2024-01-0"), (1 + v % 9).cast("string")).alias("trashed_at"), (v % 4 == 0).alias("restored")
    )
