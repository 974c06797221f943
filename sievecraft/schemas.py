"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: dict[str, str]) -> T.StructType:
    kinds = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
        "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "floats": T.ArrayType(T.FloatType()),
    }
    return T.StructType([T.StructField(k, kinds[v]) for k, v in ddl.items()])


#: Columns that a catalogue line sets.
SOURCE_COLUMNS = {
    "media_key": "string", "dedup_key": "string", "timestamp": "long", "timezone_offset": "long", "creation_timestamp": "long", "thumb": "string",
    "res_width": "int", "res_height": "int", "is_favorite": "boolean", "is_archived": "boolean", "is_live_photo": "boolean", "is_owned": "boolean", "duration": "double",
    "description_short": "string", "space_taken": "long", "is_original_quality": "boolean", "in_album": "boolean", "file_name": "string",
}
#: Columns that the engine sets and an import keeps.
STATE_COLUMNS = {"thumb_cached": "boolean", "preview_cached": "boolean", "embedded": "boolean", "excluded": "boolean", "exclude_reason": "string"}

CENSUS_LINE = _schema(SOURCE_COLUMNS)
PHOTOS = _schema(SOURCE_COLUMNS | {"is_video": "boolean"} | STATE_COLUMNS)
EMBEDDINGS = _schema({"media_key": "string", "dim": "int", "vector": "floats"})
GROUPS = _schema({"group_id": "string", "size": "int", "proposed_keeper": "string", "status": "string", "override_keeper": "string", "reviewed_at": "string"})
GROUP_MEMBERS = _schema(
    {"group_id": "string", "media_key": "string", "score": "double", "sharpness": "double", "exposure": "double", "eyes": "double", "smile": "double", "aesthetic": "double", "resolution": "double", "is_proposed_keeper": "boolean"}
)
DECISIONS = _schema({"group_id": "string", "keep_media_key": "string", "trash_dedup_keys": "strings", "decided_at": "string", "applied": "boolean", "applied_at": "string"})
UNDO_LOG = _schema({"id": "long", "run_id": "string", "dedup_key": "string", "media_key": "string", "trashed_at": "string", "restored": "boolean"})
META = _schema({"key": "string", "value": "string"})
CORRUPT_FLAGS = _schema({"media_key": "string", "corrupted": "boolean", "reasons": "strings", "fill_fraction": "double", "fill_color": "ints", "scanned_at": "string", "review_status": "string"})
TEXT_FLAGS = _schema({"media_key": "string", "is_text": "boolean", "reasons": "strings", "line_count": "int", "coverage": "double", "ink_fraction": "double", "scanned_at": "string", "review_status": "string"})

TABLES = {
    "photos": PHOTOS, "embeddings": EMBEDDINGS, "groups": GROUPS, "group_members": GROUP_MEMBERS, "decisions": DECISIONS,
    "undo_log": UNDO_LOG, "meta": META, "corrupt_flags": CORRUPT_FLAGS, "text_flags": TEXT_FLAGS,
}
