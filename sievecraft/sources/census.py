"""The catalogue source: line-delimited JSON with quota, meta and item records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_video
from ..schemas import CENSUS_LINE

#: Defaults of an item's flags.
_FLAGS = {"is_favorite": False, "is_archived": False, "is_live_photo": False, "in_album": False, "is_owned": True}


@dataclass
class Census:
    #: typed items with ``line_no``, ascending in file order
    items: DataFrame
    #: (key, value, line_no) of quota and meta records
    meta: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) without blank lines. The number rises with the position, within a file and over sorted files."""
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("line"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return lines.where("line != ''").select(F.struct("_file", "_at").alias("line_no"), "line")


# How a flag may be written.
_TRUE, _FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def coerced(text: Column, kind: str) -> Column:
    """A JSON value's text as a typed value, null if it isn't one: whole numbers and flags may be written as strings."""
    if kind == "boolean":
        return F.when(F.lower(text).isin(*_TRUE), True).when(F.lower(text).isin(*_FALSE), False)
    if kind == "string":
        return text
    real = text.try_cast("double")
    if kind == "double":
        return real
    return F.coalesce(text.try_cast(kind), F.when((real == F.floor(real)) & (F.abs(real) < 2.0**31 if kind == "int" else F.abs(real) < 2.0**53), real.cast(kind)))


def parse_lines(lines: DataFrame) -> Census:
    """Dispatch on ``_type``. A line that is no JSON, an item without its keys, or with a value that can't be read as its
    column's type, fails the query: nothing is imported."""
    kind = F.get_json_object("line", "$._type")
    typed = lines.withColumn("_type", F.coalesce(kind, F.lit("item")))
    loose = T.StructType([T.StructField(f.name, T.StringType()) for f in CENSUS_LINE])
    item = F.from_json("line", loose, {"mode": "FAILFAST"})
    items = typed.where(~F.col("_type").isin("quota", "meta")).withColumn("item", item)
    value = {f.name: coerced(F.col(f"item.{f.name}"), f.dataType.simpleString()) for f in CENSUS_LINE}
    bad = F.col("item").isNull() | F.col("item.media_key").isNull() | F.col("item.dedup_key").isNull()
    for name, x in value.items():
        bad = bad | (F.col(f"item.{name}").isNotNull() & x.isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a valid catalogue line: "), F.substring("line", 1, 120)))).otherwise(F.struct(*[x.alias(name) for name, x in value.items()]))
    items = items.withColumn("item", checked).select("line_no", "item.*")
    items = items.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in _FLAGS.items()}).withColumn("is_video", is_video(F.col("duration"), F.col("is_live_photo")))
    quota = typed.where("_type = 'quota'").select(F.lit("quota_baseline").alias("key"), F.col("line").alias("value"), "line_no")
    pairs = typed.where("_type = 'meta'").select(F.explode(F.from_json("line", "map<string,string>")).alias("key", "value"), "line_no")
    meta = pairs.where("key != '_type'").select("key", F.coalesce("value", F.lit("None")).alias("value"), "line_no")
    return Census(items, quota.unionByName(meta))


def read_census(spark: SparkSession, path: str) -> Census:
    return parse_lines(read_lines(spark, path))


def flag_album_members(items: DataFrame, members: DataFrame) -> DataFrame:
    """Set ``in_album`` for keys of an album's member list."""
    known = members.select(F.col("media_key").alias("_k")).distinct()
    return items.join(known, F.col("media_key") == F.col("_k"), "left").withColumn("in_album", F.col("_k").isNotNull()).drop("_k")
