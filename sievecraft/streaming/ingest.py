"""Incremental catalogue imports: files that arrive in a folder are upserted batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.safety import apply_exclusions
from ..operators.upsert import upsert_meta, upsert_photos
from ..plans.store import SnapshotStore
from ..sources.census import parse_lines


def import_batch(store: SnapshotStore, lines: DataFrame) -> None:
    """One batch of (line_no, line) rows into photos and meta. A batch that runs again leaves the same tables."""
    census = parse_lines(lines)
    photos = apply_exclusions(upsert_photos(store.read("photos"), census.items))
    store.commit(photos=photos, meta=upsert_meta(store.read("meta"), census.meta))


def stream_census(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, max_files: int = 16) -> StreamingQuery:
    """Import each file once; stops when no new file is there, and resumes from the checkpoint."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    named = lines.select(F.trim("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).alias("_from")).where("line != ''")

    def each(batch: DataFrame, _: int) -> None:
        ordered = batch.withColumn("line_no", F.struct("_from", F.monotonically_increasing_id().alias("at"))).select("line_no", "line")
        import_batch(store, ordered)

    return named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_arrivals(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arrivals per window and kind, with a watermark for late rows; the same plan in a batch."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def burst_sessions(events: DataFrame, gap_s: int = 120) -> DataFrame:
    """(user_id, bursts, shots): running counts of shots and of bursts, a burst ending after ``gap_s`` without a shot.

    Custom state per key: the last time, the bursts and the shots so far. Rows of a batch are taken in time order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, bursts, shots = state.get if state.exists else (None, 0, 0)
        times = sorted(t for b in batches for t in b["t"].tolist())
        for t in times:
            bursts += last is None or t - last > gap_s
            last, shots = t if last is None else max(t, last), shots + 1
        state.update((last, bursts, shots))
        yield pd.DataFrame({"user_id": [key[0]], "bursts": [bursts], "shots": [shots]})

    keyed = events.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return keyed.groupBy("user_id").applyInPandasWithState(run, "user_id long, bursts long, shots long", "last long, bursts long, shots long", "update", GroupStateTimeout.NoTimeout)
