"""Embedding of pending photos with a model that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.image_bytes import describe_head
from ..sources.files import to_rgb
from .reports import ready_to_embed

#: A batch of RGB images -> one vector each. MemoryError asks for a smaller batch.
Encoder = Callable[[list[np.ndarray]], np.ndarray]


def pending(photos: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Photos to embed: cached, neither video nor excluded, and without a vector. A rerun resumes where it stopped."""
    return photos.where(ready_to_embed()).join(embeddings.select("media_key"), "media_key", "left_anti")


#: Pending photos whose files are looked at before a model is made, and how many of them may be no images.
SAMPLE, MOST_BAD = 50, 24


class InvalidThumbs(ValueError):
    """Too many of the first pending photos have no image behind them: fetching them anew comes before embedding."""


def first_pending(todo: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The ``n`` oldest pending photos; those without a time come first, ties go by key."""
    return todo.orderBy(F.col("timestamp").asc_nulls_first(), "media_key").limit(n)


def bad_thumbs(some: DataFrame, blobs: DataFrame) -> DataFrame:
    """(media_key, found) of the given photos whose file isn't an image: what it is instead, or "missing"."""
    seen = blobs.select(F.col("media_key").alias("_k"), describe_head(F.col("content")).alias("found"))
    joined = some.join(seen, F.col("media_key") == F.col("_k"), "left")
    return joined.select("media_key", F.coalesce("found", F.lit("missing")).alias("found")).where("found != 'image'")


def encode(batch: list[np.ndarray], encoder: Encoder) -> np.ndarray:
    """Unit vectors; a batch that doesn't fit into memory is halved."""
    try:
        x = np.asarray(encoder(batch), dtype=np.float32)
    except MemoryError:
        if len(batch) == 1:
            raise
        half = len(batch) // 2
        return np.concatenate([encode(batch[:half], encoder), encode(batch[half:], encoder)])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def embed(images: DataFrame, make_encoder: Callable[[], Encoder], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(media_key, dim, vector) of (media_key, width, height, channels, bgr) rows. The model is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for b in batches:
            for start in range(0, len(b), cfg.embed_batch):
                part = b.iloc[start : start + cfg.embed_batch]
                x = encode([to_rgb(d, w, h, c) for d, w, h, c in zip(part["bgr"], part["width"], part["height"], part["channels"], strict=True)], encoder)
                yield pd.DataFrame({"media_key": part["media_key"].to_numpy(), "dim": np.int32(x.shape[1]), "vector": list(x)})

    return images.where(F.col("bgr").isNotNull()).select("media_key", "width", "height", "channels", "bgr").mapInPandas(run, "media_key string, dim int, vector array<float>")


def pack(vector: np.ndarray) -> bytes:
    """A vector as little-endian float32 bytes."""
    return np.asarray(vector, dtype="<f4").tobytes()


def unpack(vectors: DataFrame, blob: str = "vector") -> DataFrame:
    """(media_key, dim, vector) from rows whose vector is float32 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.frombuffer(v, dtype="<f4") for v in b[blob]]
            yield pd.DataFrame({"media_key": b["media_key"], "dim": [len(v) for v in x], "vector": x}).astype({"dim": "int32"})

    return vectors.select("media_key", blob).mapInPandas(run, "media_key string, dim int, vector array<float>")
