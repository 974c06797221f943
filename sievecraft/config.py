"""Parameters of the engine. Every threshold is a field, and every operator takes the whole set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    # sizes of cached images, in pixels
    thumb_px: int = 256
    preview_px: int = 1600
    full_px: int = 4096
    # fetching
    fetch_concurrency: int = 16
    fetch_retries: int = 4
    fetch_timeout_s: float = 30.0
    auth_failure_limit: int = 8
    # embedding
    embed_batch: int = 32
    checkpoint_every: int = 64
    # grouping
    time_window_s: int = 120
    time_cosine: float = 0.88
    global_cosine: float = 0.94
    topk: int = 20
    min_group_size: int = 2
    # keeper score
    weight_sharpness: float = 0.35
    weight_exposure: float = 0.15
    weight_eyes: float = 0.25
    weight_smile: float = 0.10
    weight_aesthetic: float = 0.10
    weight_resolution: float = 0.05
    # exclusion rules
    exclude_favorites: bool = True
    exclude_album_members: bool = False
    exclude_videos: bool = True
    exclude_live_photos: bool = True
    # classifiers
    min_fill: float = 0.12
    decoder_fill_min: float = 0.08
    text_min_lines: int = 8
    text_min_coverage: float = 0.08
    text_ink_min: float = 0.025
    text_ink_max: float = 0.55
    # physical limits: bytes of vectors that may be broadcast, rows of a block beyond it
    broadcast_vector_bytes: int = 64 << 20
    vector_block_rows: int = 8192

    @classmethod
    def from_env(cls, prefix: str = "SIEVECRAFT_") -> EngineConfig:
        """Defaults overridden by environment variables named after the fields."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return replace(cls(), **found)

    @property
    def weights(self) -> dict[str, float]:
        return {k: getattr(self, f"weight_{k}") for k in ("sharpness", "exposure", "eyes", "smile", "aesthetic", "resolution")}
