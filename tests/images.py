"""Synthetic images and their files."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg(spark, rgb: np.ndarray, folder: Path) -> bytes:
    """Encoded by the JVM."""
    a, b = folder / "x.png", folder / "x.jpg"
    a.write_bytes(png(rgb))
    jvm = spark._jvm
    jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(a))), "jpg", jvm.java.io.File(str(b)))
    out = b.read_bytes()
    a.unlink(), b.unlink()
    return out


def content() -> np.ndarray:
    """Diagonal stripes over a ramp, and a ring."""
    y, x = np.indices((192, 256))
    stripe, ring = ((x + y) // 7 % 3 == 0)[..., None], (abs(np.hypot(x - 150, y - 70) - 40) < 6)[..., None]
    ramp = np.stack([40 + x // 4, 150 - y // 2, 90 + (x + y) // 8], axis=-1)
    return np.where(ring, (230, 210, 70), np.where(stripe, (180, 60, 75), ramp)).astype(np.uint8)


def sky() -> np.ndarray:
    x = np.random.default_rng(1).integers(0, 255, (96, 128, 3)).astype(np.uint8)
    x[:48] = (150, 190, 240)
    return x


def page() -> np.ndarray:
    x = np.full((320, 256, 3), (245, 240, 228), dtype=np.uint8)
    for y in range(20, 300, 14):
        x[y : y + 7, 24:230] = (40, 40, 45)
    return x


def landscape() -> np.ndarray:
    x = np.zeros((240, 320, 3), dtype=np.uint8)
    x[:120], x[120:170], x[170:] = (110, 170, 230), (60, 110, 50), (120, 90, 60)
    return x


def gradient() -> np.ndarray:
    base = np.linspace(60, 200, 240)[:, None] + np.random.default_rng(2).normal(0, 12, (240, 320))
    return np.clip(np.stack([base, base * 0.95, base * 0.9], axis=-1), 0, 255).astype(np.uint8)


def sunset() -> np.ndarray:
    x = np.zeros((240, 320, 3), dtype=np.uint8)
    for k, c in enumerate([(250, 120, 40), (230, 80, 60), (140, 50, 90), (40, 20, 60)]):
        x[60 * k : 60 * k + 60] = c
    return x


def truncated(data: bytes, share: float) -> bytes:
    return data[: int(len(data) * share)] + b"\0" * 64 + b"\xff\xd9"
