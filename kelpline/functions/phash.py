"""64-bit perceptual hashes of decoded images: signs of low DCT frequencies against their median."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, KEPT = 32, 8


def _kernel(n: int, side: int, lobes: int = 3) -> np.ndarray:
    """Weights (side x n) of a Lanczos resampling, in steps of 2 ** -22; when an image shrinks the
    kernel is stretched to take in all pixels."""
    scale = max(n / side, 1.0)
    centre = (np.arange(side) + 0.5) * n / side
    low = np.maximum((centre - lobes * scale + 0.5).astype(int), 0)[:, None]
    high = np.minimum((centre + lobes * scale + 0.5).astype(int), n)[:, None]
    at = np.arange(n)[None, :]
    x = (at - centre[:, None] + 0.5) / scale
    w = np.where((at >= low) & (at < high) & (np.abs(x) < lobes), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return np.round(w / w.sum(1, keepdims=True) * (1 << 22)).astype(np.int64)


def _resized(gray: np.ndarray, side: int) -> np.ndarray:
    """Of whole numbers from 0 to 255: first the columns, then the rows, each rounded to whole numbers."""
    gray = np.clip((gray.astype(np.int64) @ _kernel(gray.shape[1], side).T + (1 << 21)) >> 22, 0, 255)
    return np.clip((_kernel(gray.shape[0], side) @ gray + (1 << 21)) >> 22, 0, 255)


def phash(width: int, height: int, channels: int, data: bytes) -> int | None:
    """As a signed number; null for images that couldn't be decoded. Bytes are blue, green, red."""
    if width <= 0 or height <= 0 or len(data) < width * height * channels:
        return None
    pixels = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels).astype(np.int64)
    # luma in 16-bit fixed point
    gray = pixels[:, :, 0] if channels < 3 else (pixels[:, :, 2] * 19595 + pixels[:, :, 1] * 38470 + pixels[:, :, 0] * 7471 + (1 << 15)) >> 16
    k = np.arange(SIDE)
    dct = np.cos(np.pi / SIDE * (k[None, :] + 0.5) * k[:KEPT, None])
    low = dct @ _resized(gray, SIDE) @ dct.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def with_phash(images: DataFrame, image: str = "image", out: str = "phash") -> DataFrame:
    """``images`` with the hash of a column of the image source. Arrow batches; the pixels stay on
    the executors."""

    @F.pandas_udf("long")
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for f in frames:
            yield pd.Series([phash(w, h, c, d) for w, h, c, d in zip(f["width"], f["height"], f["nChannels"], f["data"], strict=True)], dtype="Int64")

    fields: Column = F.struct(*[F.col(f"{image}.{c}").alias(c) for c in ("width", "height", "nChannels", "data")])
    return images.withColumn(out, hashed(fields))
