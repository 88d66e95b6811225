"""Image operators that need matrix algebra: perceptual hash and contrast stretch, for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LOW = 32, 8


def cosine_basis() -> np.ndarray:
    """The first LOW rows of the cosine transform of SIZE points."""
    k, x = np.arange(LOW)[:, None], np.arange(SIZE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIZE))


def perceptual_bits(images: np.ndarray) -> np.ndarray:
    """(n, SIZE, SIZE) to n 63-bit hashes: low frequencies without the constant, compared with their upper median, first one in the highest bit."""
    b = cosine_basis()
    low = np.einsum("kx,nxy,ly->nkl", b, images.astype(float), b).reshape(len(images), -1)[:, 1:]
    median = np.sort(low, axis=1)[:, low.shape[1] // 2]
    bits = (low >= median[:, None]).astype(np.int64)
    return (bits << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64)).sum(1)


def contrast(images: np.ndarray) -> np.ndarray:
    """Each matrix stretched to 0..255; a flat one stays as it is."""
    lo, hi = images.min((1, 2), keepdims=True).astype(float), images.max((1, 2), keepdims=True).astype(float)
    return np.where(hi > lo, (images - lo) / np.where(hi > lo, hi - lo, 1) * 255, images)


def perceptual_hashes(images: DataFrame, side: int = 8) -> DataFrame:
    """(id, p): images are (id bigint, px array of side * side numbers), enlarged by whole pixels to SIZE; others and nulls are left out."""

    def run(batches):
        for batch in batches:
            px = np.array(batch.column("px").to_pylist(), float).reshape(-1, side, side)
            if len(px):
                big = px.repeat(SIZE // side, 1).repeat(SIZE // side, 2)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(perceptual_bits(big))], ["id", "p"])

    whole = images.where((F.size("px") == side * side) & ~F.exists("px", lambda v: v.isNull()))
    return whole.select(F.col("id").cast("bigint").alias("id"), F.col("px").cast("array<double>").alias("px")).mapInArrow(run, "id bigint, p bigint")
