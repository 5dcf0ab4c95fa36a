"""Decoded images to vectors inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def area_resize(img: np.ndarray, size: int) -> np.ndarray:
    """Resize (h, w, c) to (size, size, c) by the mean over the covered area."""

    def overlap(n: int) -> np.ndarray:
        edges = np.linspace(0.0, n, size + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n))
        cover = np.clip(cover, 0.0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return np.einsum("ah,hwc,bw->abc", overlap(img.shape[0]), img, overlap(img.shape[1]), optimize=True)


def image_vectors(
    images: DataFrame, size: int = 64, patch: int | None = 8, flip: bool = False, epoch: int = 1, seed: int = 42
) -> DataFrame:
    """Adds ``features``: RGB in [0, 1], resized, as pixels or as means of patch x patch blocks.

    The vector is in (c, y, x) order, NULL for a row without a decoded image. ``flip`` draws the two flips of each image from a
    hash of seed, epoch and file name, so retries and other partitions give the same image.
    """
    keep = [c for c in images.columns if c not in ("height", "width", "channels", "data")]
    bits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("file")))
    bits = (F.conv(F.substring(bits, 1, 8), 16, 10).cast("bigint") % 4).cast("int")
    rows = images.withColumn("_bits", bits if flip else F.lit(0))
    schema = images.select(*keep).schema.add("features", T.ArrayType(T.DoubleType()))

    def vector(h, w, c, data, bits):
        if h is None or data is None:
            return None
        img = np.frombuffer(data, np.uint8).reshape(h, w, c)
        img = img[:, :, :3][:, :, ::-1] if c >= 3 else np.repeat(img[:, :, :1], 3, axis=2)
        if bits & 1:
            img = img[:, ::-1]
        if bits & 2:
            img = img[::-1]
        out = area_resize(img.astype(np.float64) / 255.0, size)
        if patch:
            n = size // patch
            out = out.reshape(n, patch, n, patch, 3).mean(axis=(1, 3))
        return out.transpose(2, 0, 1).ravel()

    def run(batches):
        for b in batches:
            fields = [b.column(n).to_pylist() for n in ("height", "width", "channels", "data", "_bits")]
            vectors = [vector(*row) for row in zip(*fields, strict=True)]
            cols = [b.column(n) for n in keep] + [pa.array(vectors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "features"])

    return rows.mapInArrow(run, schema)
