"""Image operators on arrays: ``(img, c, h, w, v)``, one image or tile a row, ``v`` in (channel, row, column) order.

Whole images are worked on where they lie, a batch of equal shapes at a time: no exchange, and no row per pixel. Images too
large for a row are cut into tiles with a halo of their neighbours' pixels (`cut`, one exchange); what an operator needs of
a neighbour is in the halo, so tiles are then worked on like images and nothing is exchanged again.

The functions on arrays take and return ``[image, channel, row, column]``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.operators.blocks import as_lists, as_matrix

Operator = Callable[[np.ndarray], np.ndarray]


# --- on arrays ------------------------------------------------------------------------------


def blocks(a: np.ndarray, k: int) -> np.ndarray:
    """Every k x k block as an axis of its own, [n, c, rows, columns, k * k]; a block at the edge is filled with NaN."""
    n, c, h, w = a.shape
    rows, cols = -(-h // k), -(-w // k)
    full = np.full((n, c, rows * k, cols * k), np.nan)
    full[:, :, :h, :w] = a
    return full.reshape(n, c, rows, k, cols, k).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, rows, cols, k * k)


def max_pool(a: np.ndarray, k: int) -> np.ndarray:
    return np.nanmax(blocks(a, k), axis=4)


def mean_pool(a: np.ndarray, k: int) -> np.ndarray:
    return np.nanmean(blocks(a, k), axis=4)


def resize_nearest(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    rows, cols = (np.arange(new) * old // new for new, old in zip(size, a.shape[2:], strict=True))
    return a[:, :, rows[:, None], cols[None, :]]


def focal(a: np.ndarray, kernel: list[tuple], stride: int = 1, bias: list[float] | None = None, halo: int = 0) -> np.ndarray:
    """Weighted sums of neighbours, zero outside: output (oy, ox) adds the pixel at (oy * stride + dy, ox * stride + dx).

    ``kernel`` lists ``(dy, dx, c_in, c_out, weight)``. With ``halo``, that many pixels on every side are neighbours only.
    """
    n, _, h, w = a.shape
    h, w = h - 2 * halo, w - 2 * halo
    rows, cols = -(-h // stride), -(-w // stride)
    made = sorted({t[3] for t in kernel} | set(range(len(bias or []))))
    out = np.zeros((n, max(made) + 1, rows, cols))
    reach = max((max(abs(t[0]), abs(t[1])) for t in kernel), default=0) + stride
    padded = np.pad(a, ((0, 0), (0, 0), (reach, reach), (reach, reach)))
    for dy, dx, c_in, c_out, weight in kernel:
        if c_in >= a.shape[1]:
            continue
        y, x = reach + halo + dy, reach + halo + dx
        out[:, c_out] += weight * padded[:, c_in, y : y + rows * stride : stride, x : x + cols * stride : stride]
    if bias is not None:
        out += np.array(bias)[None, :, None, None]
    return out


def gates(a: np.ndarray, k: int, weight: float = 1.0, bias: float = 0.0) -> np.ndarray:
    """A gate in (0, 1) for each channel of each k x k patch, by its mean, painted on the patch's pixels."""
    gate = 1.0 / (1.0 + np.exp(-(mean_pool(a, k) * weight + bias)))
    return gate.repeat(k, axis=2).repeat(k, axis=3)[:, :, : a.shape[2], : a.shape[3]]


# --- on tables ------------------------------------------------------------------------------


def images(df: DataFrame, img: str, values: Column, shape: tuple[int, int, int]) -> DataFrame:
    """Rows whose ``values`` are an image of ``shape`` (channels, rows, columns)."""
    sizes = [F.lit(n).alias(name) for name, n in zip(("c", "h", "w"), shape, strict=True)]
    return df.select(F.col(img).alias("img"), *sizes, values.cast("array<double>").alias("v"))


def apply(df: DataFrame, operator: Operator, into: str = "v") -> DataFrame:
    """``operator`` on every image; a NULL image stays NULL. ``into``: the column of the result; another one than v
    keeps the image beside it and wants a result of its shape."""
    names = df.columns
    out = names if into == "v" else [*names, into]

    def run(batches):
        for batch in batches:
            shapes = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in ("c", "h", "w")], axis=1)
            there = np.asarray(batch.column("v").is_valid())
            if not there.all():
                rest = batch.filter(pa.array(~there))
                columns = list(rest.columns) + ([] if into == "v" else [pa.nulls(rest.num_rows, pa.list_(pa.float64()))])
                yield pa.RecordBatch.from_arrays(columns, out)
            for shape in np.unique(shapes[there], axis=0):
                at = np.flatnonzero((shapes == shape).all(axis=1) & there)
                rows = batch.take(pa.array(at))
                a = as_matrix(rows.column("v"), int(shape.prod())).reshape(len(at), *shape)
                made = operator(a)
                flat = as_lists(made.reshape(len(at), -1))
                if into != "v":
                    if made.shape != a.shape:
                        raise ValueError(f"a result of shape {made.shape[1:]} beside an image of {a.shape[1:]}")
                    yield pa.RecordBatch.from_arrays([*rows.columns, flat], out)
                    continue
                new = dict(zip(("c", "h", "w"), made.shape[1:], strict=True))
                columns = {s: pa.array(np.full(len(at), n, np.int32)) for s, n in new.items()} | {"v": flat}
                yield pa.RecordBatch.from_arrays([columns.get(n, rows.column(n)) for n in names], names)

    kinds = dict(df.dtypes) | {into: "array<double>"}
    return df.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in out))


def flip(df: DataFrame, bits: Column) -> DataFrame:
    """Mirrored by the bits of a number: 1 left to right, 2 top to bottom."""
    place = F.sequence(F.lit(0), F.col("c") * F.col("h") * F.col("w") - 1)

    def source(i: Column) -> Column:
        x, y, c = i % F.col("w"), F.floor(i / F.col("w")) % F.col("h"), F.floor(i / (F.col("w") * F.col("h")))
        x = F.when(bits % 2 == 1, F.col("w") - 1 - x).otherwise(x)
        y = F.when(bits >= 2, F.col("h") - 1 - y).otherwise(y)
        return F.get("v", ((c * F.col("h") + y) * F.col("w") + x).cast("int"))

    return df.withColumn("v", F.transform(place, source))


def pixels(df: DataFrame, columns: tuple[str, ...] = ("v",), origin: tuple[str, str] | None = None) -> DataFrame:
    """``(img, y, x, c, ...)``: a row for each pixel; ``origin``: columns of a tile's first row and column."""
    lists = F.arrays_zip(*columns)
    rows = df.select("img", "h", "w", *(origin or ()), F.posexplode(lists).alias("i", "p"))
    y, x = F.floor(F.col("i") / F.col("w")) % F.col("h"), F.col("i") % F.col("w")
    if origin:
        y, x = y + F.col(origin[0]), x + F.col(origin[1])
    channel = F.floor(F.col("i") / (F.col("w") * F.col("h")))
    return rows.select(
        "img", y.cast("int").alias("y"), x.cast("int").alias("x"), channel.cast("int").alias("c"), *[F.col("p")[n].alias(n) for n in columns]
    )


def cut(px: DataFrame, size: tuple[int, int], channels: int, tile: int, halo: int) -> DataFrame:
    """Pixel rows ``(img, y, x, c, v)`` as tiles: ``(img, c, h, w, v, y0, x0)``, v with ``halo`` more pixels on every side.

    A pixel goes to the tiles whose halo it is in; a tile has at most (tile + 2 halo)^2 pixels of a channel, so this is
    the one exchange and no task holds an image. Pixels that are missing or outside the image are 0.
    """

    def owners(column: str, n: int) -> Column:
        last = (n - 1) // tile
        first = F.greatest(F.lit(0), F.floor((F.col(column) - halo) / tile))
        return F.sequence(first.cast("int"), F.least(F.lit(last), F.floor((F.col(column) + halo) / tile)).cast("int"))

    sent = px.withColumn("ty", F.explode(owners("y", size[0]))).withColumn("tx", F.explode(owners("x", size[1])))
    held = sent.groupBy("img", "ty", "tx").agg(F.collect_list(F.struct("c", "y", "x", "v")).alias("p"))
    kind = dict(px.dtypes)["img"]
    names = ["img", "c", "h", "w", "v", "y0", "x0"]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ty, tx = (batch.column(c)[r].as_py() for c in ("ty", "tx"))
                p = batch.column("p").slice(r, 1).flatten()
                c, y, x, v = (p.field(n).to_numpy(zero_copy_only=False) for n in ("c", "y", "x", "v"))
                h, w = min(tile, size[0] - ty * tile), min(tile, size[1] - tx * tile)
                a = np.zeros((channels, h + 2 * halo, w + 2 * halo))
                inside = (y - ty * tile < h + halo) & (x - tx * tile < w + halo)
                a[c[inside], y[inside] - ty * tile + halo, x[inside] - tx * tile + halo] = v[inside]
                values = ([channels], [h + 2 * halo], [w + 2 * halo], [a.ravel()], [ty * tile], [tx * tile])
                types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32())
                arrays = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("img").slice(r, 1), *arrays], names)

    return held.mapInArrow(run, f"img {kind}, c int, h int, w int, v array<double>, y0 int, x0 int")


def focal_in_tiles(
    px: DataFrame, kernel: list[tuple], size: tuple[int, int], channels: int, tile: int, stride: int = 1, bias: list[float] | None = None
) -> DataFrame:
    """As ``raster.focal_sum``, for images of any size: tiles with the halo the kernel needs. ``tile``: a multiple of ``stride``."""
    if tile % stride:
        raise ValueError("tiles must be a multiple of the stride")
    halo = max((max(abs(t[0]), abs(t[1])) for t in kernel), default=0)
    made = apply(cut(px, size, channels, tile, halo), lambda a: focal(a, kernel, stride, bias, halo))
    made = made.withColumn("y0", (F.col("y0") / stride).cast("int")).withColumn("x0", (F.col("x0") / stride).cast("int"))
    return pixels(made, origin=("y0", "x0"))
