"""Array images against the pixel-row operators, and tiles against whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.operators import raster as R
from modalweave.operators import tiles as TL


def table(spark, shapes=((2, 7, 5), (2, 7, 5), (2, 4, 9)), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, *shape, [float(x) for x in rng.normal(size=shape).ravel()]) for i, shape in enumerate(shapes)]
    return spark.createDataFrame(rows, "img int, c int, h int, w int, v array<double>")


def as_dict(px, *columns):
    return {(r["img"], r["y"], r["x"], r["c"]): tuple(round(r[c], 9) + 0.0 for c in columns or ("v",)) for r in px.collect()}


def one(df, img):
    return df.where(F.col("img") == img)


def test_pixels_are_in_channel_row_column_order(spark):
    df = table(spark)
    rows = {r["img"]: (np.array(r["v"]).reshape(r["c"], r["h"], r["w"])) for r in df.collect()}
    for (img, y, x, c), (v,) in as_dict(TL.pixels(df)).items():
        assert v == round(rows[img][c, y, x], 9)


@pytest.mark.parametrize("k", [1, 2, 3, 8])
def test_pools_equal_those_of_pixel_rows(spark, k):
    df = table(spark)
    px = TL.pixels(df)
    assert as_dict(TL.pixels(TL.apply(df, lambda a: TL.max_pool(a, k)))) == as_dict(R.block_max_pool(px, k))
    assert as_dict(TL.pixels(TL.apply(df, lambda a: TL.mean_pool(a, k)))) == as_dict(R.block_mean(px, k))


@pytest.mark.parametrize("size", [(3, 3), (7, 5), (10, 11)])
def test_nearest(spark, size):
    df = one(table(spark), 0)
    got = TL.pixels(TL.apply(df, lambda a: TL.resize_nearest(a, size)))
    assert as_dict(got) == as_dict(R.nearest_upsample(TL.pixels(df), (7, 5), size))


KERNELS = {
    "ring": [(dy, dx, ci, co, 0.1 * dy + 0.3 * dx + ci - 0.5 * co) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for ci in (0, 1) for co in (0, 1)],
    "far": [(-3, 2, 1, 0, 0.5), (2, 0, 0, 2, -1.0)],
}


@pytest.mark.parametrize("kernel", KERNELS)
@pytest.mark.parametrize(("stride", "tile"), [(1, 3), (1, 64), (2, 4), (3, 3)])
def test_focal_of_arrays_and_of_tiles(spark, kernel, stride, tile):
    df = one(table(spark), 1)
    px, bias = TL.pixels(df), [0.25, -0.5, 1.0]
    want = as_dict(R.focal_sum(px, KERNELS[kernel], (7, 5), stride, bias))
    assert as_dict(TL.pixels(TL.apply(df, lambda a: TL.focal(a, KERNELS[kernel], stride, bias)))) == want
    tiled = TL.focal_in_tiles(px.repartition(3), KERNELS[kernel], (7, 5), 2, tile, stride, bias)
    assert as_dict(tiled) == want


def test_tiles_are_bounded_and_hold_their_halo(spark):
    df = one(table(spark), 0)
    image = np.array(df.first()["v"]).reshape(2, 7, 5)
    padded = np.pad(image, ((0, 0), (2, 2), (2, 2)))
    tiles = TL.cut(TL.pixels(df), (7, 5), 2, 3, 2).collect()
    assert len(tiles) == 6 and max(t["h"] * t["w"] for t in tiles) <= 49
    for t in tiles:
        part = np.array(t["v"]).reshape(t["c"], t["h"], t["w"])
        assert np.allclose(part, padded[:, t["y0"] : t["y0"] + t["h"], t["x0"] : t["x0"] + t["w"]])
    with pytest.raises(ValueError, match="stride"):
        TL.focal_in_tiles(TL.pixels(df), KERNELS["ring"], (7, 5), 2, 3, 2)


def test_gates_by_channel(spark):
    df = table(spark)
    got = TL.pixels(TL.apply(df, lambda a: TL.gates(a, 3, 2.0, 0.5), "gate"), ("v", "gate"))
    want = R.patch_gate(TL.pixels(df), 3, 2.0, 0.5)
    assert as_dict(got, "v", "gate") == as_dict(want, "v", "gate")


def test_flips(spark):
    df = one(table(spark, [(2, 7, 5)] * 12), 3).unionByName(table(spark, [(2, 7, 5)] * 12).where("img <> 3"))
    got = TL.pixels(TL.flip(df, R.flip_bits(F.col("img"), 4, 7)))
    assert as_dict(got) == as_dict(R.flip(TL.pixels(df), (7, 5), 4, 7))


def test_no_exchange_and_no_loss(spark):
    df = table(spark).unionByName(spark.createDataFrame([(9, 2, 7, 5, None)], "img int, c int, h int, w int, v array<double>"))
    pooled = TL.apply(df, lambda a: TL.max_pool(a, 2))
    assert "Exchange" not in pooled._jdf.queryExecution().executedPlan().toString()
    rows = {r["img"]: r for r in pooled.collect()}
    assert rows[9]["v"] is None and rows[0]["h"] == 4 and rows[0]["w"] == 3 and len(rows) == 4
    assert TL.apply(df.where("img < 0"), lambda a: TL.max_pool(a, 2)).count() == 0
    with pytest.raises(Exception, match="beside an image"):
        TL.apply(df, lambda a: TL.max_pool(a, 2), "pooled").collect()


def test_focal_sums_are_dealt_out_by_pixels(spark, monkeypatch):
    rows = [(i, y, x, 0, float(i + y * x)) for i in range(6) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "img long, y int, x int, c int, v double").coalesce(1)
    kernel = [(dy, dx, 0, 0, 0.5 + dy + 2.0 * dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    whole = as_dict(R.focal_sum(px, kernel, (8, 8)))
    monkeypatch.setattr(R, "TASK_PIXELS", 16)
    monkeypatch.setattr(R, "BAND", 2)
    parts = R.focal_sum(px, kernel, (8, 8))
    assert parts.rdd.getNumPartitions() == 25
    assert as_dict(parts) == whole and len(whole) == 6 * 64
