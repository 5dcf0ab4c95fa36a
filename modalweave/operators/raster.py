"""Image operators on pixel tables ``(img, y, x, c, v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 64  # rows of outputs that are summed together
TASK_PIXELS = 1 << 18  # of a task of sums


def _block(column: str, k: int) -> Column:
    return F.floor(F.col(column) / k).cast("int")


def block_max_pool(px: DataFrame, k: int) -> DataFrame:
    """Maximum of every k x k block. All pixels of a block come from one row of the
    source, so the map-side aggregate does nearly all of the work."""
    keys = [F.col("img"), _block("y", k).alias("y"), _block("x", k).alias("x"), F.col("c")]
    return px.groupBy(*keys).agg(F.max("v").alias("v"))


def block_mean(px: DataFrame, k: int) -> DataFrame:
    keys = [F.col("img"), _block("y", k).alias("y"), _block("x", k).alias("x"), F.col("c")]
    return px.groupBy(*keys).agg(F.avg("v").alias("v"))


def _targets(column: str, size: int, new_size: int) -> Column:
    """Positions t of the new grid with floor(t * size / new_size) = position."""
    pos = F.col(column)
    first = F.ceil(pos * new_size / size).cast("int")
    last = F.ceil((pos + 1) * new_size / size).cast("int") - 1
    every = F.sequence(first, F.greatest(first, last))
    return F.explode(F.when(last >= first, every).otherwise(F.array().cast("array<int>")))


def nearest_upsample(px: DataFrame, size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize. Each pixel writes the target pixels that read it: no join."""
    rows = px.withColumn("y", _targets("y", size[0], new_size[0]))
    return rows.withColumn("x", _targets("x", size[1], new_size[1]))


def focal_sum(
    px: DataFrame,
    kernel: list[tuple[int, int, int, int, float]],
    size: tuple[int, int],
    stride: int = 1,
    bias: list[float] | None = None,
) -> DataFrame:
    """Weighted sum of the neighbours of a pixel, zero outside the image (a convolution).

    ``kernel`` lists ``(dy, dx, c_in, c_out, weight)``: output (oy, ox) adds the pixel
    at ``(oy * stride + dy, ox * stride + dx)``. Every output of an image is returned; one that no pixel reaches is 0,
    or its bias.

    Each pixel goes to the bands of output rows it takes part in (mostly one), the only exchange; its products are formed and
    summed there. The number of tasks follows that of the pixels, so none holds more sums the larger the table is.
    """
    rows, cols = -(-size[0] // stride), -(-size[1] // stride)
    made = sorted({co for _, _, _, co, _ in kernel} | set(range(len(bias or []))))
    low = F.floor((F.col("y") - max(t[0] for t in kernel)) / stride)
    high = F.floor((F.col("y") - min(t[0] for t in kernel)) / stride)
    touched = F.sequence(
        F.floor(F.greatest(F.lit(0), low) / BAND).cast("int"), F.floor(F.least(F.lit(rows - 1), high) / BAND).cast("int")
    )
    # An image's own row in a band stands for all its outputs there: a pixel of value 0 with a tap to each.
    kinds = dict(px.dtypes)
    at_origin = {"y": F.lit(0), "x": F.lit(0), "c": F.lit(None), "v": F.lit(0.0)}
    whole = px.select("img").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit((rows - 1) // BAND))))
    whole = whole.select("img", "band", *[v.cast(kinds[n]).alias(n) for n, v in at_origin.items()], F.lit(True).alias("whole"))
    own = px.where((high >= 0) & (low < rows)).withColumn("band", F.explode(touched))
    own = own.select("img", "band", "y", "x", "c", "v", F.lit(False).alias("whole"))
    tasks = max(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), px.count() // TASK_PIXELS + 1)
    placed = own.unionByName(whole).repartition(tasks, "img", "band")

    def tap(dy, dx, ci, co, w):
        columns = {"dy": (dy, "int"), "dx": (dx, "int"), "ci": (ci, "int"), "co": (co, "int"), "w": (w, "double")}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, (v, t) in columns.items()])

    taps = F.array(*[tap(*t) for t in kernel])
    band_rows = F.sequence(F.col("band") * BAND, F.least(F.lit(rows - 1), F.col("band") * BAND + BAND - 1))
    to_all = F.flatten(
        F.transform(
            band_rows,
            lambda y: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.lit(cols - 1)),
                    lambda x: F.array(*[tap(-y * stride, -x * stride, None, co, 0.0) for co in made]),
                )
            ),
        )
    )
    sent = placed.withColumn("t", F.explode(F.when(F.col("whole"), to_all).otherwise(taps)))
    sent = sent.where(F.col("whole") | (F.col("t.ci") == F.col("c")))
    oy, ox = F.col("y") - F.col("t.dy"), F.col("x") - F.col("t.dx")
    inside = (oy >= 0) & (ox >= 0) & (oy < rows * stride) & (ox < cols * stride)
    on_grid = (oy % stride == 0) & (ox % stride == 0)
    in_band = F.floor(oy / (stride * BAND)) == F.col("band")
    products = sent.where(inside & on_grid & in_band).select(
        "img",
        "band",
        (oy / stride).cast("int").alias("y"),
        (ox / stride).cast("int").alias("x"),
        F.col("t.co").alias("c"),
        (F.col("v") * F.col("t.w")).alias("v"),
    )
    out = products.groupBy("img", "band", "y", "x", "c").agg(F.sum("v").alias("v")).drop("band")
    if bias is not None:
        offset = F.element_at(F.array(*[F.lit(float(b)) for b in bias]), F.col("c") + 1)
        out = out.withColumn("v", F.col("v") + offset)
    return out


def patch_gate(px: DataFrame, k: int = 8, weight: float = 1.0, bias: float = 0.0) -> DataFrame:
    """One gate in (0, 1) per channel of a k x k patch, painted back on its pixels and applied.

    A channel of a patch is at most k * k pixels, so it is gathered once and unfolded
    again instead of joining the gates back.
    """
    patch = px.groupBy("img", "c", _block("y", k).alias("py"), _block("x", k).alias("px")).agg(
        F.avg("v").alias("m"), F.collect_list(F.struct("y", "x", "v")).alias("p")
    )
    gate = 1.0 / (1.0 + F.exp(-(F.col("m") * weight + bias)))
    return patch.select("img", "c", gate.alias("gate"), F.inline("p")).withColumn("gated", F.col("v") * F.col("gate"))


def flip_bits(img: Column, epoch: int = 1, seed: int = 42) -> Column:
    """0 to 3, by a hash of the image and the epoch: 1 mirrors left to right, 2 top to bottom."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), img.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 4


def flip(px: DataFrame, size: tuple[int, int], epoch: int = 1, seed: int = 42, only: Column | None = None):
    """Seeded horizontal and vertical flips with probability 1/2 each, per image and epoch.

    ``only`` restricts the flips, e.g. to the train split.
    """
    bits = flip_bits(F.col("img"), epoch, seed)
    allowed = F.lit(True) if only is None else only
    horizontal = allowed & (bits % 2 == 1)
    vertical = allowed & (bits >= 2)
    return px.select(
        *[c for c in px.columns if c not in ("y", "x")],
        F.when(vertical, size[0] - 1 - F.col("y")).otherwise(F.col("y")).alias("y"),
        F.when(horizontal, size[1] - 1 - F.col("x")).otherwise(F.col("x")).alias("x"),
    )


def stack_channels(a: DataFrame, b: DataFrame, a_channels: int) -> DataFrame:
    """Channels of ``b`` behind the channels of ``a``."""
    return a.unionByName(b.withColumn("c", F.col("c") + a_channels))


def to_vectors(px: DataFrame) -> DataFrame:
    """One vector per image in (c, y, x) order; an image has a fixed number of pixels."""
    cells = F.sort_array(F.collect_list(F.struct("c", "y", "x", "v")))
    return px.groupBy("img").agg(F.transform(cells, lambda p: p["v"]).alias("features"))
