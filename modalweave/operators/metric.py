"""A metric index of vectors: blocks of neighbouring rows, and which pairs of blocks can matter.

A tree of splits at medians, fitted on a bounded sample, cuts space into cells, as many as the rows ask
for; rows are range-sorted by cell, so a block of consecutive rows lies in a small box. A block is described
by this box and by the least and the greatest distance of its rows to each of a few pivots. Two rows are at
least as far apart as their boxes, and as their distances to any pivot differ, and at most as far as these
add up, which bounds all distances between two blocks without reading their rows.

Blocks are bounded in bytes. Their descriptions meet in cells of a grid of bounded size; of the rows,
only the block pairs that are left meet at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.operators.blocks import as_matrix
from modalweave.sources.sinks import durable

BLOCK_BYTES = 4 << 20  # of vectors in a block
BLOCK_ROWS = 8192  # at most
NARROW, NARROW_ROWS = 16, 2048  # components up to which boxes part rows well, and rows of a block of such vectors
MAX_PIVOTS = 64
PIVOT_BYTES = 16 << 20  # of all pivots, which every task holds
SPLIT_BYTES = 16 << 20  # of the sample the splits are fitted on
BOX_DIMS = 64  # leading components that a box describes
FINER = 8  # cells of the tree to one in which blocks end
SUMMARIES = 512  # descriptions in a row of the grid
GUARD = 1e-8  # relative; far above the rounding of a distance and of the ties taken for equal

FIELDS = ("block", "place", "n", "low", "high", "box_low", "box_high", "ids", "ys", "width", "vectors")
DESCRIBED = ("tag", "block", "n", "low", "high", "box_low", "box_high")


@dataclass(frozen=True)
class Index:
    """``blocks``: tag, block, place (blocks near in it are near in space), n, low, high (distances to each pivot), box_low, box_high (of the leading components), ids,
    ys, width, vectors (doubles)."""

    blocks: DataFrame
    n_blocks: int
    n_pivots: int
    width: int = 0


def block_rows(width: int) -> int:
    return int(max(64, min(NARROW_ROWS if width <= NARROW else BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1)))))


def choose_pivots(rows: DataFrame, n: int, width: int, limit: int | None = None) -> np.ndarray:
    """Rows of the smallest hashes, at most MAX_PIVOTS and PIVOT_BYTES; none for tables of a few blocks."""
    wanted = n // (4 * block_rows(width)) if limit is None else limit
    wanted = min(wanted, MAX_PIVOTS, PIVOT_BYTES // (8 * max(width, 1)))
    if wanted < 2:
        return np.zeros((0, width))
    known = rows.where("v IS NOT NULL").select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"])
    return np.array([r["v"] for r in known.orderBy("h").limit(int(wanted)).collect()], np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Splits:
    """A complete binary tree: node ``i`` parts rows by ``at[i]`` in component ``by[i]``; its children are 2i+1 and 2i+2."""

    by: np.ndarray
    at: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, numbered from left to right."""
        node, inner = np.zeros(len(x), np.int64), len(self.by)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.by[node]] > self.at[node])
        return node - inner


def choose_splits(rows: DataFrame, n: int, width: int, tags: int = 1) -> Splits:
    """Splits at the median of the most varied component of a sample; FINER cells hold about two blocks of each tag.

    The sample is a share of the vectors by hash, of SPLIT_BYTES at most; its cells keep 16 rows of it or more.
    """
    most = SPLIT_BYTES // (8 * max(width, 1))
    leaves = FINER * n // (2 * block_rows(width) * max(tags, 1))
    depth = max(0, int(np.ceil(np.log2(max(1, min(leaves, n // 16, most // 16))))))
    share = min(1.0, most / (2 * max(n, 1)))
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))
    found = rows.where("v IS NOT NULL").where(part).select("v").limit(most).toArrow() if depth and width else None
    x = np.zeros((0, width)) if found is None else as_matrix(found["v"], width)
    x = x[np.isfinite(x).all(axis=1)]
    by, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: x}
    for node in range(len(by)):
        mine = held.pop(node)
        if len(mine):
            by[node] = int(mine.var(axis=0).argmax())
            at[node] = float(np.median(mine[:, by[node]]))
        right = mine[:, by[node]] > at[node] if len(mine) else np.zeros(0, bool)
        held[2 * node + 1], held[2 * node + 2] = mine[~right], mine[right]
    return Splits(by, at)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot, by differences."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        gap = x - p
        out[:, j] = np.sqrt((gap * gap).sum(axis=1))
    return out


def build(rows: DataFrame, pivots: np.ndarray, width: int, n: int, splits: Splits | None = None) -> Index:
    """Blocks of the ``n`` ``rows`` (tag, id, y, v); a block has rows of one tag. A NULL vector counts as zeros.

    A block ends where FINER cells of ``splits`` end; without them they are chosen here, for rows of one tag.
    """
    size = block_rows(width)
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    if len(pivots):
        splits = choose_splits(rows, n, width) if splits is None else splits
        kinds = rows.dtypes

        def homes(batches):
            for batch in batches:
                cell = splits.cells(as_matrix(batch.column("v"), width))
                found = [pa.array(cell // FINER, pa.int32()), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "home", "cell"])

        schema = ", ".join(f"{c} {t}" for c, t in kinds) + ", home int, cell int"
        keys = ["tag", "cell", "seq"]
        rows = rows.mapInArrow(homes, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)
    else:
        rows = rows.withColumn("home", F.lit(0)).coalesce(n // size + 1)
    types = dict(rows.dtypes)

    def pack(batches):
        held: dict[tuple, list[pa.RecordBatch]] = {}
        counts: dict[tuple, int] = {}
        task, packed = TaskContext.get(), 0
        first = (task.partitionId() if task else 0) << 32

        def blocks(key: tuple, rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal packed
            table = pa.Table.from_batches(held.pop(key)).combine_chunks()
            at = 0
            while table.num_rows - at >= size or (rest and at < table.num_rows):
                part = table.slice(at, size)
                at += part.num_rows
                x = as_matrix(part["v"], width)
                away = distances(x, pivots)
                low, high = (f(away, axis=0).tolist() if len(pivots) else [] for f in (np.min, np.max))
                box = x[:, :BOX_DIMS]
                corners = [f(box, axis=0).tolist() for f in (np.min, np.max)]
                listed = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c].combine_chunks()) for c in ("id", "y")]
                numbers, packed = pa.list_(pa.float64()), packed + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part["tag"].slice(0, 1).combine_chunks(),
                        part["seq"].slice(0, 1).combine_chunks(),
                        pa.array([first + packed - 1], pa.int64()),
                        pa.array([part.num_rows], pa.int32()),
                        pa.array([low], numbers),
                        pa.array([high], numbers),
                        *[pa.array([c], numbers) for c in corners],
                        *listed,
                        pa.array([width], pa.int32()),
                        pa.array([x.tobytes()], pa.binary()),
                    ],
                    ["tag", *FIELDS],
                )
            counts.pop(key)
            if at < table.num_rows:
                left = table.slice(at)
                held[key], counts[key] = left.to_batches(), left.num_rows

        for batch in batches:
            tags = pc.dictionary_encode(batch.column("tag"), null_encoding="encode")
            names, code = tags.dictionary.to_pylist(), tags.indices.to_numpy()
            home = batch.column("home").to_numpy()
            for t, h in sorted(set(zip(code.tolist(), home.tolist(), strict=True))):
                key = (names[t], h)
                for past in [p for p in held if len(pivots) and p != key]:  # sorted: no more of its rows come
                    yield from blocks(past, True)
                part = batch.take(pa.array(np.flatnonzero((code == t) & (home == h))))
                held.setdefault(key, []).append(part)
                counts[key] = counts.get(key, 0) + part.num_rows
                if counts[key] >= size:
                    yield from blocks(key, False)
        for key in list(held):
            yield from blocks(key, True)

    schema = (
        f"tag {types['tag']}, block long, place long, n int, low array<double>, high array<double>, "
        "box_low array<double>, box_high array<double>, "
        f"ids array<{types['id']}>, ys array<int>, width int, vectors binary"
    )
    blocks = durable(rows.mapInArrow(pack, schema), "blocks", blocks=True)
    return Index(blocks, blocks.count(), len(pivots), width)


def bounds(a_low, a_high, b_low, b_high) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance of each block of a to each of b, from distances to common pivots."""
    shape = (len(a_low), len(b_low))
    least, most = np.zeros(shape), np.full(shape, np.inf)
    for p in range(a_low.shape[1]):
        np.maximum(least, a_low[:, p, None] - b_high[None, :, p], out=least)
        np.maximum(least, b_low[None, :, p] - a_high[:, p, None], out=least)
        np.minimum(most, a_high[:, p, None] + b_high[None, :, p], out=most)
    return least, most


def apart(a_low, a_high, b_low, b_high) -> tuple[np.ndarray, np.ndarray]:
    """Least possible distance of each box of a to each of b, and the distance of their middles."""
    shape = (len(a_low), len(b_low))
    least, middle = np.zeros(shape), np.zeros(shape)
    for d in range(a_low.shape[1]):
        gap = np.maximum(a_low[:, d, None] - b_high[None, :, d], b_low[None, :, d] - a_high[:, d, None])
        np.fmax(gap, 0.0, out=gap)
        least += gap * gap
        gap = ((a_low + a_high)[:, d, None] - (b_low + b_high)[None, :, d]) / 2
        middle += gap * gap
    return np.sqrt(least), np.sqrt(middle)


def grid(left: DataFrame, n_left: int, right: DataFrame, n_right: int, chunk: int = SUMMARIES) -> DataFrame:
    """Descriptions of both sides in lists of about ``chunk``, every list of one with every list of the other."""
    rows, columns = n_left // chunk + 1, n_right // chunk + 1

    def lists(df: DataFrame, name: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        part = F.pmod(F.xxhash64("block"), F.lit(n_own)).cast("int").alias(own)
        item = F.struct(*[F.col(c) for c in df.columns])
        held = df.groupBy(part).agg(F.collect_list(item).alias(name))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    a = lists(left, "a", "_row", rows, "_column", columns)
    return a.join(lists(right, "b", "_column", columns, "_row", rows), ["_row", "_column"]).select("a", "b")


def _columns(items: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Numbers of the blocks, their distances to the pivots and their boxes."""

    def matrices(*names: str) -> list[np.ndarray]:
        return [np.array([i[c] for i in items], np.float64).reshape(len(items), -1) for c in names]

    return np.array([i["block"] for i in items], np.int64), matrices("low", "high"), matrices("box_low", "box_high")


def allowed(a: list[dict], b: list[dict], same: bool) -> np.ndarray:
    """Pairs that may meet: of equal tags, or of different ones."""
    one, two = (np.array([repr(i["tag"]) for i in items], object) for items in (a, b))
    equal = one[:, None] == two[None, :]
    return equal if same else ~equal


def seed_pairs(left: Index, right: Index, same: bool, k: int) -> DataFrame:
    """For each left block the right blocks nearest to it that hold k rows: block, other, away, n."""
    mine, theirs = (x.blocks.select(*DESCRIBED) for x in (left, right))
    met = grid(mine, left.n_blocks, theirs, right.n_blocks)

    def run(batches):
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                a, b = row["a"], row["b"]
                (own, _, x), (other, _, y) = _columns(a), _columns(b)
                away = np.nan_to_num(apart(*x, *y)[1], nan=np.finfo(np.float64).max)
                may = allowed(a, b, same)
                n, out = np.array([i["n"] for i in b]), []
                for i in range(len(a)):
                    order = np.lexsort((other, away[i]))
                    order = order[may[i][order]]
                    need = order[: 1 + int(np.searchsorted(np.cumsum(n[order]), k))]
                    out += [(own[i], other[j], away[i, j], n[j]) for j in need]
                if out:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "other", "away", "n"])

    return met.mapInArrow(run, "block long, other long, away double, n int")


def pairs_within(left: Index, right: Index, same: bool, reach: DataFrame | None = None) -> DataFrame:
    """block, other, away of all pairs that may hold rows within ``reach`` (block, reach) of each other; all allowed without it."""
    mine = left.blocks.select(*DESCRIBED)
    mine = mine.withColumn("reach", F.lit(float("inf"))) if reach is None else mine.join(reach, "block")
    met = grid(mine, left.n_blocks, right.blocks.select(*DESCRIBED), right.n_blocks)

    def run(batches):
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                a, b = row["a"], row["b"]
                (own, x, x_box), (other, y, y_box) = _columns(a), _columns(b)
                gap, middle = apart(*x_box, *y_box)
                least = np.fmax(bounds(*x, *y)[0], gap)
                far = np.array([i["reach"] for i in a], np.float64)[:, None]
                top = max((float(np.abs(t).max(initial=0.0)) for t in (x[1], y[1], *x_box, *y_box)), default=0.0)
                near = allowed(a, b, same) & ~(least > far + GUARD * (1.0 + top))
                at, to = np.nonzero(near)
                columns = [pa.array(own[at]), pa.array(other[to]), pa.array(middle[at, to])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "other", "away"])

    return met.mapInArrow(run, "block long, other long, away double")


def vectors_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width) if width else np.zeros((0, 0))
