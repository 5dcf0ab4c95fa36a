"""Exact k nearest neighbours between two tables, pruned by a metric index, and the majority vote."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.operators import metric
from modalweave.operators.skew import salted_join
from modalweave.sources.sinks import durable

DIRECT = 64  # pairs of blocks up to which nothing is gained by leaving some out
MOST_TASKS = 4096
MET = 32  # train blocks that a group of test blocks meets in a piece of work, at most
TOGETHER, TOGETHER_BYTES = 16, 32 << 20  # test blocks of a group, and bytes of their vectors, at most
PIECES = 64  # pieces of work that there are at least, before they grow
CROWD = 64  # candidates a row, beyond which their reach is narrowed before they are measured
CHUNK_CELLS = 250_000  # distances, or numbers of differences, held at once in a task
DIGITS = 9  # distances that agree to this many decimals are a tie


def nearest_in_block(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None):
    """Row and column indices of the k nearest ``y`` of every ``x`` and the distances; no farther than ``within`` each.

    The product form finds the candidates; it is not exact near zero, so every
    candidate within its error bound is measured again by differences.
    """
    middle = np.nan_to_num(x[0], nan=0.0, posinf=0.0, neginf=0.0) if len(x) else 0.0  # near it, numbers are small and exact
    moved = x - middle, y - middle
    norm_x, norm_y = ((m * m).sum(axis=1) for m in moved)
    top = norm_y.max()  # a vector with a part that is no number leaves its block without a bound, and so out
    lost = 1e-12 * ((x * x).sum(axis=1) + np.fmax.reduce((y * y).sum(axis=1)))

    def error(kind) -> np.ndarray:
        return 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * (norm_x + top) + lost

    # In single precision if what it may miss is little to the distances sought.
    sought = np.full(len(x), np.inf) if within is None else within
    sure = np.isfinite(sought).all() and np.all(error(np.float32) < 0.05 * sought * sought)
    kind = np.float32 if sure and np.fmax.reduce(norm_x) + top < 1e30 else np.float64
    errors = error(kind)
    # Squared distances are one product of longer vectors.
    left = np.column_stack([-2.0 * moved[0], norm_x, np.ones(len(x))]).astype(kind)
    right = np.column_stack([moved[1], np.ones(len(y)), norm_y]).astype(kind).T.copy()
    step = max(1, CHUNK_CELLS // max(1, len(y)))
    kk = min(k, len(y))
    found = []
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d2 = left[s : s + step] @ right
        slack, kth = errors[s : s + step], sought[s : s + step].copy()
        near = None
        open_ = np.flatnonzero(~np.isfinite(kth))
        if not len(open_):
            near = d2 <= _up(_reach(kth) + slack, kind)[:, None]
            open_ = np.flatnonzero(near.sum(axis=1) > CROWD * kk) if np.count_nonzero(near) > CROWD * kk else open_
        if len(open_):
            best = np.partition(d2[open_], kk - 1, axis=1)[:, kk - 1].astype(np.float64)
            best = np.sqrt(np.clip(np.where(np.isnan(best), np.inf, best), 0.0, None) + 2 * slack[open_])
            kth[open_] = np.minimum(kth[open_], best)
            near = d2 <= _up(_reach(kth) + slack, kind)[:, None]
        rows, cols = np.divmod(np.flatnonzero(near), len(y))
        del d2, near
        dist = np.empty(len(rows))
        measured = max(1, CHUNK_CELLS // max(1, y.shape[1]))
        for c in range(0, len(rows), measured):
            e = slice(c, c + measured)
            diff = part[rows[e]] - y[cols[e]]
            dist[e] = np.round(np.sqrt((diff * diff).sum(axis=1)), DIGITS)
        rows, cols, dist = (a[_first(rows, dist, ids[cols], kk)] for a in (rows, cols, dist))
        found.append((rows + s, cols, dist))
    return [np.concatenate(part) for part in zip(*found, strict=True)]


def _reach(distance: np.ndarray) -> np.ndarray:
    """Square of the distance below which a row may be taken for as near; rounding may merge distances 1e-9 apart."""
    return (distance + 2 * 10.0**-DIGITS) ** 2


def _up(limit: np.ndarray, kind) -> np.ndarray:
    """Limits in the given precision, no smaller."""
    return np.nextafter(limit.astype(kind), kind(np.inf))


def _first(rows: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every row in the order of distance and id."""
    order = np.lexsort((ids, dist, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k]


@dataclass(frozen=True)
class Search:
    """``near``: tag, cell_id, train_id, y, distance of at least the k nearest; ``pairs``: block pairs that were met."""

    near: DataFrame
    pairs: DataFrame
    possible: int


def _copy(values: pa.Array) -> pa.Array:
    """The same values, without the batch they came in."""
    return values.take(pa.array(np.arange(len(values))))


class Held:
    """The k nearest that the rows of a test block have met so far."""

    def __init__(self, row: dict, width: int, k: int):
        self.fixed, self.k = {c: _copy(row[c]) for c in ("tag", "block")}, k
        self.ids, self.x = _copy(row["ids"].flatten()), metric.vectors_of(row["vectors"][0].as_py(), width)
        n = len(self.x)
        self.within = np.full(n, np.inf)
        if row["within"][0].is_valid:
            known = row["within"].flatten().to_numpy(zero_copy_only=False).copy()
            self.within = np.where(known < 0, np.inf, known)
        self.rows, self.dist = np.zeros(0, np.int64), np.zeros(0)
        self.train: pa.Array | None = None
        self.ys: pa.Array | None = None

    def meet(self, y: np.ndarray, train: pa.Array, ys: pa.Array) -> None:
        """Only rows that may have a neighbour in the block's box are compared, with the vectors near enough to one of them."""
        own = np.arange(len(self.x))
        for _ in range(2):
            if len(own) and len(y):
                own = own[self.near_box(self.x[own], y, self.within[own])]
            if len(own) and len(y):
                cols = np.flatnonzero(self.near_box(y, self.x[own], self.within[own].max()))
                y, train, ys = y[cols], train.take(pa.array(cols)), ys.take(pa.array(cols))
        if not len(own) or not len(y):
            return
        rows, cols, dist = nearest_in_block(self.x[own], y, ordering(train), self.k, self.within[own])
        if not len(rows):
            return
        at = pa.array(cols)
        rows, dist = np.concatenate([self.rows, own[rows]]), np.concatenate([self.dist, dist])
        train, ys = (
            new.take(at) if old is None else pa.concat_arrays([old, new.take(at)])
            for old, new in ((self.train, train), (self.ys, ys))
        )
        best = _first(rows, dist, ordering(train), self.k)
        self.rows, self.dist = rows[best], dist[best]
        self.train, self.ys = train.take(pa.array(best)), ys.take(pa.array(best))
        n = np.bincount(self.rows, minlength=len(self.x))
        full = n >= self.k
        self.within[full] = np.minimum(self.within[full], self.dist[np.cumsum(n)[full] - 1])

    @staticmethod
    def near_box(rows: np.ndarray, others: np.ndarray, within) -> np.ndarray:
        low, high = np.fmin.reduce(others, axis=0), np.fmax.reduce(others, axis=0)
        gap = np.fmax(np.maximum(low - rows, rows - high), 0.0)
        top = max(np.fmax.reduce(np.abs(low), initial=0.0), np.fmax.reduce(np.abs(high), initial=0.0))
        return ~(np.sqrt((gap * gap).sum(axis=1)) > within + metric.GUARD * (1.0 + top))

    def result(self, names: list[str]) -> pa.RecordBatch:
        n = pa.array(np.zeros(len(self.rows), np.int64))
        fixed = [self.fixed[c].take(n) for c in ("tag", "block")]
        own = self.ids.take(pa.array(self.rows))
        return pa.RecordBatch.from_arrays([*fixed, own, self.train, self.ys, pa.array(self.dist)], names)


def _shape(n_pairs: int, width: int) -> tuple[int, int]:
    """Test blocks of a group (a power of 2) and train blocks of a piece of work.

    A train block is copied once for every group and a test block for every piece of its group, so both grow together
    until there would be fewer than PIECES pieces.
    """
    size = 8 * max(width, 1) * metric.block_rows(width)
    most = max(1, min(TOGETHER, TOGETHER_BYTES // size))
    together = 1 << int(min(np.log2(most), max(0, np.round(np.log2(max(1, n_pairs / PIECES)) / 2))))
    return together, int(max(4, min(MET, n_pairs // (PIECES * together))))


def _pieces(pairs: DataFrame, test: metric.Index, train: metric.Index, within: DataFrame | None = None) -> DataFrame:
    """Blocks by piece of work, test blocks before train blocks (which name the test blocks they meet: mates).

    A piece is a group of test blocks near each other and some of the train blocks that any of them meets, nearest
    first. A train block comes once for all test blocks of the group.
    """
    together, most = _shape(pairs.count(), test.width)
    group = F.floor(F.col("place") / together).cast("long").alias("group")
    met = pairs.join(test.blocks.select("block", group), "block").groupBy("group", "other")
    met = met.agg(F.collect_list("block").alias("mates"), F.min("away").alias("away"))
    sizes = met.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_pieces"))
    work = sizes.agg(F.sum("_pieces")).first()[0] or 1
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, min(int(work), MOST_TASKS))
    types, other = dict(test.blocks.dtypes), dict(train.blocks.dtypes)["ids"]
    empty = {"tag": types["tag"], "block": "bigint", "ids": types["ids"], "within": "array<double>"}
    empty |= {"mates": "array<bigint>", "other_ids": other, "ys": "array<int>"}

    def row(df: DataFrame, away: Column, *have: str) -> DataFrame:
        filled = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in empty.items()]
        return df.select("group", "piece", away.alias("away"), *filled, "width", "vectors")

    left = test.blocks if within is None else test.blocks.join(within, "block", "left")
    left = left.select("*", group).join(sizes, "group")
    left = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    left = row(left, F.lit(-1.0), "tag", "block", "ids", *([] if within is None else ["within"]))
    right = train.blocks.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), "ys", "width", "vectors")
    right = met.join(sizes, "group").join(right, "other")
    right = right.withColumn("piece", F.pmod(F.xxhash64("other"), F.col("_pieces")).cast("int"))
    right = row(right, F.col("away"), "mates", "other_ids", "ys")
    return left.unionByName(right).repartition(tasks, "group", "piece").sortWithinPartitions("group", "piece", "away")


def _meet(pairs: DataFrame, test: metric.Index, train: metric.Index, k: int, within: DataFrame | None = None) -> DataFrame:
    """tag, block, cell_id, train_id, y, distance: for each test row the k nearest of the train blocks it meets.

    Each block that is met narrows what the rows still look for. ``within`` (block, within): distances of the rows, in
    their order, beyond which nothing is looked for (negative: no bound).
    """
    pieces = _pieces(pairs, test, train, within)
    types = dict(pieces.dtypes)
    cell, other = (types[c].removeprefix("array<").removesuffix(">") for c in ("ids", "other_ids"))
    schema = f"tag {types['tag']}, block long, cell_id {cell}, train_id {other}, y int, distance double"
    names = ["tag", "block", "cell_id", "train_id", "y", "distance"]

    def run(batches):
        at, held = None, {}

        def results():
            return [h.result(names) for h in held.values() if len(h.rows)]

        for batch in batches:
            for r in range(batch.num_rows):
                now = {c: batch.slice(r, 1).column(c) for c in batch.schema.names}
                if at != (piece := (now["group"][0].as_py(), now["piece"][0].as_py())):
                    yield from results()
                    at, held = piece, {}
                width = now["width"][0].as_py()
                if now["away"][0].as_py() < 0:
                    held[now["block"][0].as_py()] = Held(now, width, k)
                    continue
                y = metric.vectors_of(now["vectors"][0].as_py(), width)
                for mate in (held[m] for m in now["mates"][0].as_py()):
                    if mate.x.shape[1] != y.shape[1]:
                        raise ValueError(f"vectors of {mate.x.shape[1]} and {y.shape[1]} numbers can't be compared")
                    mate.meet(y, now["other_ids"].flatten(), now["ys"].flatten())
        yield from results()

    return pieces.mapInArrow(run, schema)


def ordering(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, for ids of any kind."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, "ascending", tiebreaker="dense").to_numpy()


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys, "cell_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(test: metric.Index, train: metric.Index, k: int, same: bool) -> Search:
    """Every test block with the train blocks of its tag (or of all other tags) that can matter.

    First each test block meets the train blocks that surely hold k rows near it; the greatest k-th distance
    found is the block's reach. Then it meets the others that may hold a row within that reach.
    """
    possible = test.n_blocks * train.n_blocks
    if possible <= DIRECT or not train.n_pivots:
        pairs = durable(metric.pairs_within(test, train, same), "pairs", freed=True)
        near = durable(_meet(pairs, test, train, k).drop("block"), "near", blocks=True)
        return Search(near, pairs.select("block", "other"), possible)
    w = Window.partitionBy("block").orderBy("away", "other")
    before = F.sum("n").over(w) - F.col("n")
    seeds = metric.seed_pairs(test, train, same, k).withColumn("before", before).where(F.col("before") < k)
    seeds = durable(seeds.select("block", "other", "away"), "seeds", freed=True)
    first = durable(_ranked(_meet(seeds, test, train, k), ["tag", "block"], k).drop("rank"), "near", blocks=True)
    # A row that found fewer than k has to meet all, and so has its block.
    per_row = first.groupBy("block", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    rows = test.blocks.select("block", F.posexplode("ids").alias("at", "cell_id")).join(per_row, ["block", "cell_id"], "left")
    far = F.when(F.col("n") == k, F.col("d")).otherwise(-1.0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", far.alias("far")))), lambda s: s["far"])
    open_ = F.min(far) < 0
    within = rows.groupBy("block").agg(listed.alias("within"), F.when(open_, float("inf")).otherwise(F.max(far)).alias("reach"))
    within = durable(within, "within", freed=True)
    pairs = metric.pairs_within(test, train, same, within.select("block", "reach"))
    pairs = durable(pairs.join(seeds, ["block", "other"], "left_anti"), "pairs", freed=True)
    later = durable(_meet(pairs, test, train, k, within.select("block", "within")), "near", blocks=True)
    return Search(first.unionByName(later).drop("block"), seeds.unionByName(pairs).select("block", "other"), possible)


def _prepared(df: DataFrame, tag: str, key: str, vector: str, label: bool) -> DataFrame:
    y = F.col("y").cast("int") if label else F.lit(None).cast("int")
    return df.select(F.col(tag).alias("tag"), F.col(key).alias("id"), y.alias("y"), F.col(vector).alias("v"))


def _sizes(rows: DataFrame) -> tuple[int, int, int]:
    n, width, tags = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.approx_count_distinct("tag")).first()
    return n, max(width or 0, 0), tags


def _no_copies(rows: DataFrame, width: int, k: int) -> DataFrame:
    """tag, id, y, v, copy: of equal vectors of a tag the k rows that come first, numbered from 1.

    No other can be among the k nearest, and what one finds all find.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    rows = rows.withColumn("v", F.coalesce(F.col("v").cast("array<double>"), zeros)).withColumn("h", F.xxhash64("v"))
    w = Window.partitionBy("h", "tag", "v").orderBy("id")
    return rows.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k).drop("h")


def _with_copies(found: Search, few: DataFrame, rows: DataFrame, width: int, k: int, by: str) -> DataFrame:
    """What the first of equal rows found, for all of them."""
    near = _ranked(found.near, ["tag"], k)
    firsts = few.where("copy = 1 AND tag IS NOT NULL").select("tag", F.col("id").alias("cell_id"), "v")
    item = F.struct("train_id", "y", "distance", "rank")
    lists = firsts.join(near, ["tag", "cell_id"]).groupBy("tag", "v").agg(F.collect_list(item).alias("near"))
    v = F.coalesce(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), width))
    members = rows.where("tag IS NOT NULL").select("tag", F.col("id").alias("cell_id"), v.alias("v"))
    return salted_join(members, lists, ["tag", "v"]).select(F.col("tag").alias(by), "cell_id", F.inline("near"))


def _indexed(rows: DataFrame, pivots: int | None) -> tuple[metric.Index, np.ndarray, metric.Splits | None]:
    n, width, tags = _sizes(rows)
    chosen = metric.choose_pivots(rows, n, width, pivots)
    splits = metric.choose_splits(rows, n, width, tags) if len(chosen) else None
    return metric.build(rows.select("tag", "id", "y", "v"), chosen, width, n, splits), chosen, splits


def k_nearest(
    test: DataFrame,
    train: DataFrame,
    k: int = 5,
    by: str = "fold",
    key: str = "cell_id",
    vector: str = "features",
    pivots: int | None = None,
) -> DataFrame:
    """``(by, cell_id, train_id, y, distance, rank)`` of the k nearest train rows in the same group.

    Exact; equal distances go to the smaller train id. ``pivots`` sets their number (by the table's size if not given).
    """
    a, b = _prepared(test, by, key, vector, False), _prepared(train, by, key, vector, True)
    width = _sizes(b)[1]
    few = durable(_no_copies(a, width, 1), "test", freed=True)
    train_index, chosen, splits = _indexed(durable(_no_copies(b, width, k), "train", freed=True), pivots)
    test_index = metric.build(few.select("tag", "id", "y", "v"), chosen, width, few.count(), splits)
    return _with_copies(search(test_index, train_index, k, True), few, a, width, k, by)


def k_nearest_of_others(
    cells: DataFrame,
    k: int = 5,
    group: str = "donor",
    by: str = "fold",
    key: str = "cell_id",
    vector: str = "features",
    pivots: int | None = None,
) -> DataFrame:
    """As ``k_nearest``, of every row among the rows of all other groups; rows without a group only serve the others.

    The table is indexed once; rows are not copied per fold.
    """
    rows = _prepared(cells, group, key, vector, True)
    width = _sizes(rows)[1]
    few = durable(_no_copies(rows, width, k), "few", freed=True)
    return _with_copies(_search_few(few, k, pivots), few, rows, width, k, by)


def search_others(
    cells: DataFrame, k: int, group: str, key: str = "cell_id", vector: str = "features", pivots: int | None = None
) -> Search:
    """The search of ``k_nearest_of_others``, of the first of equal rows of a group."""
    rows = _prepared(cells, group, key, vector, True)
    return _search_few(durable(_no_copies(rows, _sizes(rows)[1], k), "few", freed=True), k, pivots)


def _search_few(few: DataFrame, k: int, pivots: int | None) -> Search:
    index, _, _ = _indexed(few, pivots)
    return search(replace(index, blocks=index.blocks.where("tag IS NOT NULL")), index, k, False)


def majority(neighbours: DataFrame, by: str = "fold") -> DataFrame:
    """Most frequent class among the neighbours; a tie goes to the smallest class."""
    votes = neighbours.groupBy(by, "cell_id", "y").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(by, "cell_id").agg(F.max_by("y", F.struct("n", (-F.col("y")).alias("m"))).alias("y_pred"))


def knn_predict(test: DataFrame, train: DataFrame, k: int = 5, by: str = "fold", **names) -> DataFrame:
    return majority(k_nearest(test, train, k, by, **names), by)
