"""Leave-one-group-out folds, exact-size validation splits, class weights, batches.

The validation part of a fold is the first ``ceil(fraction * n)`` of its training
ids in the order of a seeded hash. Ranking all ids of a fold would put the fold
into one task, so the rank is replaced by a cut-off: hash prefixes are counted, the
prefix in which the quota is reached is found per fold, and only the ids under that
prefix are ranked. While too many ids share it, the prefix is made longer by another
count. Each pass reads two narrow columns; the result has one small row per fold, and
the split of a cell in any fold is an expression on that row.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 3  # hex digits by which the counted prefix grows: 4096 prefixes per pass
RANKED = 1_000_000  # ids per fold that may be ranked in one task


def fold_list(meta: DataFrame, group: str = "donor") -> DataFrame:
    """Sorted distinct groups; cells without a group never form a fold."""
    return meta.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group)


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


@dataclass(frozen=True)
class Fold:
    """Sizes of a fold and the last id of its validation part in hash order."""

    fold: int | str
    n_test: int
    n_rest: int
    n_val: int
    cut_hash: str | None = None
    cut_key: int | str | None = None


@dataclass(frozen=True)
class FoldPlan:
    folds: list[Fold]
    group_type: str
    key_type: str
    seed: int

    def column(self) -> Column:
        """All folds as one constant array of structs."""
        rows = [{"fold": f.fold, "cut_hash": f.cut_hash, "cut_key": f.cut_key} for f in self.folds]
        return constant(rows, f"fold: {self.group_type}, cut_hash: string, cut_key: {self.key_type}")

    def table(self, spark) -> DataFrame:
        kind = (
            f"fold {self.group_type}, n_test bigint, n_rest bigint, n_val bigint, "
            f"cut_hash string, cut_key {self.key_type}"
        )
        return spark.createDataFrame([asdict(f) for f in self.folds], kind)


def fold_plan(
    meta: DataFrame, key: str = "cell_id", group: str = "donor", fraction: float = 0.2, seed: int = 42
) -> FoldPlan:
    """Test, train and validation sizes and the validation cut-off of every fold.

    ``meta`` has one row per key. What reaches the driver has one row per fold.
    """
    ids = meta.select(F.col(key).alias("k"), F.col(group).alias("g"), order_key(key, seed).alias("h"))
    types = dict(ids.dtypes)
    counts = count_prefixes(ids, STEP)
    sizes = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    folds = [
        Fold(g, n, total - n, math.ceil(fraction * (total - n)))
        for g, n in sorted((i for i in sizes.items() if i[0] is not None))
    ]
    length = STEP
    borders = [{"fold": f.fold, "p": "", "need": f.n_val} for f in folds if f.n_val > 0]
    borders = find_borders(counts, borders, length, types["g"])
    counts.unpersist()
    while any(b["size"] > RANKED for b in borders) and length + STEP <= 30:
        length += STEP
        near = ids.where(F.substring("h", 1, length - STEP).isin(sorted({b["p"] for b in borders})))
        counts = count_prefixes(near, length)
        borders = find_borders(counts, borders, length, types["g"])
        counts.unpersist()
    if not borders:
        return FoldPlan(folds, types["g"], types["k"], seed)

    prefix = F.substring("h", 1, length)
    near = (
        ids.where(prefix.isin(sorted({b["p"] for b in borders})))
        .select("*", F.inline(constant(borders, f"fold: {types['g']}, p: string, need: bigint")))
        .where((prefix == F.col("p")) & ~F.col("g").eqNullSafe(F.col("fold")))
    )
    rank = F.row_number().over(Window.partitionBy("fold").orderBy("h", "k"))
    last = near.withColumn("r", rank).where(F.col("r") == F.col("need")).select("fold", "h", "k").collect()
    cuts = {r["fold"]: (r["h"], r["k"]) for r in last}
    done = [Fold(f.fold, f.n_test, f.n_rest, f.n_val, *cuts.get(f.fold, (None, None))) for f in folds]
    return FoldPlan(done, types["g"], types["k"], seed)


def constant(rows: list[dict], fields: str) -> Column:
    """Rows of a small list as one constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def count_prefixes(ids: DataFrame, length: int) -> DataFrame:
    counts = ids.groupBy("g", F.substring("h", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counts.persist(StorageLevel.MEMORY_AND_DISK)


def find_borders(counts: DataFrame, borders: list[dict], length: int, group_type: str) -> list[dict]:
    """The longer prefix in which each fold reaches its quota, with what is still needed there.

    Rows of a prefix outside a fold's own group = all rows of it minus the group's.
    """
    old = constant(borders, f"fold: {group_type}, p: string, need: bigint")
    old = F.transform(old, lambda b: F.struct(b["fold"].alias("fold"), b["p"].alias("p0"), b["need"].alias("quota")))
    everywhere = counts.groupBy("p").agg(F.sum("n").alias("n_all")).select("p", "n_all", F.inline(old))
    everywhere = everywhere.where(F.substring("p", 1, length - STEP) == F.col("p0"))
    own = counts.select(F.col("g").alias("fold"), "p", F.col("n").alias("n_own"))
    rest = everywhere.join(own, ["fold", "p"], "left").withColumn("n", F.col("n_all") - F.coalesce("n_own", F.lit(0)))
    upto = Window.partitionBy("fold").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        rest.withColumn("cum", F.sum("n").over(upto))
        .where((F.col("cum") >= F.col("quota")) & (F.col("cum") - F.col("n") < F.col("quota")))
        .select("fold", "p", (F.col("quota") - F.col("cum") + F.col("n")).alias("need"), F.col("n").alias("size"))
    )
    return [r.asDict() for r in border.collect()]


def split_of(fold: Column, group: Column, h: Column, key: Column, cut_hash: Column, cut_key: Column) -> Column:
    inside = (h < cut_hash) | ((h == cut_hash) & (key <= cut_key))
    return F.when(group.eqNullSafe(fold), "test").when(inside, "val").otherwise("train")


def expand_folds(cells: DataFrame, plan: FoldPlan, key: str = "cell_id", group: str = "donor") -> DataFrame:
    """Every cell once per fold with its ``fold`` and ``split``: a narrow step, no join, no shuffle."""
    hashed = cells.withColumn("_h", order_key(key, plan.seed))
    wide = hashed.select("*", F.inline(plan.column()))
    split = split_of(
        F.col("fold"), F.col(group), F.col("_h"), F.col(key), F.col("cut_hash"), F.col("cut_key")
    )
    return wide.withColumn("split", split).drop("_h", "cut_hash", "cut_key")


def membership(cells: DataFrame, plan: FoldPlan, key: str = "cell_id", group: str = "donor") -> DataFrame:
    """Each cell once, with ``train_folds`` and ``val_folds``, the folds it serves in.

    Its test fold is its own group. Use this instead of ``expand_folds`` where the
    vectors would be copied once per fold.
    """
    hashed = cells.withColumn("_h", order_key(key, plan.seed))

    def serving(split: str) -> Column:
        def is_in(f):
            return split_of(f["fold"], F.col(group), F.col("_h"), F.col(key), f["cut_hash"], f["cut_key"]) == split

        return F.transform(F.filter(plan.column(), is_in), lambda f: f["fold"].cast("bigint"))

    out = hashed.withColumn("train_folds", serving("train")).withColumn("val_folds", serving("val"))
    return out.drop("_h")


def hash_split(key: str = "cell_id", percent: int = 20, seed: int = 42) -> Column:
    """True for about ``percent`` % of the ids; needs no pass over the data."""
    bucket = F.conv(F.substring(order_key(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return bucket < percent


def split_sizes(expanded: DataFrame, label: str = "y") -> DataFrame:
    return expanded.groupBy("fold", "split", label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(sizes: DataFrame, n_classes: int, label: str = "y") -> DataFrame:
    """Train count, share and inverse-frequency weight N / n_c for each fold and class.

    Takes the small output of ``split_sizes``. A class without training rows has
    weight NULL.
    """
    folds = sizes.select("fold").distinct()
    grid = folds.select("fold", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias(label))
    train = sizes.where(F.col("split") == "train").select("fold", label, "n")
    filled = grid.join(train, ["fold", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy("fold"))
    return filled.select(
        "fold",
        label,
        "n",
        F.try_divide(F.col("n"), whole).alias("frequency"),
        F.try_divide(whole, F.col("n")).alias("weight"),
    )


def batch_id(key: str, epoch: Column, n_batches: Column) -> Column:
    """Shuffled mini-batch of a row in an epoch: a seeded hash, no sort."""
    h = F.md5(F.concat_ws(":", epoch.cast("string"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n_batches


def assign_batches(expanded: DataFrame, batch_size: int, epochs: int, key: str = "cell_id") -> DataFrame:
    """Train rows of each epoch with a batch number below ceil(n_train / batch_size)."""
    train = expanded.where(F.col("split") == "train")
    sizes = train.groupBy("fold").agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("n_batches"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("fold", "n_batches")))).scalar()
    rows = train.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return rows.withColumn("batch", batch_id(key, F.col("epoch"), F.element_at(table, F.col("fold"))))
