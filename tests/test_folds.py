import math
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from modalweave.operators import folds as FO


def cells(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, donor int, y int")


def brute(rows, fraction=0.2, seed=42):
    """Split of every (fold, id) by ranking all training ids of a fold."""
    out = {}
    for fold in {d for _, d, _ in rows if d is not None}:
        rest = sorted((md5(f"{seed}:{k}".encode()).hexdigest(), k) for k, d, _ in rows if d != fold)
        val = {k for _, k in rest[: math.ceil(fraction * len(rest))]}
        for k, d, _ in rows:
            out[fold, k] = "test" if d == fold else "val" if k in val else "train"
    return out


def sample(n, donors, hot=0.0):
    return [(f"c{i}", 0 if i < hot * n else i % donors, i % 4) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        sample(500, 3),
        sample(400, 7, hot=0.4),
        sample(11, 2),
        sample(60, 3) + [("n1", None, 0), ("n2", None, 1)],
        [("only", 5, 1)],
    ],
)
def test_split_equals_full_ranking(spark, rows):
    df = cells(spark, rows)
    got = FO.expand_folds(df, FO.fold_plan(df)).select("fold", "cell_id", "split").collect()
    assert {(r[0], r[1]): r[2] for r in got} == brute(rows)


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_validation_size_is_exact(spark, fraction):
    df = cells(spark, sample(333, 3))
    plan = FO.fold_plan(df, fraction=fraction)
    sizes = FO.expand_folds(df, plan).groupBy("fold", "split").count().collect()
    n = {(r["fold"], r["split"]): r["count"] for r in sizes}
    for f in plan.folds:
        assert n.get((f.fold, "val"), 0) == math.ceil(fraction * f.n_rest) == f.n_val


@pytest.mark.parametrize("ranked", [0, 1, 3])
def test_longer_prefixes_give_the_same_plan(spark, monkeypatch, ranked):
    df = cells(spark, sample(2000, 3))
    monkeypatch.setattr(FO, "STEP", 1)
    short = FO.fold_plan(df)
    monkeypatch.setattr(FO, "RANKED", ranked)
    assert FO.fold_plan(df) == short


def test_plan_does_not_depend_on_row_order_or_partitions(spark):
    rows = sample(200, 3)
    a = FO.fold_plan(cells(spark, rows))
    b = FO.fold_plan(cells(spark, rows[::-1]).repartition(7))
    assert a == b
    assert a != FO.fold_plan(cells(spark, rows), seed=7)


def test_plan_table_and_numeric_keys(spark):
    df = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("donor"))
    plan = FO.fold_plan(df)
    rows = plan.table(spark).orderBy("fold").collect()
    assert [(r["fold"], r["n_test"], r["n_rest"], r["n_val"]) for r in rows] == [(0, 50, 50, 10), (1, 50, 50, 10)]


def test_membership_equals_expansion(spark):
    rows = sample(150, 4) + [("null", None, 0)]
    df = cells(spark, rows)
    plan = FO.fold_plan(df)
    expected = FO.expand_folds(df, plan).select("cell_id", "fold", "split").collect()
    got = FO.membership(df, plan).collect()
    for r in got:
        mine = {x["fold"]: x["split"] for x in expected if x["cell_id"] == r["cell_id"]}
        assert sorted(r["train_folds"]) == sorted(f for f, s in mine.items() if s == "train")
        assert sorted(r["val_folds"]) == sorted(f for f, s in mine.items() if s == "val")


def test_class_weight_of_an_absent_class_is_null(spark):
    sizes = spark.createDataFrame([(0, "train", 0, 6), (0, "train", 2, 2), (0, "val", 1, 9)], "fold int, split string, y int, n long")
    rows = {r["y"]: r for r in FO.class_weights(sizes, 3).collect()}
    assert rows[1]["weight"] is None and rows[1]["n"] == 0
    assert rows[0]["weight"] == pytest.approx(8 / 6) and rows[2]["frequency"] == pytest.approx(0.25)


def test_batches_cover_the_train_rows(spark):
    df = cells(spark, sample(200, 2))
    expanded = FO.expand_folds(df, FO.fold_plan(df))
    rows = FO.assign_batches(expanded, batch_size=16, epochs=2).collect()
    train = expanded.where("split = 'train'").count()
    assert len(rows) == 2 * train
    assert {r["batch"] for r in rows} <= set(range(math.ceil(80 / 16)))
    first = {(r["fold"], r["cell_id"]): r["batch"] for r in rows if r["epoch"] == 1}
    second = {(r["fold"], r["cell_id"]): r["batch"] for r in rows if r["epoch"] == 2}
    assert first != second


def test_hash_split_share(spark):
    df = spark.range(5000).withColumnRenamed("id", "cell_id")
    share = df.agg(F.avg(FO.hash_split().cast("int"))).first()[0]
    assert 0.17 < share < 0.23
