import random
import statistics

import pytest
from pyspark.sql import functions as F

from modalweave.operators import calibration as C
from modalweave.operators import importance as I
from modalweave.operators import metrics as M


def brute(pairs):
    """The six metrics from their definitions."""
    labels = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    n = len(pairs)
    rows = {}
    for c in labels:
        tp = sum(a == c and b == c for a, b in pairs)
        support, predicted = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        p, r = (tp / predicted if predicted else 0.0), (tp / support if support else 0.0)
        rows[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
    return {
        "f1": sum(f * s for _, _, f, s in rows.values()) / n,
        "f1_macro": sum(f for _, _, f, _ in rows.values()) / len(labels),
        "recall": sum(r * s for _, r, _, s in rows.values()) / n,
        "precision": sum(p * s for p, _, _, s in rows.values()) / n,
        "accuracy": sum(a == b for a, b in pairs) / n,
        "balanced_accuracy": statistics.mean(r for _, r, _, s in rows.values() if s),
    }


@pytest.mark.parametrize("true,pred", [(range(4), range(4)), (range(2), range(4)), (range(4), range(1)), ([3], [1])])
def test_metrics(spark, true, pred):
    rnd = random.Random(1)
    pairs = [(rnd.choice(list(true)), rnd.choice(list(pred))) for _ in range(300)]
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "fold int, y_true int, y_pred int")
    row = M.evaluate(df, ["fold"]).first().asDict()
    for name, value in brute(pairs).items():
        assert row[name] == pytest.approx(value), name
    assert row["accuracy"] == pytest.approx(row["recall"])


def test_grid_and_fold_statistics(spark):
    rows = [(0, 0, 0), (0, 0, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1)]
    df = spark.createDataFrame(rows, "fold int, y_true int, y_pred int")
    grid = M.confusion_grid(M.confusion(df, ["fold"]), ["fold"], 3)
    assert grid.count() == 18 and grid.agg(F.sum("n")).first()[0] == 5
    stats = {(r["y_true"], r["y_pred"]): r for r in M.confusion_over_folds(grid, []).collect()}
    assert (stats[1, 1]["n_mean"], stats[1, 1]["n_sd_pop"]) == (1.5, 1.5)
    one = M.over_folds(M.evaluate(df.where("fold = 0"), ["fold"]).withColumn("model", F.lit("m")), ["model"]).first()
    assert one["f1_sd_samp"] is None and one["n_folds"] == 1


def test_labels_outside_the_grid_are_counted(spark):
    rows = [(0, 0, 0), (0, None, 1), (0, 5, 0)]
    df = spark.createDataFrame(rows, "fold int, y_true int, y_pred int")
    grid = M.confusion_grid(M.confusion(df, ["fold"]), ["fold"], 2)
    assert grid.count() == 6 and grid.agg(F.sum("n")).first()[0] == 3


def test_best_epoch_is_the_earliest_of_ties(spark):
    log = spark.createDataFrame(
        [(0, 10, 0.4), (0, 20, 0.6), (0, 30, 0.6), (0, 35, 0.9), (1, 10, 0.0)], "fold int, epoch int, f1_macro double"
    )
    assert [tuple(r) for r in M.best_epoch(log, ["fold"]).collect()] == [(0, 20, 0.6)]


def test_calibration_edges(spark):
    pairs = spark.createDataFrame([(0, 0.0, 0.5), (0, 0.0, 0.25)], "fold int, tcp_true double, tcp_pred double")
    row = C.error_summary(pairs, ["fold"]).first()
    assert row["r2"] is None
    assert row["mape"] == pytest.approx(0.375 / 2.220446049250313e-16)
    shares = C.threshold_shares(pairs, ["fold"]).collect()
    assert len(shares) == 10 and all(r["share"] == 1.0 for r in shares)


def test_threshold_is_strict(spark):
    pairs = spark.createDataFrame([(0, 0.5, 0.25)], "fold int, tcp_true double, tcp_pred double")
    above = {r["step"]: r["n_above"] for r in C.threshold_shares(pairs, ["fold"]).collect()}
    assert above[4] == 1 and above[5] == 0 and above[6] == 0


def test_cumulative_pool(spark):
    df = spark.createDataFrame([("protein", 1), ("rna", 2)], "modality string, v int")
    got = sorted(tuple(r) for r in C.pool_modalities(df, ["protein", "rna"]).select("modality", "v").collect())
    assert got == [("protein", 1), ("rna", 1), ("rna", 2)]


def test_importance_lists(spark):
    rows = [(0, "p", [0.1, 0.9, 0.9, 0.5]), (0, "p", [0.3, 0.7, 0.7, 0.5])]
    df = spark.createDataFrame(rows, "fold int, modality string, gate array<double>")
    means = I.mean_importance(df, ["fold", "modality"])
    top = I.ranked(means, ["fold", "modality"], 2).orderBy("rank").collect()
    assert [(r["idx"], round(r["importance"], 9)) for r in top] == [(1, 0.8), (2, 0.8)]
    low = I.ranked(means, ["fold", "modality"], 1, largest=False).first()
    assert low["idx"] == 0
    assert I.gate_penalty(df, ["fold"]).first()["gate_mean"] == pytest.approx(4.6 / 8)
