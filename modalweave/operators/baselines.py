"""Early-fusion classifiers, one fit per leave-one-group-out fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.config import Config
from modalweave.operators import folds as FO
from modalweave.operators import kernel as K
from modalweave.operators import metrics as M
from modalweave.operators.fusion import score
from modalweave.operators.neighbours import k_nearest_of_others, majority
from modalweave.operators.training import train
from modalweave.sources.sinks import durable

# A baseline takes cells (cell_id, donor, y, features) and gives (fold, cell_id, y_true, y_pred).
Baseline = Callable[[DataFrame], DataFrame]
PARALLEL_FITS = 4
FIT_ROWS = 4096  # rows in a task of a fit, from which on more tasks are made while cores are free


def fold_ids(cells: DataFrame, group: str = "donor") -> list[int]:
    """The folds of the run: one number per donor, each of which is a fit of its own."""
    return [r[0] for r in FO.fold_list(cells, group).collect()]


def dealt(cells: DataFrame) -> DataFrame:
    """Cells in a task per core, or FIT_ROWS each if that makes fewer: a fit reads a few bytes often, and files are cut by bytes."""
    tasks = min(cells.count() // FIT_ROWS + 1, cells.sparkSession.sparkContext.defaultParallelism)
    if cells.rdd.getNumPartitions() >= tasks:
        return cells
    return durable(cells.repartition(tasks, "cell_id").sortWithinPartitions("cell_id"), "dealt")


def per_fold(cells: DataFrame, fit_predict) -> DataFrame:
    """``fit_predict(train, test)`` for every fold, the predictions put together.

    The fits are independent series of Spark jobs, so a few of them run side by side.
    """
    cells = dealt(durable(cells, "cells"))

    def one(fold: int) -> DataFrame:
        mine = F.col("donor").eqNullSafe(F.lit(fold))
        part = fit_predict(cells.where(~mine), cells.where(mine))
        return part.select(
            F.lit(fold).cast("bigint").alias("fold"),
            "cell_id",
            F.col("y").cast("int").alias("y_true"),
            F.col("prediction").cast("int").alias("y_pred"),
        )

    with ThreadPool(PARALLEL_FITS) as pool:
        parts = pool.map(inheritable_thread_target(cells.sparkSession)(one), fold_ids(cells))
    return reduce(DataFrame.unionByName, parts)


def _as_vectors(df: DataFrame) -> DataFrame:
    return df.select("cell_id", F.col("y").cast("double").alias("y"), array_to_vector("features").alias("features"))


def logistic_regression(cells: DataFrame, c: float = 1.0, max_iter: int = 100, standardize: bool = False):
    """Multinomial, L2 penalty of inverse strength ``c`` on the sum of the row losses."""

    def fit_predict(train_rows, test_rows):
        rows = _as_vectors(train_rows)
        model = LogisticRegression(
            featuresCol="features",
            labelCol="y",
            family="multinomial",
            regParam=1.0 / (c * max(1, rows.count())),
            elasticNetParam=0.0,
            standardization=standardize,
            maxIter=max_iter,
            tol=1e-4,
        ).fit(rows)
        return model.transform(_as_vectors(test_rows))

    return per_fold(cells, fit_predict)


def random_forest(cells: DataFrame, trees: int = 100, max_depth: int = 30, seed: int = 42) -> DataFrame:
    def fit_predict(train_rows, test_rows):
        model = RandomForestClassifier(
            featuresCol="features",
            labelCol="y",
            numTrees=trees,
            impurity="gini",
            featureSubsetStrategy="sqrt",
            maxDepth=max_depth,
            seed=seed,
            cacheNodeIds=True,  # else every pass sends the trees to the tasks and walks them from the root
        ).fit(_as_vectors(train_rows))
        return model.transform(_as_vectors(test_rows))

    return per_fold(cells, fit_predict)


def kernel_scale(df: DataFrame) -> tuple[int, float]:
    """Width and the RBF factor ``1 / (width * variance of all feature values)``."""

    def plus(f):
        return F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + f(x)))

    n, s, s2, d = df.agg(
        F.sum(F.size("features")), plus(lambda x: x), plus(lambda x: x * x), F.max(F.size("features"))
    ).first()
    variance = s2 / n - (s / n) ** 2
    return d, 1.0 / (d * variance) if variance > 0 else 1.0


def rbf_svm(
    cells: DataFrame,
    c: float = 1.0,
    error: float = 0.05,
    max_landmarks: int = 1024,
    max_iter: int = 200,
    tol: float = 1e-3,
    reports: dict[int, K.Report] | None = None,
) -> DataFrame:
    """Support vectors with a radial basis kernel, one machine for each pair of classes, the class of most votes.

    ``error`` bounds what the kernel's features may miss; where ``max_landmarks`` don't reach it, or a pair takes more
    than ``max_iter`` steps, a warning says so. ``reports`` takes what was reached for each fold.
    """

    def fit_predict(train_rows, test_rows):
        width, gamma = kernel_scale(train_rows.select("features"))
        rows = train_rows.select(F.col("y").cast("int").alias("y"), "features").persist()
        machine = K.fit_pairs(rows, gamma, width, c, error, max_landmarks, max_iter, tol)
        rows.unpersist()
        if reports is not None:
            reports[int(test_rows.select("donor").first()[0])] = machine.report
        return K.predict(test_rows.select("cell_id", F.col("y").cast("int").alias("y"), "features"), machine)

    return per_fold(cells, fit_predict)


def group_sides(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test rows under their own fold, and the rows of all other donors under each fold."""
    cells = durable(cells, "cells")
    ids = fold_ids(cells)
    test = cells.where(F.col("donor").isNotNull()).withColumn("fold", F.col("donor").cast("bigint"))
    every = F.array(*[F.lit(f).cast("bigint") for f in ids])
    others = F.filter(every, lambda f: ~F.col("donor").eqNullSafe(f))
    return test, cells.withColumn("fold", F.explode(others))


def k_neighbours(cells: DataFrame, k: int = 5) -> DataFrame:
    """Every cell against the cells of all other donors; all folds in one search."""
    cells = durable(cells, "cells")
    test = cells.where(F.col("donor").isNotNull())
    truth = test.select(F.col("donor").cast("bigint").alias("fold"), "cell_id", F.col("y").cast("int").alias("y_true"))
    near = k_nearest_of_others(cells.withColumn("donor", F.col("donor").cast("bigint")), k)
    return truth.join(majority(near), ["fold", "cell_id"])


def dense_net(
    cells: DataFrame, cfg: Config | None = None, n_classes: int | None = None, batch_size: int = 32
) -> DataFrame:
    """One hidden layer of 128, Adam, 10 epochs; a fifth of the train cells is held out.

    ``n_classes`` is read off the labels when not given.
    """
    cells = durable(cells, "cells")
    width, top = cells.agg(F.max(F.size("features")), F.max("y")).first()
    cfg = cfg or Config(
        modalities=("features",),
        hidden_dims=(128,),
        model="static",
        dropout=0.0,
        epochs=10,
        batch_size=batch_size,
        learning_rate=1e-3,
        weight_decay=0.0,
        class_weighted=False,
        keep="last",
        classes={str(i): i for i in range(n_classes or int(top) + 1)},
    )
    member = FO.membership(cells, FO.fold_plan(cells, fraction=cfg.val_fraction, seed=cfg.seed))
    fit = train(member, fold_ids(cells), {"features": width}, cfg)
    test = cells.where(F.col("donor").isNotNull()).withColumn("fold", F.col("donor").cast("bigint"))
    scored = M.with_prediction(score(test, fit.models, cfg, ["fold", "cell_id", "y"]))
    return scored.select("fold", "cell_id", F.col("y").cast("int").alias("y_true"), "y_pred")


BASELINES: dict[str, Baseline] = {
    "NN": dense_net,
    "LR": logistic_regression,
    "KNN": k_neighbours,
    "SVM": rbf_svm,
    "RF": random_forest,
}


def run_baselines(cells: DataFrame, names=tuple(BASELINES)) -> DataFrame:
    """Predictions of all chosen baselines with a ``model`` column."""
    parts = [BASELINES[n](cells).withColumn("model", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)
