"""Classification metrics. Rows are read once, into a confusion table of K x K rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["f1", "f1_macro", "recall", "precision", "accuracy", "balanced_accuracy"]


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    """Counts ``(by.., y_true, y_pred, n)`` of the pairs that occur."""
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(counts: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """The counts on the full class x class grid, 0 where a pair does not occur.

    Pairs outside the grid (a NULL label, a class of ``n_classes`` or more) stay, in the groups
    that have them, so a matrix sums to its rows. The groups are read off the counts with their
    totals, so both parts of the union share one exchange and the rows are counted once.
    """
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_rows")).where(F.col("_rows") > 0).select(*by)
    grid = groups.withColumn("y_true", F.explode(ids)).withColumn("y_pred", F.explode(ids))
    every = grid.withColumn("n", F.lit(0).cast("bigint")).unionByName(counts.select(*by, "y_true", "y_pred", "n"))
    return every.groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def per_class(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of every label that is true or predicted; 0/0 counts as 0."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")
        ),
        F.struct(
            F.col("y_pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")
        ),
    )
    sums = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.select(
        "*",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def evaluate(preds: DataFrame, by: list[str]) -> DataFrame:
    """The six metrics per group of ``by``."""
    return metrics_of(per_class(confusion(preds, by), by), by)


def metrics_of(classes: DataFrame, by: list[str]) -> DataFrame:
    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)

    return classes.groupBy(*by).agg(
        weighted("f1"),
        F.avg("f1").alias("f1_macro"),
        weighted("recall"),
        weighted("precision"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def over_folds(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric over the folds."""
    aggs = [F.avg(m).alias(f"{m}_mean") for m in METRICS]
    aggs += [F.stddev_samp(m).alias(f"{m}_sd_samp") for m in METRICS]
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def confusion_over_folds(grid: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise mean and population standard deviation of the fold matrices."""
    return grid.groupBy(*by, "y_true", "y_pred").agg(
        F.avg("n").alias("n_mean"), F.stddev_pop("n").alias("n_sd_pop")
    )


def with_prediction(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Predicted class: the first position of the largest probability."""
    p = F.col(prob)
    return scored.withColumn("y_pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def best_epoch(log: DataFrame, by: list[str], interval: int = 10) -> DataFrame:
    """Earliest epoch with the highest macro F1 above 0, among the evaluated epochs."""
    seen = log.where((F.col("epoch") % interval == 0) & (F.col("f1_macro") > 0))
    best = F.max(F.struct(F.col("f1_macro"), (-F.col("epoch")).alias("minus_epoch")))
    return seen.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.minus_epoch")).alias("epoch"), F.col("b.f1_macro").alias("f1_macro")
    )


def loss_per_epoch(rows: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean over the batches of an epoch of the mean row loss of each batch."""
    batches = rows.groupBy("fold", "epoch", "batch").agg(F.avg(loss).alias("batch_loss"))
    return batches.groupBy("fold", "epoch").agg(
        F.sum("batch_loss").alias("loss_sum"), F.avg("batch_loss").alias("loss_mean")
    )


def result_rows(metrics: DataFrame, model: str) -> DataFrame:
    """Metric columns under their names, with the model in front."""
    others = [c for c in metrics.columns if c not in METRICS and c != "model"]
    return metrics.select(F.lit(model).alias("model"), *others, *METRICS)
