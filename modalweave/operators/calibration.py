"""How well the estimated confidence matches the true-class probability (TCP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # machine epsilon, the smallest MAPE denominator


def abs_error() -> Column:
    return F.abs(F.col("tcp_true") - F.col("tcp_pred"))


def error_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One pass over the pairs: means, ranges, MSE, RMSE, MAE, R2, MAPE per group."""
    t, p, err = F.col("tcp_true"), F.col("tcp_pred"), abs_error()
    mse = F.avg(F.pow(t - p, 2))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(t).alias("true_mean"),
        F.min(t).alias("true_min"),
        F.max(t).alias("true_max"),
        F.avg(F.abs(t)).alias("true_abs_mean"),
        F.avg(p).alias("pred_mean"),
        F.min(p).alias("pred_min"),
        F.max(p).alias("pred_max"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(err).alias("mae"),
        F.stddev_pop(err).alias("err_sd_pop"),
        F.max(err).alias("err_max"),
        F.min(err).alias("err_min"),
        (1.0 - F.try_divide(mse, F.var_pop(t))).alias("r2"),
        F.avg(err / F.greatest(F.abs(t), F.lit(EPS))).alias("mape"),
    )


def threshold_shares(pairs: DataFrame, by: list[str], steps: int = 10, digits: int | None = 9) -> DataFrame:
    """Number and share of errors above t * true for t = 1/steps .. 1 (strictly above).

    All thresholds are counted in one aggregate, the group is read once. ``digits``
    rounds both sides of the comparison; None compares the raw doubles.
    """

    def exact(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    err = exact(abs_error())
    above = [
        F.count(F.when(err > exact(F.col("tcp_true") * F.lit(i / steps)), 1)).alias(f"c{i}")
        for i in range(1, steps + 1)
    ]
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *above)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"c{i}").alias("n_above")) for i in range(1, steps + 1)])
    return counts.select(*by, "n", F.inline(rows)).select(
        *by, "step", "n", "n_above", (F.col("n_above") / F.col("n")).alias("share")
    )


def shares_summary(shares: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of the shares per threshold."""
    return shares.groupBy("step").agg(
        F.avg("share").alias("mean"),
        F.stddev_pop("share").alias("sd_pop"),
        F.min("share").alias("min"),
        F.max("share").alias("max"),
    )


def running_summary(shares: DataFrame, fold: str = "fold") -> DataFrame:
    """The same statistics over the folds processed so far.

    ``shares`` has one row per fold, modality and threshold, so a window per
    threshold holds folds x modalities rows. A range frame takes all modalities of a fold.
    """
    w = Window.partitionBy("step").orderBy(fold).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stats = shares.select(
        "step",
        fold,
        F.avg("share").over(w).alias("mean"),
        F.stddev_pop("share").over(w).alias("sd_pop"),
        F.min("share").over(w).alias("min"),
        F.max("share").over(w).alias("max"),
    )
    return stats.distinct()


def pool_modalities(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Pairs of a modality counted again under every later modality of ``order``.

    Reproduces statistics whose lists are not reset between modalities.
    """
    later = {m: order[i:] for i, m in enumerate(order)}
    targets = F.create_map(
        *[x for m, names in later.items() for x in (F.lit(m), F.array(*[F.lit(n) for n in names]))]
    )
    return pairs.withColumn("modality", F.explode(F.try_element_at(targets, F.col("modality"))))
