"""Feature importance: mean gates, named features, top and bottom lists."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_vector(df: DataFrame, by: list[str], vector: str, name: str = "mean") -> DataFrame:
    """Element-wise mean of the vectors of a group.

    The summarizer keeps one partial vector per task, so a group of any size costs
    one vector per task in the shuffle; exploding would cost one row per element.
    """
    return df.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(name)
    )


def mean_importance(gates: DataFrame, by: list[str], vector: str = "gate") -> DataFrame:
    """``(by.., idx, importance)``: the mean gate of every feature."""
    means = mean_vector(gates, by, vector)
    return means.select(*by, F.posexplode("mean").alias("idx", "importance"))


def ranked(importance: DataFrame, by: list[str], k: int = 10, largest: bool = True) -> DataFrame:
    """The k most (or least) important features of a group; the lower index wins ties.

    The input has one row per feature, its size is the width of the modality.
    """
    order = F.col("importance").desc() if largest else F.col("importance").asc()
    w = Window.partitionBy(*by).orderBy(order, "idx")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def extremes(importance: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k most and the k least important features of a group (``side`` top or bottom), in one pass."""
    sides = []
    for side, order in (("top", F.col("importance").desc()), ("bottom", F.col("importance").asc())):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order, "idx"))
        sides.append(F.struct(F.lit(side).alias("side"), place.alias("rank")))
    placed = importance.withColumn("_sides", F.array(*sides))
    return placed.select(*importance.columns, F.inline("_sides")).where(F.col("rank") <= k)


def gate_penalty(gates: DataFrame, by: list[str], vector: str = "gate") -> DataFrame:
    """Mean gate over rows and features (the sparsity penalty)."""
    size = F.size(vector)
    row_sum = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return gates.groupBy(*by).agg((F.sum(row_sum) / F.sum(size)).alias("gate_mean"))
