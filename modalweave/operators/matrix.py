"""Vector times matrix and outer products as table operators."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.functions import vectors as V
from modalweave.operators.skew import broadcast_if_small


def linear_rows(df: DataFrame, weights: list[list[float]], bias: list[float], vector: str = "features") -> DataFrame:
    """``out = W x + b`` inside each row: no shuffle."""
    return df.withColumn("out", V.affine(F.col(vector), weights, bias))


def linear_join(df: DataFrame, weights: DataFrame, n_out: int, key: str = "cell_id", vector: str = "features"):
    """``W x + b`` for weights kept in a table ``(i, w)``: ``w`` holds the outputs of input ``i``.

    Row -1 holds the bias. The outputs are summed side by side, so a cell gives one
    row per input, and all of them are summed in the task that unfolded the vector.
    """
    long = V.unfold(df, [key], F.concat(F.array(F.lit(1.0)), F.col(vector)), "x")
    terms = long.select(key, (F.col("idx") - 1).alias("i"), "x").join(broadcast_if_small(weights), "i")
    return terms.groupBy(key).agg(
        *[F.sum(F.col("x") * F.col("w")[j]).alias(f"out{j}") for j in range(n_out)]
    )


def outer_product(a: Column, b: Column) -> Column:
    """All products ``a_i * b_j`` of one row, ``j`` running fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def sum_vectors(df: DataFrame, by: list[str], vector: Column, name: str = "total") -> DataFrame:
    """Element-wise sum per group with one partial vector per task."""
    total = vector_to_array(Summarizer.sum(array_to_vector(vector))).alias(name)
    return df.groupBy(*by).agg(total, F.count(F.lit(1)).alias("n"))


def softmax_gradient(df: DataFrame, logits: Column, by: list[str], n_classes: int, weight: Column | None = None):
    """Gradient of the mean cross-entropy by the weights of a linear softmax layer.

    ``(by.., i, j, gradient)``: input i, class j. Row gradients are outer products,
    summed per task and then per group.
    """
    err = F.zip_with(V.softmax(logits), V.one_hot(F.col("y"), n_classes), lambda p, t: p - t)
    if weight is not None:
        err = V.scale(err, weight)
    grads = sum_vectors(df.withColumn("_e", err), by, outer_product(F.col("features"), F.col("_e")))
    long = grads.select(*by, "n", F.posexplode("total").alias("pos", "g"))
    return long.select(
        *by,
        F.floor(F.col("pos") / n_classes).cast("int").alias("i"),
        (F.col("pos") % n_classes).alias("j"),
        (F.col("g") / F.col("n")).alias("gradient"),
    )
