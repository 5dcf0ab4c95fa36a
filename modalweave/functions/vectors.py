"""Column functions on numbers and ``ARRAY<DOUBLE>`` vectors. All run in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda body evaluates everything it mentions once per element, so a vector
    total used inside ``transform`` has to be bound first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(vec: Column) -> Column:
    return F.aggregate(vec, _zero(), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sigmoid_each(vec: Column) -> Column:
    return F.transform(vec, sigmoid)


def relu(x: Column) -> Column:
    return F.greatest(x, _zero())


def relu_each(vec: Column) -> Column:
    return F.transform(vec, relu)


def scale(vec: Column, factor) -> Column:
    """Vector times a constant or a per-row number."""
    if not isinstance(factor, Column):
        return F.transform(vec, lambda x: x * F.lit(float(factor)))
    return let(F.struct(vec.alias("v"), factor.alias("f")), lambda t: F.transform(t["v"], lambda x: x * t["f"]))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def add(a: Column, b: Column) -> Column:
    """Element-wise sum (residual connection)."""
    return F.zip_with(a, b, lambda x, y: x + y)


def concat_views(views: list[Column], weights=None) -> Column:
    """Concatenate modality vectors, each times its constant weight."""
    if weights is None:
        return F.concat(*views)
    return F.concat(*[v if w == 1 else scale(v, w) for v, w in zip(views, weights, strict=True)])


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def softmax(z: Column) -> Column:
    def shifted(t):
        return F.transform(t["z"], lambda x: F.exp(x - t["m"]))

    def normalised(e):
        return let(
            F.struct(e.alias("e"), total(e).alias("s")),
            lambda t: F.transform(t["e"], lambda x: x / t["s"]),
        )

    return let(let(F.struct(z.alias("z"), F.array_max(z).alias("m")), shifted), normalised)


def logsumexp(z: Column) -> Column:
    return let(
        F.struct(z.alias("z"), F.array_max(z).alias("m")),
        lambda t: t["m"] + F.ln(total(F.transform(t["z"], lambda x: F.exp(x - t["m"])))),
    )


def pick(vec: Column, index: Column) -> Column:
    """Value at a zero-based position, NULL outside the vector (gather)."""
    return F.get(vec, index.cast("int"))


def cross_entropy(z: Column, y: Column, weight: Column | None = None) -> Column:
    """Row loss of a logit vector; optionally times the weight of the true class."""
    loss = logsumexp(z) - pick(z, y)
    return loss if weight is None else weight * loss


def one_hot(y: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (k == y).cast("double"))


def argmax(vec: Column) -> Column:
    """Zero-based position of the largest value; the first one wins ties."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    def centred(t):
        return F.transform(t["v"], lambda x: x - t["mu"])

    def scaled(c):
        inv = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + F.lit(eps))
        return let(
            F.struct(c.alias("c"), inv.alias("sd")), lambda t: F.transform(t["c"], lambda x: x / t["sd"])
        )

    return let(let(F.struct(vec.alias("v"), (total(vec) / F.size(vec)).alias("mu")), centred), scaled)


def fourier_encode(p: Column, bands: int, max_freq: float) -> Column:
    """``2 * bands + 1`` position features of a number in [-1, 1]: sines, cosines, itself."""
    top = max_freq / 2
    step = (top - 1.0) / (bands - 1) if bands > 1 else 0.0
    freqs = [math.pi * (1.0 + k * step) for k in range(bands)]
    return F.array(*[F.sin(p * F.lit(f)) for f in freqs], *[F.cos(p * F.lit(f)) for f in freqs], p)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def fill_like(vec: Column, value: float) -> Column:
    """A constant vector of the same length (a masked modality)."""
    return F.array_repeat(F.lit(float(value)), F.size(vec))


def mask_modality(vec: Column, split: Column, value: float = 0.5, on_split: str = "test") -> Column:
    return F.when(split == on_split, fill_like(vec, value)).otherwise(vec)


def affine(vec: Column, rows: list[list[float]], bias: list[float]) -> Column:
    """Small dense layer with literal weights, one dot product per output.

    The expression is part of the plan: use it for narrow layers and the scorer
    in ``operators.fusion`` for wide ones.
    """
    outs = [
        dot(vec, F.lit([float(v) for v in r])) + F.lit(float(b)) for r, b in zip(rows, bias, strict=True)
    ]
    return F.array(*outs)


def unfold(df: DataFrame, keys: list, vector, name: str) -> DataFrame:
    """One row per vector element: ``(keys.., idx, name)``.

    The outer form is used on purpose: for the inner form Spark adds a filter on the
    size of the vector and evaluates an expensive vector expression twice.
    """
    return df.select(*keys, F.posexplode_outer(vector).alias("idx", name)).where(F.col("idx").isNotNull())
