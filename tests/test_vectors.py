import math

import pytest
from pyspark.sql import functions as F

from modalweave.functions import vectors as V
from modalweave.operators import matrix as X


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([([1.0, -2.0, 3.0], [0.5, 0.25, -1.0], 2)], "a array<double>, b array<double>, y int")


def one(row, expr):
    return row.select(expr.alias("x")).first()["x"]


def test_basic_functions(row):
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    assert one(row, V.relu_each(a)) == [1.0, 0.0, 3.0]
    assert one(row, V.dot(a, b)) == pytest.approx(-3.0)
    assert one(row, V.multiply(a, b)) == [0.5, -0.5, -3.0]
    assert one(row, V.add(a, b)) == [1.5, -1.75, 2.0]
    assert one(row, V.scale(a, 2)) == [2.0, -4.0, 6.0]
    assert one(row, V.scale(a, F.col("y").cast("double"))) == [2.0, -4.0, 6.0]
    assert one(row, V.concat_views([a, b], [1, 2])) == [1.0, -2.0, 3.0, 1.0, 0.5, -2.0]
    assert one(row, V.one_hot(y, 4)) == [0.0, 0.0, 1.0, 0.0]
    assert one(row, V.pick(a, y)) == 3.0
    assert one(row, V.pick(a, F.lit(9))) is None
    assert one(row, V.fill_like(a, 0.5)) == [0.5, 0.5, 0.5]
    assert one(row, V.euclidean(a, b)) == pytest.approx(math.sqrt(0.25 + 2.25**2 + 16))
    assert one(row, V.affine(a, [[1, 0, 1], [0, 1, 0]], [10, 20])) == [14.0, 18.0]
    assert one(row, X.outer_product(a, b))[:4] == [0.5, 0.25, -1.0, -1.0]


def test_softmax_and_loss(row, spark):
    p = one(row, V.softmax(F.col("a")))
    assert sum(p) == pytest.approx(1.0)
    loss = one(row, V.cross_entropy(F.col("a"), F.col("y"), F.lit(2.0)))
    assert loss == pytest.approx(-2 * math.log(p[2]))
    far = spark.createDataFrame([([800.0, -800.0],)], "a array<double>")
    assert one(far, V.softmax(F.col("a"))) == [1.0, 0.0]
    assert one(far, V.sigmoid_each(F.col("a"))) == [1.0, 0.0]
    assert one(far, V.logsumexp(F.col("a"))) == 800.0


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert one(df, V.argmax(F.col("p"))) == 0


def test_layer_norm(row):
    n = one(row, V.layer_norm(F.col("a")))
    assert sum(n) == pytest.approx(0.0, abs=1e-12)
    assert sum(x * x for x in n) / 3 == pytest.approx(1.0, abs=1e-4)


def test_fourier_of_zero_is_constant(spark):
    df = spark.createDataFrame([(0.0,)], "p double")
    assert one(df, V.fourier_encode(F.col("p"), bands=2, max_freq=2.0)) == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_mask_only_the_test_split(spark):
    df = spark.createDataFrame([([1.0, 2.0], "test"), ([1.0, 2.0], "train")], "v array<double>, split string")
    got = df.select(V.mask_modality(F.col("v"), F.col("split")).alias("m")).collect()
    assert [r["m"] for r in got] == [[0.5, 0.5], [1.0, 2.0]]


def test_unfold_does_not_evaluate_the_vector_twice(spark):
    df = spark.createDataFrame([(1, "abc")], "k int, t string")
    vec = F.array(F.length(F.regexp_replace("t", "[^a]+", "")).cast("double"), F.lit(2.0))
    plan = V.unfold(df.select("k", vec.alias("v")), ["k"], "v", "x")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace") == 1
    assert [(r["idx"], r["x"]) for r in plan.collect()] == [(0, 1.0), (1, 2.0)]
