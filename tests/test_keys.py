import pytest
from pyspark.sql import functions as F

from modalweave.operators import keys as K
from modalweave.operators import skew
from modalweave.operators.skew import hot_hashes, hot_keys, running_sum, salted_join, softmax_sums, softmax_weights


def test_keep_first_takes_the_first_by_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", 1), (2, "z", 9)], "k int, v string, o int")
    assert {tuple(r) for r in K.keep_first(df, ["k"], ["o"]).collect()} == {(1, "c", 1), (2, "z", 9)}
    assert {tuple(r) for r in K.keep_first(df, ["k"]).collect()} == {(1, "a", 3), (2, "z", 9)}
    assert K.keep_first(df.select("k"), ["k"]).count() == 2


def test_copies_of_a_key_do_not_multiply(spark):
    meta = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "cell_id string, donor int")
    mod = spark.createDataFrame([("a", [1.0])] * 40 + [("c", [2.0])], "cell_id string, features array<double>")
    assert [tuple(r) for r in K.join_modality(meta, mod).collect()] == [("a", 1, [1.0])]


def test_missing_modalities(spark):
    meta = spark.createDataFrame([("a", 1), ("b", 2)], "cell_id string, donor int")
    x = spark.createDataFrame([("a", [1.0])], "cell_id string, features array<double>")
    y = spark.createDataFrame([("a", [2.0]), ("b", [3.0])], "cell_id string, features array<double>")
    assert [r["cell_id"] for r in K.align(meta, {"x": x, "y": y}).collect()] == ["a"]
    kept = {r["cell_id"]: r for r in K.align(meta, {"x": x, "y": y}, missing="keep").collect()}
    assert kept["b"]["has_x"] is False and kept["b"]["has_y"] is True and kept["b"]["x"] is None
    assert K.early_fusion(meta, {"x": x, "y": y}).first()["features"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        K.align(meta, {"x": x}, missing="maybe")


def test_null_safe_join_matches_null_keys(spark):
    a = spark.createDataFrame([("a", None, 1), ("b", 2, 2)], "k string, g int, u int")
    b = spark.createDataFrame([("a", None, 5), ("b", 3, 6)], "k string, g int, w int")
    assert [tuple(r) for r in K.join_null_safe(a, b, ["k", "g"]).collect()] == [("a", None, 1, 5)]


def test_labels_outside_the_map_are_null_then_rejected(spark):
    df = spark.createDataFrame([("BP",), ("??",), (None,)], "cell_type string")
    mapped = K.map_label(df, {"BP": 0, "MoP": 2})
    assert [r["y"] for r in mapped.collect()] == [0, None, None]
    assert K.reject_unlabelled(mapped).count() == 1


def test_select_modalities():
    assert list(K.select_modalities({"a": 1, "b": 2}, ["b"])) == ["b"]
    with pytest.raises(ValueError):
        K.select_modalities({"a": 1}, ["c"])


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to key 0."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 17).alias("v")
    )


def test_hot_keys_are_few_and_right(skewed):
    hot = {r["k"]: r["_salts"] for r in hot_keys(skewed, ["k"]).collect()}
    assert set(hot) == {0} and 150 < hot[0] < 200


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    a = salted_join(skewed, small, ["k"], how).select("id", "k", "v", "w")
    b = skewed.join(small, "k", how).select("id", "k", "v", "w")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_summary_finds_the_hot_keys(spark, skewed, monkeypatch):
    assert [150 < r["_salts"] < 200 for r in hot_hashes(skewed, ["k"]).collect()] == [True]
    # More keys than a summary tracks: the frequent ones are still there.
    monkeypatch.setattr(skew, "TRACKED", 1024)
    many = spark.range(60_000, numPartitions=5).select((F.when(F.col("id") % 10 < 3, -1).otherwise(F.col("id"))).alias("k"))
    hot = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long")).alias("h")).first()["h"]
    found = {r["_hash"]: r["_salts"] for r in hot_hashes(many, ["k"]).collect()}
    assert hot in found and found[hot] >= 153 and len(found) <= skew.HOT_SHARE
    assert hot_hashes(many.where("k = 1"), ["k"]).count() <= 1 and hot_hashes(many.where("k = -2"), ["k"]).count() == 0


def test_equal_rows_of_a_hot_key_are_split(spark):
    big = spark.range(8000, numPartitions=8).select(F.lit("a").alias("k"), F.lit(None).cast("int").alias("g"), F.lit(1).alias("v"))
    small = spark.createDataFrame([("a", None, 5), ("b", 1, 6)], "k string, g int, w int")
    joined = salted_join(big.drop("g"), small.drop("g"), ["k"])
    assert joined.count() == 8000 and joined.distinct().collect()[0]["w"] == 5
    spread = big.withColumn("s", F.pmod(F.xxhash64("v", F.spark_partition_id()), F.lit(64))).select("s").distinct().count()
    assert spread > 4
    none = salted_join(big, small, ["k", "g"], "left")
    assert none.count() == 8000 and none.where("w IS NOT NULL").count() == 0


def test_weights_of_tokens_take_few_passes(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("s"))
    df.write.parquet(str(tmp_path / "t"))
    plan = softmax_weights(spark.read.parquet(str(tmp_path / "t")), ["g"], F.col("s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 5 and plan.count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("width", [1, 7, 65536])
def test_running_sum(spark, width):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"), F.sin(F.col("id").cast("double")).alias("v"))
    got = running_sum(df, ["g"], "t", F.col("v"), "s", width).orderBy("g", "t").collect()
    total = {}
    for r in got:
        total[r["g"]] = total.get(r["g"], 0.0) + r["v"]
        assert r["s"] == pytest.approx(total[r["g"]], abs=1e-12)


@pytest.mark.parametrize("scale", [1.0, 300.0, 5000.0])
def test_softmax_is_stable_for_any_score(spark, scale):
    import math

    rows = [(g, i, scale * math.sin(7 * i + g), float(i)) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, s double, v double")
    pooled = {r["g"]: r["v"] for r in softmax_sums(df, ["g"], F.col("s"), {"v": F.col("v")}).collect()}
    weights = {(r["g"], r["i"]): r["weight"] for r in softmax_weights(df, ["g"], F.col("s")).collect()}
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        top = max(r[2] for r in mine)
        norm = sum(math.exp(r[2] - top) for r in mine)
        assert pooled[g] == pytest.approx(sum(math.exp(r[2] - top) / norm * r[3] for r in mine), rel=1e-9)
        for r in mine:
            assert weights[g, r[1]] == pytest.approx(math.exp(r[2] - top) / norm, rel=1e-9, abs=1e-300)
