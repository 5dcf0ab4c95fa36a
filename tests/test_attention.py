import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.operators import attention as A


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.mark.parametrize("block,shared", [(4096, 256), (7, 2)])
def test_co_attention_equals_brute_force(spark, monkeypatch, block, shared):
    """Group 0 holds most tokens; small blocks cut it into many pairs."""
    monkeypatch.setattr(A, "PAIR_ROWS", block)
    monkeypatch.setattr(A, "SHARED_GROUPS", shared)
    rng = np.random.default_rng(0)
    q = [(g, i, [float(v) for v in rng.normal(size=3) * 20]) for g, n in ((0, 40), (1, 3), (2, 5), (3, 1)) for i in range(n)]
    k = [
        (g, i, [float(v) for v in rng.normal(size=3)], [float(v) for v in rng.normal(size=2)])
        for g, n in ((0, 50), (1, 4), (2, 2), (9, 6))
        for i in range(n)
    ]
    queries = spark.createDataFrame(q, "g long, i long, q array<double>")
    keys = spark.createDataFrame(k, "g long, kid long, k array<double>, v array<double>")
    got = {(r["g"], r["i"]): (r["o0"], r["o1"]) for r in A.co_attention(queries, keys, "g", "i", 2).collect()}
    expected = {}
    for g, i, vec in q:
        mine = [(np.array(a), np.array(b)) for h, _, a, b in k if h == g]
        if mine:
            w = softmax(np.array([np.dot(vec, a) for a, _ in mine]) / np.sqrt(3))
            expected[g, i] = sum(x * b for x, (_, b) in zip(w, mine, strict=True))
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert got[key] == pytest.approx(tuple(value), rel=1e-9, abs=1e-12)


def test_cross_attention_and_latent_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2))
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in x], "g int, a double, b double")
    latents = [[1.0, 0.5], [-1.0, 2.0]]
    out = {r["latent"]: (r["a"], r["b"]) for r in A.cross_attention(df, ["g"], latents, ["a", "b"], ["a", "b"]).collect()}
    want = [softmax(x @ np.array(q) / np.sqrt(2)) @ x for q in latents]
    for i in range(2):
        assert out[i] == pytest.approx(tuple(want[i]))
    mean = A.latent_mean(A.cross_attention(df, ["g"], latents, ["a", "b"], ["a", "b"]), ["g"], ["a", "b"]).first()
    assert (mean["a"], mean["b"]) == pytest.approx(tuple((want[0] + want[1]) / 2))
    with pytest.raises(ValueError):
        A.latent_scores(df, [[1.0]], ["a", "b"])


def test_survival_is_zero_after_a_certain_hazard(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 800.0), (0, 2, 0.0)], "g int, t int, z double")
    rows = A.survival(df, ["g"], "t", F.col("z")).orderBy("t").collect()
    assert [round(r["survival"], 12) for r in rows] == [0.5, 0.0, 0.0]
    assert A.risk(A.survival(df, ["g"], "t", F.col("z")), ["g"]).first()["risk"] == pytest.approx(-0.5)
