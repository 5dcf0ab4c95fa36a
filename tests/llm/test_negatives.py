"""Hard negatives against plain integer products of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.llm import negatives

COLUMNS = "vec_id long, embedding array<double>, label int, seq int, codes string, dim string"


def brute_force(rows, positives, negative, window):
    own = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own[i, y, tuple(int(np.floor(256 * x)) for x in v)] = None
    out = []
    for a, y, v in own:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, z, w in own if i != a and len(w) == len(v)]
        for s, i, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fit = sorted(x for x in scored if x[2] != y and window[0] * -s <= 100 * -x[0] <= window[1] * -s)[:negative]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fit)]
    return sorted(out)


def found(df, **options):
    got = negatives.hard_negatives(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "c", "d") for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize(("block", "pairs", "positives", "count"), [(16, 1, 5, 5), (64, 6, 1, 3), (1024, 4096, 2, 5)])
def test_against_all_pairs(spark, block, pairs, positives, count):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.abs(rng.normal(size=6))], i % 3) for i in range(320)]
    rows += [(400 + i, [0.5] * 6, 1) for i in range(40)]  # ties, a hot vector and a hot label
    rows += [(600, [0.5] * 6, 1), (600, [0.5] * 6, 1), (5, rows[5][1], 5 % 3), (7, [1.0] * 6, 2)]
    rows += [(700, None, 1), (800, [1.0] * 6, None), (None, [1.0] * 6, 1), (900, [1.0, float("nan")] + [0.0] * 4, 1)]
    rows += [(1000, [1.0, None] + [0.0] * 4, 1), (1100, [float("inf")] * 6, 1), (1200, [1.0, 1.0], 1), (1201, [1.0, 1.0], 1)]
    rows += [(1202, [0.9, 1.0], 2), (1300, [], 0), (1301, [], 0), (1302, [], 1), (1400, [0.0] * 6, 0), (1500, [-1.0] * 6, 2)]
    want = brute_force(rows, positives, count, (80, 100))
    assert len(want) > 20
    got = found(frame(spark, rows), positives=positives, negatives=count, block=block, pairs=pairs)
    assert got == want


def test_scores_beyond_single_and_double_precision(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(0, 1 << 14, 1500)], i % 2) for i in range(24)] + [(100, [16383.0] * 1500, 0)]
    want = brute_force(rows, 2, 4, (10, 100))
    assert want and max(w[4] for w in want) > 1 << 53
    assert found(frame(spark, rows), positives=2, negatives=4, window=(10, 100)) == want


def test_products_are_exact_and_signed():
    rng = np.random.default_rng(7)
    for top, dim in ((2, 3), (200, 64), (30_000, 3000)):
        a, b = (rng.integers(-top, top + 1, (9, dim)).astype(np.int32) for _ in "ab")

        def block(codes):
            numbers = np.arange(len(codes), dtype=np.int64).tobytes()
            row = {"seqs": numbers, "ids": numbers, "labels": numbers, "codes": codes.tobytes(), "dim": codes.shape[1]}
            return negatives.Block(row)

        got = negatives.exact_scores(block(a), block(b))
        assert (got == a.astype(object) @ b.T.astype(object)).all()
    assert len(negatives.primes_for(0)) == 1 and len(negatives.primes_for(1 << 55)) == 8
    with pytest.raises(ValueError, match="beyond"):
        negatives.primes_for(1 << 56)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], COLUMNS)) == []


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        found(frame(spark, [(0, [1e9], 1), (1, [1.0], 1)]))
