import tracemalloc

import numpy as np
import pytest

from modalweave.operators import baselines as B
from modalweave.operators import metric
from modalweave.operators import neighbours as N


def data(n, copies=0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:copies] = x[0]
    return [(i, int(i % 3), int(rng.integers(4)), [float(v) for v in row]) for i, row in enumerate(x)]


def brute(rows, k=5):
    near, votes = {}, {}
    all_vectors = np.array([r[3] for r in rows])
    for i, d, _, x in rows:
        gaps = np.round(np.sqrt(((all_vectors - np.array(x)) ** 2).sum(axis=1)), 9)
        cand = sorted((float(g), j, y) for g, (j, e, y, _) in zip(gaps, rows, strict=True) if e != d)[:k]
        near[i] = [j for _, j, _ in cand]
        count = {}
        for _, _, y in cand:
            count[y] = count.get(y, 0) + 1
        votes[i] = min(count, key=lambda y: (-count[y], y))
    return near, votes


def table(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, donor int, y int, features array<double>").repartition(3)


def by_cell(found):
    got = {}
    for r in found.orderBy("cell_id", "rank").collect():
        got.setdefault(r["cell_id"], []).append(r["train_id"])
    return got


@pytest.mark.parametrize("copies", [0, 60])
@pytest.mark.parametrize(("block", "pivots"), [(8192, None), (7, None), (7, 6)])
def test_equals_brute_force(spark, monkeypatch, copies, block, pivots):
    monkeypatch.setattr(metric, "block_rows", lambda width: block)
    monkeypatch.setattr(metric, "SUMMARIES", 5)
    monkeypatch.setattr(N, "DIRECT", 0)
    rows = data(150, copies)
    df = table(spark, rows)
    near, votes = brute(rows)
    assert by_cell(N.k_nearest_of_others(df, pivots=pivots)) == near
    assert by_cell(N.k_nearest(*B.group_sides(df), pivots=pivots)) == near
    assert {r["cell_id"]: r["y_pred"] for r in N.majority(N.k_nearest_of_others(df, pivots=pivots)).collect()} == votes


def clusters(n, seed=1):
    """Eight tight groups far apart, with two-dimensional noise."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=50, size=(8, 6))
    x = centres[rng.integers(8, size=n)]
    x[:, :2] += rng.normal(size=(n, 2))
    return [(i, int(rng.integers(3)), i % 4, [float(v) for v in row]) for i, row in enumerate(x)]


def test_most_block_pairs_of_grouped_rows_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(metric, "block_rows", lambda width: 20)
    rows = clusters(900)
    found = N.search_others(table(spark, rows), 5, "donor", pivots=8)
    met = found.pairs.count()
    assert found.pairs.distinct().count() == met
    assert met < 0.25 * found.possible, (met, found.possible)
    assert by_cell(N.k_nearest_of_others(table(spark, rows), pivots=8)) == brute(rows)[0]


def test_every_task_reads_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "block_rows", lambda width: 20)
    rows = metric.build(table(spark, clusters(300)).selectExpr("donor tag", "cell_id id", "y", "features v"), np.zeros((2, 6)), 6, 300)
    blocks = rows.blocks.collect()
    assert max(b.n for b in blocks) == 20 and sum(b.n for b in blocks) == 300 and len({b.block for b in blocks}) == len(blocks)
    for b in blocks:
        x = metric.vectors_of(b.vectors, b.width)
        norms = np.sqrt((x * x).sum(axis=1))
        assert np.allclose([b.low[0], b.high[0]], [norms.min(), norms.max()])


def test_bounds_hold():
    rng = np.random.default_rng(2)
    pivots = rng.normal(size=(4, 3))
    sides = [[rng.normal(size=(5, 3)) + rng.normal(scale=3, size=3) for _ in range(6)] for _ in "ab"]
    away = [[metric.distances(x, pivots) for x in side] for side in sides]
    low, high = ([np.array([f(d, axis=0) for d in side]) for side in away] for f in (np.min, np.max))
    least, most = metric.bounds(low[0], high[0], low[1], high[1])
    for i, x in enumerate(sides[0]):
        for j, y in enumerate(sides[1]):
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
            assert least[i, j] <= d.min() + 1e-9 and most[i, j] >= d.max() - 1e-9


def test_odd_rows(spark):
    rows = [("b", None, 1, [0.0, 1.0]), ("a", 1, 0, [0.0, 0.0]), ("c", 2, None, None), ("d", 2, 3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "cell_id string, donor int, y int, features array<double>")
    got = N.k_nearest_of_others(df, 2)
    assert by_cell(got) == {"a": ["c", "b"], "c": ["a", "b"], "d": ["b", "a"]}
    assert by_cell(N.k_nearest_of_others(df.where("cell_id = 'x'"), 2)) == {}
    other = spark.createDataFrame([("a", 1, 0, [0.0]), ("b", 2, 0, [0.0, 1.0])], "cell_id string, donor int, y int, features array<double>")
    with pytest.raises(Exception, match="numbers expected"):
        N.k_nearest_of_others(other, 2).collect()


def test_chunks_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 8)), rng.normal(size=(90, 8))
    y[10:40] = y[5]
    whole = N.nearest_in_block(x, y, np.arange(90), 5)
    monkeypatch.setattr(N, "CHUNK_CELLS", 100)
    for a, b in zip(whole, N.nearest_in_block(x, y, np.arange(90), 5), strict=True):
        assert np.array_equal(a, b)


def test_a_block_of_equal_rows_is_measured_in_bounded_memory():
    x = np.ones((1500, 64))
    tracemalloc.start()
    try:
        rows, cols, dist = N.nearest_in_block(x, x, np.arange(1500), 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cols.tolist() == [0, 1, 2, 3, 4] * 1500 and not dist.any()
    assert peak < 250e6, peak


def test_fewer_train_rows_than_k(spark):
    test = spark.createDataFrame([(0, 1, [0.0])], "fold int, cell_id long, features array<double>")
    train = spark.createDataFrame([(0, 7, 2, [1.0]), (0, 8, 1, [2.0])], "fold int, cell_id long, y int, features array<double>")
    assert N.knn_predict(test, train).first()["y_pred"] == 1


def test_single_precision_finds_the_same():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64))
    x, y = (centres[rng.integers(20, size=n)] + 0.3 * rng.normal(size=(n, 64)) for n in (90, 700))
    y[100:110] = y[3]
    whole = N.nearest_in_block(x, y, np.arange(700), 5)
    for loose in (1.0, 1.5, 40.0):
        again = N.nearest_in_block(x, y, np.arange(700), 5, whole[2][4::5] * loose)
        for a, b in zip(whole, again, strict=True):
            assert np.array_equal(a, b)


def test_copies_are_searched_once(spark):
    """2,000 equal rows, and rows without a vector, which count as zeros: only k of a group are searched."""
    rows = [(i, i % 2, i % 3, [1.0, 2.0]) for i in range(2000)] + [(2000, 0, 1, None), (2001, 1, 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "cell_id long, donor int, y int, features array<double>").repartition(3)
    assert N.search_others(df, 5, "donor").near.count() <= (2 * 5 + 2) * 5
    got = by_cell(N.k_nearest_of_others(df, 5))
    assert len(got) == 2002 and got[7] == [0, 2, 4, 6, 8] and got[1998] == [1, 3, 5, 7, 9]
    assert got[2000] == [2001, 1, 3, 5, 7] and got[2001] == [2000, 0, 2, 4, 6]


def test_the_share_of_pairs_that_meet_falls_with_the_rows(spark, monkeypatch):
    """With the same pivots: the cells are made finer, so twice the rows don't make four times the pairs."""
    monkeypatch.setattr(metric, "block_rows", lambda width: 16)
    share = {}
    for n in (1500, 3000):
        x = np.random.default_rng(5).uniform(size=(n, 3))
        rows = [(i, i % 2, 0, [float(v) for v in r]) for i, r in enumerate(x)]
        found = N.search_others(table(spark, rows), 3, "donor", pivots=8)
        share[n] = found.pairs.count() / found.possible
    assert share[3000] < 0.75 * share[1500], share


def test_a_train_block_comes_once_for_a_group_of_test_blocks(spark, monkeypatch):
    """It was copied for every pair, so what was exchanged grew with the pairs."""
    monkeypatch.setattr(metric, "block_rows", lambda width: 16)
    monkeypatch.setattr(N, "PIECES", 1)
    x = np.random.default_rng(6).uniform(size=(320, 3))
    rows = [(i, i % 2, 0, [float(v) for v in r]) for i, r in enumerate(x)]
    cells = table(spark, rows).selectExpr("donor tag", "cell_id id", "y", "features v").repartition(1)
    index = metric.build(cells, x[:4], 3, 320)
    pairs = metric.pairs_within(index, index, False).localCheckpoint()
    assert N._pieces(pairs, index, index).where("away >= 0").count() < pairs.count() / 4
    near = N._ranked(N._meet(pairs, index, index, 3), ["tag"], 3)
    assert by_cell(near) == brute(rows, 3)[0]


def test_cells_of_a_fit_are_dealt_to_the_cores(spark, monkeypatch):
    """A file of a few bytes was read by one task, however many rows it had."""
    rows = spark.createDataFrame(data(95), "cell_id long, donor int, y int, features array<double>").coalesce(1)
    assert B.dealt(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(B, "FIT_ROWS", 30)
    got = B.dealt(rows)
    assert got.rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
