import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modalweave.config import Config
from modalweave.operators import fusion as FU
from modalweave.operators import wide as W
from modalweave.operators import training as TR
from modalweave.operators.baselines import dense_net
from modalweave.operators.blocks import as_matrix
from modalweave.plans import experiment as E

WIDTHS = {"a": 3, "b": 4}


def config(**kw):
    base = dict(modalities=("a", "b"), hidden_dims=(2, 3), model="dynamic", classes={str(i): i for i in range(4)})
    return Config(**(base | kw))


def batch(n=5, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(n, 3)), rng.normal(size=(n, 4))], rng.integers(0, 4, n), rng.uniform(0.5, 2, n)


@pytest.mark.parametrize(
    "kw",
    [
        dict(classification_loss_weight=1.3, feature_import_loss=0.7, modality_import_loss=0.9),
        dict(feature_import_loss=None),
        dict(modality_import_loss=None),
        dict(feature_import_loss=None, modality_import_loss=None, classification_loss_weight=2.0),
        dict(feature_import_loss=0.0, modality_import_loss=0.0),
        dict(model="static", modality_weights=(3.0, 1.0)),
    ],
)
@pytest.mark.parametrize("masked", [False, True])
def test_gradient_against_differences(kw, masked):
    cfg = config(**kw)
    p = FU.init_params(cfg, WIDTHS, seed=1)
    xs, y, w = batch()
    drop = [np.array([[2.0, 0.0]] * 5), np.array([[0.0, 2.0, 2.0]] * 5)] if masked else None
    _, g = TR.gradient(p, cfg, xs, y, w, drop)
    flat, analytic = FU.pack(p), FU.pack(g)

    def loss(v):
        q = FU.unpack(v, p)
        return FU.row_loss(FU.forward(q, cfg, xs, drop=drop), cfg, y, w).sum()

    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert analytic[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_detached_target_changes_only_the_gradient():
    xs, y, w = batch()
    p = FU.init_params(config(), WIDTHS, seed=1)
    loss, g = TR.gradient(p, config(), xs, y, w)
    same, h = TR.gradient(p, config(detach_tcp=True), xs, y, w)
    assert loss == same and not np.allclose(g["a.tcp.w"], h["a.tcp.w"])
    assert np.allclose(g["out.w"], h["out.w"])


def test_closed_form_of_the_loss_equals_the_loop():
    cfg = config(classification_loss_weight=1.3, feature_import_loss=0.7, modality_import_loss=0.9)
    xs, y, w = batch(20)
    state = FU.forward(FU.init_params(cfg, WIDTHS), cfg, xs)
    total = (w * FU.log_loss(state["logits"], y)).mean()
    for r in state["views"]:
        total = 1.3 * total + 0.7 * r["gate"].mean()
        p = FU.softmax(r["t"])[np.arange(20), y]
        total += 0.9 * ((r["c"] - p) ** 2 + w * FU.log_loss(r["t"], y)).mean()
    assert FU.row_loss(state, cfg, y, w).mean() == pytest.approx(total)


def frame(spark, n=60, partitions=1):
    rng = np.random.default_rng(5)
    rows = [
        (f"c{i}", i % 3, int(i % 4), [f for f in (0, 1, 2) if f != i % 3], [float(v) for v in rng.normal(size=3) + i % 4], [float(v) for v in rng.normal(size=4)])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "cell_id string, donor int, y int, train_folds array<bigint>, a array<double>, b array<double>")
    return df.repartition(partitions)


def bucketed(df, cfg, n):
    used = df.select(F.xxhash64("cell_id").alias("row_id"), "y", "train_folds", "a", "b")
    return used.withColumn("bucket", TR.bucket_of(cfg.seed, n))


@pytest.mark.parametrize("batches", [None, (48, 3, 1, 2)])
def test_gradient_does_not_depend_on_partitions(spark, batches):
    cfg = config()
    models = {f: FU.init_params(cfg, WIDTHS, seed=f) for f in range(3)}
    weights = {f: [1.0, 2.0, 0.5, 1.5] for f in range(3)}
    out = []
    for parts in (1, 4):
        used = bucketed(frame(spark, partitions=parts), cfg, 48)
        out.append(TR.gradient_sums(used, models, cfg, weights, 3, batches))
    for f in range(3):
        assert out[0][f][0] == out[1][f][0] > 0
        assert out[0][f][1] == pytest.approx(out[1][f][1], rel=1e-12)
        assert np.allclose(out[0][f][2], out[1][f][2], atol=1e-9)


def replay(rows, cfg, fold, epochs):
    """Epochs over rows in one process: batches, dropout, mirrored images, weight decay and rates as the run has them."""
    params = FU.init_params(cfg, WIDTHS)
    adam, step = TR.Adam(cfg), 0
    used = [r for r in rows if fold in r["train_folds"]]
    batches = -(-len(used) // cfg.batch_size)
    n = TR.BUCKETS * batches
    ids = np.array([r["row_id"] for r in used])
    xs = [np.array([r[m] for r in used]) for m in cfg.modalities]
    y, bucket = np.array([r["y"] for r in used]), np.array([r["bucket"] for r in used])
    losses = []
    for epoch in range(1, epochs + 1):
        own = []
        for b in range(batches):
            step += 1
            at = np.flatnonzero(np.isin(bucket, TR.buckets_of_batch(cfg.seed, epoch, n, batches, b))) if batches > 1 else np.arange(len(y))
            if not len(at):
                continue
            x = [v[at] for v in xs]
            for v, m in enumerate(cfg.modalities):
                if m in cfg.flipped:
                    for k, i in enumerate(at):
                        across, down = TR.uniforms(ids[[i]], 2, cfg.seed + 15485863 * (step * 64 + v))[0] < 0.5
                        image = x[v][k].reshape(cfg.image_shape)
                        image = image[:, :, ::-1] if across else image
                        x[v][k] = (image[:, ::-1] if down else image).ravel()
            keep = 1 - cfg.dropout
            drop = [(TR.uniforms(ids[at], h, cfg.seed + 104729 * (step * 64 + v)) < keep) / keep for v, h in enumerate(cfg.hidden)]
            loss, g = TR.gradient(params, cfg, x, y[at], np.ones(len(at)), drop if cfg.dropout else None)
            own.append(loss / len(at))
            params = FU.unpack(adam.step(FU.pack(params), FU.pack(g) / len(at), epoch), params)
        losses.append(float(np.mean(own)))
    return params, losses


@pytest.mark.parametrize("model", ["dynamic", "static"])
def test_whole_epochs_can_be_replayed(spark, model):
    cfg = config(
        model=model, epochs=3, batch_size=16, dropout=0.4, weight_decay=0.01, learning_rate=0.02, lr_step=2, class_weighted=False,
        keep="last", flipped=("b",), image_shape=(1, 2, 2), modality_weights=(1.0, 2.0),
    )
    df = frame(spark, 60, 3)
    fit = TR.train(df, [0, 2], WIDTHS, cfg)
    rows = bucketed(df, cfg, TR.BUCKETS * 3).collect()
    assert set(fit.steps.values()) == {9}
    for fold in (0, 2):
        params, losses = replay(rows, cfg, fold, 3)
        logged = [r["value"] for r in fit.log if r["fold"] == fold and r["metric"] == "loss"]
        assert np.allclose(logged, losses, rtol=1e-9)
        for name, value in params.items():
            assert np.allclose(fit.models[fold][name], value, rtol=1e-8, atol=1e-11), name


def test_a_step_reads_its_own_pieces(spark):
    """Cached pieces of other buckets are skipped by their least and greatest bucket."""
    cfg = config(batch_size=64, dropout=0.0)
    rows = spark.range(6400).select(F.col("id").alias("row_id"), F.lit(1).alias("y"), F.array(F.lit(0).cast("long")).alias("train_folds"))
    rows = rows.withColumn("a", F.array_repeat(F.lit(1.0), 3)).withColumn("b", F.array_repeat(F.lit(1.0), 4))
    n = TR.BUCKETS * 100
    held = TR.in_buckets(rows, cfg, n)
    wanted = TR.buckets_of_batch(cfg.seed, 1, n, 100, 7)
    part = held.where(F.col("bucket").isin(wanted.tolist()))
    spark.sparkContext.setJobGroup("pieces", "")
    got = part.agg(F.count(F.lit(1))).collect()[0][0]
    spark.sparkContext.setJobGroup("rest", "")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = [s for j in tracker.getJobIdsForGroup("pieces") for s in tracker.getJobInfo(j).stageIds]
    read = sum(store.lastStageAttempt(s).inputRecords() for s in stages)
    held.unpersist()
    assert len(wanted) == TR.BUCKETS and 32 <= got <= 128
    assert read <= 1000, read  # 16 buckets of about 4 rows, in pieces of 16 rows


def test_bucket_orders_differ_by_epoch_and_cover_all():
    orders = [TR.bucket_order(42, e, 160).tolist() for e in (1, 2, 3)]
    assert all(sorted(o) == list(range(160)) for o in orders) and len({tuple(o) for o in orders}) == 3
    parts = [TR.buckets_of_batch(42, 2, 160, 7, b).tolist() for b in range(7)]
    assert sum(parts, []) == orders[1]


def test_flips_are_mirrors_of_half_the_images():
    x = np.arange(400 * 12, dtype=float).reshape(400, 12)
    out = TR.flipped(x, (3, 2, 2), np.arange(400), 5)
    shapes = {tuple((o - v.min()).astype(int)) for o, v in zip(out, x, strict=True)}
    assert len(shapes) == 4 and (np.sort(out, axis=1) == x).all()
    assert (TR.flipped(x, (3, 2, 2), np.arange(400), 5) == out).all()


def test_batches_split_the_epoch(spark):
    cfg = config(dropout=0.0)
    models = {0: FU.init_params(cfg, WIDTHS)}
    used = bucketed(frame(spark), cfg, 48)
    parts = [TR.gradient_sums(used, models, cfg, {}, 1, (48, 3, b, 1)).get(0, (0, 0, 0)) for b in range(3)]
    whole = TR.gradient_sums(used, models, cfg, {}, 1)[0]
    assert sum(p[0] for p in parts) == whole[0] == 40
    assert np.allclose(sum(p[2] for p in parts), whole[2])


def test_uniforms_are_even_and_repeatable():
    u = TR.uniforms(np.arange(2000), 10, 7)
    assert np.array_equal(u, TR.uniforms(np.arange(2000), 10, 7))
    assert 0.49 < u.mean() < 0.51 and 0 <= u.min() and u.max() < 1
    assert not np.array_equal(u, TR.uniforms(np.arange(2000), 10, 8))


def test_missing_modality_adds_nothing(spark):
    cfg = config(model="static", modality_weights=(1.0, 1.0))
    p = FU.init_params(cfg, WIDTHS)
    df = frame(spark, 6).withColumn("fold", F.lit(0)).withColumn("b", F.when(F.col("cell_id") != "c1", F.col("b")))
    rows = {r["cell_id"]: r for r in FU.score(df, {0: p}, cfg, ["cell_id", "a", "b"], ("logits", "prob", "fused")).collect()}
    h = np.maximum(np.array(rows["c1"]["a"]) @ p["a.enc.w"].T + p["a.enc.b"], 0)
    assert rows["c1"]["fused"] == pytest.approx(list(h) + [0.0] * 3)
    assert sum(rows["c2"]["prob"]) == pytest.approx(1.0)


def test_score_fold_by_fold_when_parameters_are_large(spark, monkeypatch):
    cfg = config()
    models = {f: FU.init_params(cfg, WIDTHS, seed=f) for f in range(3)}
    df = frame(spark, 30).withColumn("fold", F.col("donor"))
    whole = sorted(FU.score(df, models, cfg, ["cell_id"], ("prob",)).collect())
    size = sum(v.nbytes for v in models[0].values())
    monkeypatch.setattr(FU, "BROADCAST_LIMIT", size)
    assert sorted(FU.score(df, models, cfg, ["cell_id"], ("prob",)).collect()) == whole
    monkeypatch.setattr(FU, "BROADCAST_LIMIT", 10)
    monkeypatch.setattr(W, "BLOCK", 2)
    got = sorted(FU.score(df, models, cfg, ["cell_id"], ("prob",)).collect())
    assert [r["cell_id"] for r in got] == [r["cell_id"] for r in whole]
    assert np.allclose([r["prob"] for r in got], [r["prob"] for r in whole], atol=1e-12)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
@pytest.mark.parametrize("model", ["dynamic", "static"])
def test_wide_model_equals_the_broadcast_one(spark, block, model):
    cfg = config(model=model)
    models = {f: FU.init_params(cfg, WIDTHS, seed=f) for f in range(3)}
    df = frame(spark, 25).withColumn("fold", F.col("donor")).withColumn("b", F.when(F.col("cell_id") != "c1", F.col("b"))).repartition(3)
    outputs = ("prob", "logits", "fused", *(["tcp"] if model == "dynamic" else []))
    want = sorted(FU.score(df, models, cfg, ["cell_id", "y"], outputs).collect())
    wide = W.WideModel(FU.params_table(spark, models), cfg, WIDTHS, block)
    got = wide.score(df, ["cell_id", "y"], outputs)
    assert got.columns == FU.score(df, models, cfg, ["cell_id", "y"], outputs).columns
    for g, w in zip(sorted(got.collect()), want, strict=True):
        assert g[:2] == w[:2]
        for a, b in zip(g[2:], w[2:], strict=True):
            assert np.allclose(a, b, atol=1e-12)


def test_wide_mean_gates(spark):
    cfg = config()
    models = {f: FU.init_params(cfg, WIDTHS, seed=f) for f in range(3)}
    df = frame(spark, 25).withColumn("fold", F.col("donor"))
    gates = FU.score(df, models, cfg, ["fold"], ("gates",)).collect()
    got = {(r["fold"], r["idx"]): (r["n"], r["gate"]) for r in W.WideModel(FU.params_table(spark, models), cfg, WIDTHS, 2).mean_gates(df, "a").collect()}
    assert len(got) == 3 * WIDTHS["a"]
    for f in range(3):
        own = np.array([r["gate_a"] for r in gates if r["fold"] == f])
        for i in range(WIDTHS["a"]):
            assert got[f, i][0] == len(own) and abs(got[f, i][1] - own[:, i].mean()) < 1e-12


def test_wide_model_refuses_what_it_cannot_score(spark):
    cfg = config()
    wide = W.WideModel(FU.params_table(spark, {0: FU.init_params(cfg, WIDTHS)}), cfg, WIDTHS, 2)
    df = frame(spark, 4).withColumn("fold", F.lit(0))
    with pytest.raises(ValueError, match="mean_gates"):
        wide.score(df, ["cell_id"], ("gates",))
    with pytest.raises(Exception, match="no model"):
        wide.score(df.withColumn("fold", F.lit(None).cast("long")), ["cell_id"]).collect()
    with pytest.raises(Exception, match="numbers expected"):
        wide.score(df.withColumn("a", F.array(F.lit(1.0))), ["cell_id"]).collect()
    assert wide.score(df.where("cell_id = 'x'"), ["cell_id"]).count() == 0


def test_parameters_survive_the_table(spark, tmp_path):
    cfg = config()
    models = {f: FU.init_params(cfg, WIDTHS, seed=f) for f in (3, 8)}
    FU.save_params(spark, models, str(tmp_path / "w"))
    back = FU.load_params(spark, str(tmp_path / "w"), cfg, WIDTHS)
    assert set(back) == {3, 8}
    assert all(np.array_equal(back[f][n], v) for f in models for n, v in models[f].items())
    with pytest.raises(ValueError):
        FU.load_params(spark, str(tmp_path / "w"), config(hidden_dims=(5, 5)), WIDTHS)


def test_adam_first_step_and_decay():
    cfg = config(learning_rate=0.1, weight_decay=0.0, lr_step=10, lr_gamma=0.5)
    assert TR.Adam(cfg).step(np.zeros(2), np.array([3.0, -1.0]), 1) == pytest.approx([-0.1, 0.1])
    assert TR.Adam(cfg).step(np.zeros(2), np.array([3.0, -1.0]), 11) == pytest.approx([-0.05, 0.05])
    assert TR.Adam(cfg.with_(weight_decay=1.0)).step(np.array([2.0]), np.array([0.0]), 1) == pytest.approx([1.9])


@pytest.fixture(scope="module")
def tables(spark):
    """Class is readable from modality a; donor 0 owns more than a third of the cells."""
    rng = np.random.default_rng(0)
    meta, a, b = [], [], []
    names = ["BP", "EryP", "MoP", "NeuP"]
    for i in range(240):
        y = int(rng.integers(4))
        meta.append((f"c{i}", 1, 0 if i < 90 else 1 + i % 2, "t", names[y]))
        a.append((f"c{i}", [float(v) for v in np.eye(4)[y][:3] * 3 + rng.normal(0, 0.3, 3)]))
        b.append((f"c{i}", [float(v) for v in rng.normal(size=4)]))
    m = spark.createDataFrame(meta, "cell_id string, day int, donor int, technology string, cell_type string")
    kind = "cell_id string, features array<double>"
    return m, {"a": spark.createDataFrame(a, kind), "b": spark.createDataFrame(b, kind)}


@pytest.mark.parametrize("model", ["static", "dynamic"])
def test_training_learns(tables, model):
    meta, mods = tables
    cfg = Config(modalities=("a", "b"), hidden_dims=(8, 4), model=model, epochs=40, learning_rate=0.03, dropout=0.1, test_interval=20)
    out = E.cross_validate(meta, mods, cfg)
    losses = {(r["fold"], r["epoch"]): r["value"] for r in out.fit.log if r["metric"] == "loss"}
    assert all(losses[f, 40] < losses[f, 1] for f in range(3))
    assert out.predictions.count() == 240
    assert out.summary.first()["accuracy_mean"] > 0.6
    assert set(out.fit.best_epoch.values()) <= {20, 40}


def test_outcome_tables_and_test_only(tables, spark, tmp_path):
    meta, mods = tables
    cfg = Config(modalities=("a",), hidden_dims=(4,), epochs=2, test_interval=1, learning_rate=0.05, results=str(tmp_path))
    out = E.cross_validate(meta, mods, cfg)
    here = E.write_outcome(out, cfg)
    assert spark.read.csv(f"{here}/metrics_mean", header=True).count() == 1
    assert len(spark.read.csv(f"{here}/cfm_mean").columns) == 4
    assert spark.read.parquet(f"{tmp_path}/log").where("metric = 'loss'").count() == 6
    again = E.cross_validate(meta, mods, cfg.with_(test_only=True, weights_dir=f"{here}/weights"))
    key = ["fold", "cell_id", "y_true", "y_pred"]
    assert again.predictions.select(key).exceptAll(out.predictions.select(key)).count() == 0
    with pytest.raises(ValueError):
        E.cross_validate(meta, mods, cfg.with_(test_only=True))


def test_reports(tables, spark):
    meta, mods = tables
    cfg = Config(modalities=("a", "b"), hidden_dims=(4, 4), model="dynamic", epochs=1, test_interval=1)
    data = E.prepare(meta, mods, cfg)
    fit = E.fit(data, cfg)
    names = {"a": ["x", "y", "z"], "b": list("pqrs")}
    top = E.importance_report(data, fit.models, cfg, names, k=2)
    assert top.count() == 3 * 2 * 2 * 2 and top.where("name is null").count() == 0
    report = E.calibration_report(data, fit.models, cfg, cumulative=True)
    errors = {(r["fold"], r["modality"]): r["n"] for r in report["errors"].collect()}
    assert errors[0, "b"] == 2 * errors[0, "a"] == 180
    assert report["running"].count() == 30
    fixed = E.gate_rows(data, fit.models, cfg, weights_fold=0)
    assert fixed.count() == 480


def test_steps_in_runs_equal_steps_as_jobs(spark, monkeypatch):
    cfg = config(epochs=2, batch_size=7, dropout=0.3, learning_rate=0.02, keep="last", flipped=("b",), image_shape=(1, 2, 2))
    weights = {f: [1.0, 2.0, 0.5, 1.5] for f in range(3)}
    fits = []
    for run_bytes, state_bytes in ((TR.RUN_BYTES, TR.STATE_BYTES), (2 * 7 * TR.row_bytes(WIDTHS, cfg), TR.STATE_BYTES), (TR.RUN_BYTES, 0)):
        monkeypatch.setattr(TR, "RUN_BYTES", run_bytes)
        monkeypatch.setattr(TR, "STATE_BYTES", state_bytes)
        fits.append(TR.train(frame(spark, 60, 3).where("cell_id <> 'c1'"), [0, 1, 2], WIDTHS, cfg, weights))
    for fit in fits[1:]:
        assert fit.steps == fits[0].steps
        assert np.allclose([r["value"] for r in fit.log], [r["value"] for r in fits[0].log], rtol=1e-9)
        for f in range(3):
            assert all(np.allclose(fit.models[f][n], v, rtol=1e-8, atol=1e-11) for n, v in fits[0].models[f].items())


def test_jobs_follow_the_runs_and_not_the_steps(spark):
    context = spark.sparkContext
    cfg = config(model="static", epochs=2, batch_size=2)
    context.setJobGroup("many steps", "")
    try:
        fit = TR.train(frame(spark), [0], WIDTHS, cfg)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert fit.steps[0] > 30
    assert len(context.statusTracker().getJobIdsForGroup("many steps")) < 12


def test_runs_hold_the_batches_in_order():
    runs = TR.Runs(160, {0: 7, 5: 10}, 4)
    assert runs.n_runs == {0: 2, 5: 3} and runs.first == {0: 0, 5: 2}
    for fold, batches in runs.n_batches.items():
        found = runs.batch_of_bucket(42, 3, fold)
        for b in range(batches):
            assert sorted(TR.buckets_of_batch(42, 3, 160, batches, b)) == np.flatnonzero(found == b).tolist()


def test_last_is_kept_on_request(spark):
    cfg = config(model="static", epochs=2, test_interval=1, keep="last", learning_rate=0.05)
    fit = TR.train(frame(spark), [0], WIDTHS, cfg, None, lambda models: {0: 0.5})
    best = TR.train(frame(spark), [0], WIDTHS, cfg.with_(keep="best"), None, lambda models: {0: 0.5})
    assert fit.best_epoch == best.best_epoch == {0: 1}
    assert not np.allclose(fit.models[0]["out.w"], best.models[0]["out.w"])


def test_folds_are_trained_in_groups_when_large(spark, monkeypatch):
    cfg = config(model="static", epochs=1)
    whole = TR.train(frame(spark), [0, 1, 2], WIDTHS, cfg)
    monkeypatch.setattr(TR, "BROADCAST_LIMIT", sum(v.nbytes for v in whole.models[0].values()))
    parts = TR.train(frame(spark), [0, 1, 2], WIDTHS, cfg)
    assert all(np.allclose(whole.models[f][n], parts.models[f][n]) for f in range(3) for n in whole.models[f])


def test_scoring_works_on_a_stream(spark, tmp_path):
    cfg = config(model="static")
    p = FU.init_params(cfg, WIDTHS)
    rows = frame(spark, 12).withColumn("fold", F.lit(0)).select("cell_id", "fold", "a", "b")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = FU.score(stream, {0: p}, cfg, ["cell_id"]).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = {r["cell_id"]: r["prob"] for r in spark.table("scored").collect()}
    want = {r["cell_id"]: r["prob"] for r in FU.score(rows, {0: p}, cfg, ["cell_id"]).collect()}
    assert got == want


@pytest.mark.parametrize("size,batches", [(40, 1), (16, 3), (7, 6)])
def test_an_epoch_reads_every_batch(spark, size, batches):
    cfg = config(dropout=0.0, batch_size=size, epochs=2)
    fit = TR.train(frame(spark), [0], WIDTHS, cfg)
    assert fit.steps == {0: 2 * batches}


def test_dense_net_takes_its_classes_from_the_labels(spark):
    rows = [(f"c{i}", i % 2, i % 5, [float(i % 5 == j) for j in range(5)]) for i in range(40)]
    cells = spark.createDataFrame(rows, "cell_id string, donor int, y int, features array<double>")
    assert dense_net(cells, batch_size=8).count() == 40


def test_vectors_of_unequal_length_are_an_error():
    ragged = pa.array([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]])
    with pytest.raises(ValueError, match="lengths"):
        as_matrix(ragged)
    with pytest.raises(ValueError, match="lengths"):
        as_matrix(pa.array([[1.0, 2.0]]), 3)
    assert as_matrix(pa.array([None, None], pa.list_(pa.float64()))).shape == (2, 0)
    assert as_matrix(pa.array([None, [1.0, 2.0]])).tolist() == [[0.0, 0.0], [1.0, 2.0]]


def test_rows_without_a_fold_are_not_scored(spark):
    cfg = config()
    rows = frame(spark).withColumn("fold", F.lit(None).cast("bigint"))
    scored = FU.score(rows, {0: FU.init_params(cfg, WIDTHS)}, cfg, ["cell_id"], ("logits",))
    with pytest.raises(Exception, match="without a fold"):
        scored.collect()
