"""Data-parallel training of the fusion models.

The rows stay cached on the executors: a row is stored once with the list of folds it is a train row of,
and all folds train in the same jobs. Two ways lead to the same steps:

- Batches small enough for a task are taken in runs. An epoch is one exchange that lays the rows of every fold out by run and
  batch, a run of bounded size being a partition. Steps follow each other, so a task makes all steps of a run, and the
  parameters and moments it ends with start the fold's next run.
- Of a larger batch, or a larger model, each step is a job: the parameters are sent out, every task sums the gradient of its
  rows, Spark adds the task sums, and the driver makes one Adam step on a vector as long as the model.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.config import Config
from modalweave.operators.blocks import as_lists, as_matrix
from modalweave.operators.fusion import BROADCAST_LIMIT, Params, forward, init_params, pack, row_loss, softmax, unpack

CHUNK = 4096  # gradient numbers per shuffled row
BUCKETS = 16  # of each batch: how finely an epoch mixes the rows anew
RUN_BYTES = 32 << 20  # of the rows of a run of steps, which one task holds
STATE_BYTES = 16 << 20  # of a fold's parameters and moments, which travel with a run


def uniforms(ids: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Numbers in [0, 1) fixed by row id, column and salt, so a retried task repeats them."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def gradient(p: Params, cfg: Config, xs, y, w, drop=None) -> tuple[float, Params]:
    """Loss and gradient summed over the rows of a batch."""
    state = forward(p, cfg, xs, drop=drop)
    n_views, rows = len(cfg.modalities), np.arange(len(y))
    a = cfg.classification_loss_weight if cfg.model == "dynamic" else 1.0
    hot = np.zeros_like(state["logits"])
    hot[rows, y] = 1.0
    ds = a**n_views * w[:, None] * (softmax(state["logits"]) - hot)
    g = {"out.w": ds.T @ state["fused"], "out.b": ds.sum(axis=0)}
    dfused = ds @ p["out.w"]
    at = 0
    for v, (name, r) in enumerate(zip(cfg.modalities, state["views"], strict=True)):
        df = dfused[:, at : at + r["h"].shape[1]]
        at += r["h"].shape[1]
        k = a ** (n_views - 1 - v)
        if cfg.confident:
            m = k * cfg.modality_import_loss
            probs = softmax(r["t"])
            true_p = probs[rows, y]
            gap = 2.0 * (r["c"] - true_p)
            dc = (r["h"] * df).sum(axis=1) + m * gap
            dt = m * w[:, None] * (probs - hot)
            if not cfg.detach_tcp:
                dt = dt - m * (gap * true_p)[:, None] * (hot - probs)
            dh = r["c"][:, None] * df + dt @ p[f"{name}.tcp.w"] + dc[:, None] * p[f"{name}.conf.w"]
            g[f"{name}.tcp.w"], g[f"{name}.tcp.b"] = dt.T @ r["h"], dt.sum(axis=0)
            g[f"{name}.conf.w"] = (dc @ r["h"])[None, :]
            g[f"{name}.conf.b"] = np.array([dc.sum()])
        else:
            dh = df * cfg.view_weights[v]
        da = dh * (r["pre"] > 0) if drop is None else dh * drop[v] * (r["pre"] > 0)
        g[f"{name}.enc.w"], g[f"{name}.enc.b"] = da.T @ r["u"], da.sum(axis=0)
        if cfg.gated:
            du = da @ p[f"{name}.enc.w"]
            dg = (r["x"] * du + k * cfg.feature_import_loss / r["x"].shape[1]) * r["gate"] * (1 - r["gate"])
            g[f"{name}.gate.w"], g[f"{name}.gate.b"] = dg.T @ r["x"], dg.sum(axis=0)
    full = {n: g.get(n, np.zeros_like(t)) for n, t in p.items()}
    return float(row_loss(state, cfg, y, w).sum()), full


@dataclass
class Adam:
    """Adam with weight decay added to the gradient and a step decay of the rate."""

    cfg: Config
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0
    t: int = 0

    def step(self, flat: np.ndarray, grad: np.ndarray, epoch: int) -> np.ndarray:
        grad = grad + self.cfg.weight_decay * flat
        rate = self.cfg.learning_rate * self.cfg.lr_gamma ** ((epoch - 1) // self.cfg.lr_step)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m_hat, v_hat = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return flat - rate * m_hat / (np.sqrt(v_hat) + 1e-8)


@dataclass
class Fit:
    """Trained parameters per fold and the log rows of the run."""

    models: dict[int, Params]
    log: list[dict] = field(default_factory=list)
    best_epoch: dict[int, int | None] = field(default_factory=dict)
    steps: dict[int, int] = field(default_factory=dict)


def bucket_of(seed: int, n: int) -> Column:
    """The bucket a row lies in for the whole run."""
    return F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(n)).cast("int")


def bucket_order(seed: int, epoch: int, n: int) -> np.ndarray:
    """The order in which an epoch takes the buckets, by a hash of their numbers."""
    return np.argsort(uniforms(np.arange(n), 1, seed + 7919 * epoch)[:, 0], kind="stable")


def buckets_of_batch(seed: int, epoch: int, n: int, batches: int, number: int) -> np.ndarray:
    """The buckets of batch ``number`` of an epoch of so many batches."""
    lo, hi = (n * k // batches for k in (number, number + 1))
    return bucket_order(seed, epoch, n)[lo:hi]


def flipped(x: np.ndarray, shape: tuple[int, int, int], ids: np.ndarray, salt: int) -> np.ndarray:
    """Images as vectors (channel, row, column), each mirrored either way with probability 1/2."""
    across, down = (uniforms(ids, 2, salt) < 0.5).T
    out = x.reshape(len(x), *shape).copy()
    out[across] = out[across][:, :, :, ::-1]
    out[down] = out[down][:, :, ::-1]
    return out.reshape(len(x), -1)


def mirrored(xs: list[np.ndarray], cfg: Config, ids: np.ndarray, step: int) -> list[np.ndarray]:
    """The rows of a step, images mirrored."""
    salt = cfg.seed + 15485863 * step * 64
    return [
        flipped(x, cfg.image_shape, ids, salt + 15485863 * v) if m in cfg.flipped else x
        for v, (m, x) in enumerate(zip(cfg.modalities, xs, strict=True))
    ]


def dropped(cfg: Config, ids: np.ndarray, step: int) -> list[np.ndarray] | None:
    """Scaled dropout masks of the rows of a step."""
    if cfg.dropout <= 0:
        return None
    keep = 1.0 - cfg.dropout
    return [
        (uniforms(ids, h, cfg.seed + 104729 * (step * 64 + v)) < keep) / keep for v, h in enumerate(cfg.hidden)
    ]


def gradient_sums(train: DataFrame, models: Mapping[int, Params], cfg: Config, weights, step: int, batch=None):
    """Per fold ``(n, loss sum, packed gradient sum)`` over the train rows of one batch.

    ``batch`` is ``(buckets, batches, number, epoch)``, batches as one number or per fold: rows lie sorted by ``bucket``
    for the whole run, an epoch takes the buckets in an order of its own, and a batch is a run of them. So a step reads the
    cached batches that hold its buckets and skips the others by their least and greatest bucket.
    A task returns one packed vector per fold in rows of CHUNK numbers. Spark adds
    them up with a partial sum per task, and the driver receives one model-sized vector per fold.
    """
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast((dict(models), {f: np.asarray(w) for f, w in weights.items()}))
    seed = cfg.seed
    n_batches = {}
    if batch is not None:
        n_buckets, per_fold, number, epoch = batch
        n_batches = {f: per_fold if isinstance(per_fold, int) else per_fold[f] for f in models}
        chosen = {n: buckets_of_batch(seed, epoch, n_buckets, n, number) for n in set(n_batches.values())}
        wanted = sorted(set(np.concatenate(list(chosen.values())).tolist()))
        train = train.where(F.col("bucket").isin(wanted))

    def run(batches):
        by_fold, class_w = sent.value
        total = {f: [0, 0.0, None] for f in by_fold}
        for rb in batches:
            y = rb.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = rb.column("row_id").to_numpy(zero_copy_only=False)
            lists = rb.column("train_folds")
            owner = np.repeat(np.arange(rb.num_rows), np.asarray(lists.value_lengths()))
            folds = lists.flatten().to_numpy(zero_copy_only=False)
            any_p = next(iter(by_fold.values()))
            xs = [as_matrix(rb.column(m), any_p[f"{m}.enc.w"].shape[1]) for m in cfg.modalities]
            xs = mirrored(xs, cfg, ids, step)
            bucket = rb.column("bucket").to_numpy(zero_copy_only=False) if n_batches else None
            for f, p in by_fold.items():
                rows = owner[folds == f]
                if n_batches:
                    rows = rows[np.isin(bucket[rows], chosen[n_batches[f]])]
                if len(rows) == 0:
                    continue
                w = class_w[f][y[rows]] if class_w else np.ones(len(rows))
                loss, g = gradient(p, cfg, [x[rows] for x in xs], y[rows], w, dropped(cfg, ids[rows], step))
                flat = pack(g)
                t = total[f]
                t[0], t[1], t[2] = t[0] + len(rows), t[1] + loss, flat if t[2] is None else t[2] + flat
        for f, (n, loss, flat) in total.items():
            if flat is None:
                continue
            parts = -(-len(flat) // CHUNK)
            padded = np.zeros(parts * CHUNK)
            padded[: len(flat)] = flat
            first = np.arange(parts) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(parts, f, np.int64)),
                    pa.array(np.arange(parts, dtype=np.int32)),
                    pa.array(np.where(first, n, 0)),
                    pa.array(np.where(first, loss, 0.0)),
                    as_lists(padded.reshape(parts, CHUNK)),
                ],
                ["fold", "chunk", "n", "loss", "g"],
            )

    sums = train.mapInArrow(run, "fold bigint, chunk int, n bigint, loss double, g array<double>")
    added = sums.groupBy("fold", "chunk").agg(
        F.sum("n").alias("n"),
        F.sum("loss").alias("loss"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("g")))).alias("g"),
    )
    out = {}
    rows = sorted(added.collect(), key=lambda r: (r["fold"], r["chunk"]))
    for f in models:
        mine = [r for r in rows if r["fold"] == f]
        if mine:
            size = sum(v.size for v in models[f].values())
            flat = np.concatenate([np.asarray(r["g"]) for r in mine])[:size]
            out[f] = (sum(r["n"] for r in mine), sum(r["loss"] for r in mine), flat)
    sent.destroy()
    return out


@dataclass(frozen=True)
class Runs:
    """An epoch of every fold cut into runs of ``steps`` batches; a run is a partition of its own."""

    n_buckets: int
    n_batches: Mapping[int, int]
    steps: int

    @property
    def n_runs(self) -> dict[int, int]:
        return {f: -(-n // self.steps) for f, n in self.n_batches.items()}

    @property
    def first(self) -> dict[int, int]:
        """The partition of a fold's first run."""
        return dict(zip(self.n_runs, np.cumsum([0, *self.n_runs.values()]).tolist(), strict=False))

    def batch_of_bucket(self, seed: int, epoch: int, fold: int) -> np.ndarray:
        """The batch that takes each bucket; the inverse of ``buckets_of_batch``."""
        n, batches = self.n_buckets, self.n_batches[fold]
        place = np.argsort(bucket_order(seed, epoch, n), kind="stable")
        return np.searchsorted(n * np.arange(batches + 1) // batches, place, "right") - 1


def row_bytes(widths: Mapping[str, int], cfg: Config) -> int:
    """Of a row of a run: vectors, id, label, batch."""
    return 8 * (sum(widths[m] for m in cfg.modalities) + 3)


def lay_out(used: DataFrame, cfg: Config, widths: Mapping[str, int], runs: Runs, epoch: int):
    """The rows of an epoch, a partition for each fold and run, as an RDD of packed pieces."""
    first = runs.first

    def deal(batches):
        batch_of = {f: runs.batch_of_bucket(cfg.seed, epoch, f) for f in first}
        for rb in batches:
            lists = rb.column("train_folds")
            owner = np.repeat(np.arange(rb.num_rows), np.asarray(lists.value_lengths()))
            folds = lists.flatten().to_numpy(zero_copy_only=False)
            ids, y, bucket = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "y", "bucket"))
            x = np.concatenate([as_matrix(rb.column(m), widths[m]) for m in cfg.modalities], axis=1)
            out = []
            for f in first:
                rows = owner[folds == f]
                batch = batch_of[f][bucket[rows]]
                for run in np.unique(batch // runs.steps).tolist():
                    mine = batch // runs.steps == run
                    own = rows[mine]
                    arrays = (batch[mine].astype(np.int64), ids[own].astype(np.int64), y[own].astype(np.int64), x[own])
                    out.append((first[f] + run, *[a.tobytes() for a in arrays]))
            if out:
                kinds = (pa.int32(), *[pa.binary()] * 4)
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "ids", "y", "x"])

    pieces = used.mapInArrow(deal, "part int, batch binary, ids binary, y binary, x binary")
    return pieces.repartitionById(sum(runs.n_runs.values()), F.col("part")).rdd


def epoch_in_runs(
    used: DataFrame, models: dict[int, Params], optimisers: dict[int, Adam], cfg: Config, weights, widths, runs: Runs, epoch: int
) -> dict[int, list[float]]:
    """All steps of an epoch of every fold: ``models`` and ``optimisers`` are replaced, the losses of the steps returned.

    The folds' runs of one number are a job. What travels has the size of the model, three times.
    """
    context = used.sparkSession.sparkContext
    rows, first = lay_out(used, cfg, widths, runs, epoch), runs.first
    borders = np.cumsum([widths[m] for m in cfg.modalities])
    per_epoch = max(runs.n_batches.values(), default=0)
    losses: dict[int, list[float]] = {f: [] for f in models}
    for run in range(max(runs.n_runs.values(), default=0)):
        active = [f for f, n in runs.n_runs.items() if run < n]
        class_w = {f: np.asarray(w) for f, w in weights.items()}
        sent = context.broadcast(({first[f] + run: (f, models[f], optimisers[f]) for f in active}, class_w))

        def work(pieces, sent=sent):
            pieces = list(pieces)
            if not pieces:
                return
            states, class_w = sent.value
            fold, p, adam = states[pieces[0]["part"]]
            adam = replace(adam)  # a second try in this worker starts from what was sent
            batch, ids, y = (np.concatenate([np.frombuffer(r[c], np.int64) for r in pieces]) for c in ("batch", "ids", "y"))
            x = np.concatenate([np.frombuffer(r["x"], np.float64) for r in pieces]).reshape(len(y), borders[-1])
            pieces.clear()
            order = np.lexsort((ids, batch))
            batch, ids, y, x = batch[order], ids[order], y[order], x[order]
            numbers, starts = np.unique(batch, return_index=True)
            found = []
            for number, lo, hi in zip(numbers.tolist(), starts, [*starts[1:], len(batch)], strict=True):
                step = (epoch - 1) * per_epoch + number + 1
                own, labels = ids[lo:hi], y[lo:hi]
                xs = mirrored(np.split(x[lo:hi], borders[:-1], axis=1), cfg, own, step)
                w = class_w[fold][labels] if class_w else np.ones(hi - lo)
                loss, g = gradient(p, cfg, xs, labels, w, dropped(cfg, own, step))
                found.append(loss / (hi - lo))
                p = unpack(adam.step(pack(p), pack(g) / (hi - lo), epoch), p)
            yield fold, p, adam, found

        for f, p, adam, found in context.runJob(rows, work, [first[f] + run for f in active]):
            models[f], optimisers[f] = p, adam
            losses[f] += found
        sent.destroy()
    return losses


def in_buckets(rows: DataFrame, cfg: Config, n: int) -> DataFrame:
    """The rows beside ``bucket``, sorted by it and cached in pieces of a quarter of a bucket's batch or less.

    A cached piece knows its least and greatest bucket, so a step only reads the pieces of its own.
    """
    spark, name = rows.sparkSession, "spark.sql.inMemoryColumnarStorage.batchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(16, min(int(before), cfg.batch_size // 4))))
    try:
        placed = rows.withColumn("bucket", bucket_of(cfg.seed, n))
        held = placed.repartitionByRange("bucket", "row_id").sortWithinPartitions("bucket")
        held = held.persist(StorageLevel.MEMORY_AND_DISK)
        held.count()
        return held
    finally:
        spark.conf.set(name, before)


def train(
    cells: DataFrame,
    folds: list[int],
    widths: Mapping[str, int],
    cfg: Config,
    class_weights: Mapping[int, list[float]] | None = None,
    validate=None,
) -> Fit:
    """Train one model per fold.

    ``cells`` has ``cell_id, y, train_folds`` and one vector column per modality. An epoch of a
    fold takes ``ceil(train rows / cfg.batch_size)`` steps (``Fit.steps`` counts them; a batch whose
    buckets are empty takes none). Rows are sorted into buckets once, BUCKETS for each batch.
    ``validate(models)`` returns the metrics of each fold in ``models``, among them ``f1_macro`` (a plain
    number is that), and is called every ``test_interval`` epochs; all of them are logged. With ``keep="best"`` the parameters of the earliest epoch
    with the highest value are returned, with ``keep="last"`` those of the last epoch.
    """
    models = {f: init_params(cfg, widths) for f in folds}
    # Parameters and gradients of all folds travel together; a run of many folds of a
    # wide model is cut into runs that fit.
    size = sum(v.nbytes for v in models[folds[0]].values()) if folds else 0
    if size > BROADCAST_LIMIT:
        raise ValueError(f"a model of {size} bytes is too large to broadcast; reduce the feature widths")
    at_once = max(1, BROADCAST_LIMIT // max(1, size))
    if len(folds) > at_once:
        done = Fit({})
        for i in range(0, len(folds), at_once):
            part = train(cells, folds[i : i + at_once], widths, cfg, class_weights, validate)
            done.models |= part.models
            done.best_epoch |= part.best_epoch
            done.steps |= part.steps
            done.log += part.log
        return done
    used = cells.where(F.size("train_folds") > 0).select(
        F.xxhash64("cell_id").alias("row_id"), "y", "train_folds", *cfg.modalities
    )
    sizes = used.select(F.explode("train_folds").alias("fold")).groupBy("fold").count().collect()
    n_batches = {r["fold"]: -(-r["count"] // cfg.batch_size) for r in sizes if r["fold"] in models}
    n_buckets = BUCKETS * max(n_batches.values(), default=1)
    a_row = row_bytes(widths, cfg)
    in_runs = cfg.batch_size * a_row <= RUN_BYTES and 3 * size <= STATE_BYTES
    runs = Runs(n_buckets, n_batches, max(1, RUN_BYTES // (a_row * cfg.batch_size)))
    if in_runs:
        used = used.withColumn("bucket", bucket_of(cfg.seed, n_buckets)).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        used = in_buckets(used, cfg, n_buckets)
    optimisers = {f: Adam(cfg) for f in folds}
    weights = class_weights if cfg.class_weighted and class_weights else {}
    fit = Fit(dict(models), best_epoch={f: None for f in folds})
    best = {f: 0.0 for f in folds}
    step = 0
    for epoch in range(1, cfg.epochs + 1):
        losses: dict[int, list[float]] = {f: [] for f in folds}
        if in_runs:
            losses = epoch_in_runs(used, models, optimisers, cfg, weights, widths, runs, epoch)
        for b in range(0 if in_runs else max(n_batches.values(), default=0)):
            step += 1
            active = {f: models[f] for f, n in n_batches.items() if b < n}
            batch = (n_buckets, n_batches, b, epoch) if any(n_batches[f] > 1 for f in active) else None
            for f, (n, loss, flat) in gradient_sums(used, active, cfg, weights, step, batch).items():
                losses[f].append(loss / n)
                models[f] = unpack(optimisers[f].step(pack(models[f]), flat / n, epoch), models[f])
        fit.log += [
            {"fold": f, "epoch": epoch, "metric": "loss", "value": float(np.mean(v))} for f, v in losses.items() if v
        ]
        if validate is not None and epoch % cfg.test_interval == 0:
            for f, found in validate(models).items():
                found = found if isinstance(found, Mapping) else {"f1_macro": found}
                fit.log += [{"fold": f, "epoch": epoch, "metric": f"val_{m}", "value": v} for m, v in found.items()]
                value = found["f1_macro"]
                if best[f] < value:
                    best[f], fit.best_epoch[f] = value, epoch
                    if cfg.keep == "best":
                        fit.models[f] = models[f]
    fit.steps = {f: optimisers[f].t for f in folds}
    for f in folds:
        if cfg.keep == "last" or fit.best_epoch[f] is None:
            fit.models[f] = models[f]
    used.unpersist()
    return fit
