"""Late fusion of modality vectors: gates, encoders, confidences, one linear classifier.

The parameters are small (their size depends on the feature widths, not on the
rows) and are broadcast; rows are scored in Arrow batches where they lie.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalweave.config import Config
from modalweave.operators.blocks import as_lists, as_matrix

Params = dict[str, np.ndarray]
BROADCAST_LIMIT = 1 << 30  # bytes of parameters sent to the executors at once


def shapes(cfg: Config, widths: Mapping[str, int]) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all parameters, in the order of the packed vector."""
    out: dict[str, tuple[int, ...]] = {}
    k = cfg.n_classes
    for view, h in zip(cfg.modalities, cfg.hidden, strict=True):
        d = widths[view]
        if cfg.model == "dynamic":
            out |= {f"{view}.gate.w": (d, d), f"{view}.gate.b": (d,)}
        out |= {f"{view}.enc.w": (h, d), f"{view}.enc.b": (h,)}
        if cfg.model == "dynamic":
            out |= {f"{view}.tcp.w": (k, h), f"{view}.tcp.b": (k,)}
            out |= {f"{view}.conf.w": (1, h), f"{view}.conf.b": (1,)}
    return out | {"out.w": (k, sum(cfg.hidden)), "out.b": (k,)}


def init_params(cfg: Config, widths: Mapping[str, int], seed: int | None = None) -> Params:
    """Xavier-normal weights, zero bias."""
    rng = np.random.default_rng(cfg.seed if seed is None else seed)
    out = {}
    for name, shape in shapes(cfg, widths).items():
        std = np.sqrt(2.0 / sum(shape)) if len(shape) == 2 else 0.0
        out[name] = rng.normal(0.0, std, shape) if std else np.zeros(shape)
    return out


def formula_params(cfg: Config, widths: Mapping[str, int]) -> Params:
    """Reproducible parameters: weight sin(7i + 13j + layer) / 8, bias cos(j + layer) / 8
    for input i, output j; layers 4v .. 4v+3 are gate, enc, tcp, conf of view v."""
    number = {"gate": 0, "enc": 1, "tcp": 2, "conf": 3}
    views = list(cfg.modalities)
    out = {}
    for name, shape in shapes(cfg, widths).items():
        parts = name.split(".")
        layer = 4 * len(views) if parts[0] == "out" else 4 * views.index(parts[0]) + number[parts[1]]
        j = np.arange(shape[0])
        out[name] = (
            np.sin(7 * np.arange(shape[1])[None, :] + 13 * j[:, None] + layer) / 8
            if len(shape) == 2
            else np.cos(j + layer) / 8
        )
    return out


def pack(p: Params) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpack(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for name, v in like.items():
        out[name] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def log_loss(z, y):
    m = z.max(axis=1)
    return m + np.log(np.exp(z - m[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]


def forward(p: Params, cfg: Config, xs: list[np.ndarray], present=None, drop=None) -> dict:
    """All intermediate vectors of a batch. ``present[v]`` is 0 for a missing modality,
    ``drop[v]`` the scaled dropout mask."""
    views = []
    for v, (name, x) in enumerate(zip(cfg.modalities, xs, strict=True)):
        r = {"x": x}
        if cfg.model == "dynamic":
            r["gate"] = sigmoid(x @ p[f"{name}.gate.w"].T + p[f"{name}.gate.b"])
        r["u"] = x * r["gate"] if cfg.gated else x
        r["pre"] = r["u"] @ p[f"{name}.enc.w"].T + p[f"{name}.enc.b"]
        r["h"] = np.maximum(r["pre"], 0.0)
        if drop is not None:
            r["h"] = r["h"] * drop[v]
        if cfg.model == "dynamic":
            r["t"] = r["h"] @ p[f"{name}.tcp.w"].T + p[f"{name}.tcp.b"]
            r["c"] = (r["h"] @ p[f"{name}.conf.w"].T + p[f"{name}.conf.b"])[:, 0]
        factor = r["c"][:, None] if cfg.confident else cfg.view_weights[v]
        r["f"] = r["h"] * factor
        if present is not None:
            r["f"] = r["f"] * present[v][:, None]
        views.append(r)
    fused = np.concatenate([r["f"] for r in views], axis=1)
    return {"views": views, "fused": fused, "logits": fused @ p["out.w"].T + p["out.b"]}


def row_loss(state: dict, cfg: Config, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss of each row; its mean over a batch is the training loss."""
    n_views = len(cfg.modalities)
    a = cfg.classification_loss_weight if cfg.model == "dynamic" else 1.0
    loss = a**n_views * w * log_loss(state["logits"], y)
    for v, r in enumerate(state["views"]):
        k = a ** (n_views - 1 - v)
        if cfg.gated:
            loss = loss + k * cfg.feature_import_loss * r["gate"].mean(axis=1)
        if cfg.confident:
            true_p = softmax(r["t"])[np.arange(len(y)), y]
            conf = (r["c"] - true_p) ** 2 + w * log_loss(r["t"], y)
            loss = loss + k * cfg.modality_import_loss * conf
    return loss


# --- parameters as a table -----------------------------------------------------------------


def params_table(spark: SparkSession, models: Mapping[int, Params]) -> DataFrame:
    """Long table ``(fold, layer, i, j, w)``: input i, output j; bias rows have i = -1."""
    parts = []
    for fold, p in models.items():
        for name, v in p.items():
            j, i = np.indices(v.shape) if v.ndim == 2 else (np.arange(v.size), np.full(v.size, -1))
            parts.append(
                pa.table(
                    {
                        "fold": pa.array(np.full(v.size, fold, np.int64)),
                        "layer": pa.array([name] * v.size),
                        "i": np.asarray(i).ravel().astype(np.int32),
                        "j": np.asarray(j).ravel().astype(np.int32),
                        "w": v.ravel(),
                    }
                )
            )
    return spark.createDataFrame(pa.concat_tables(parts))


def save_params(spark: SparkSession, models: Mapping[int, Params], path: str) -> None:
    params_table(spark, models).write.mode("overwrite").partitionBy("fold").parquet(path)


def load_params(spark: SparkSession, path: str, cfg: Config, widths: Mapping[str, int]) -> dict[int, Params]:
    """Parameters of every fold; the row count is checked against the model before they are fetched."""
    table = spark.read.parquet(path)
    size = sum(int(np.prod(s)) for s in shapes(cfg, widths).values())
    folds = table.groupBy("fold").count().collect()
    if any(r["count"] != size for r in folds):
        raise ValueError(f"{path} holds another model: expected {size} parameters per fold")
    out = {}
    for r in folds:
        rows = table.where(F.col("fold") == r["fold"]).toPandas()
        p = {}
        for name, shape in shapes(cfg, widths).items():
            part = rows[rows["layer"] == name]
            p[name] = np.zeros(shape)
            at = (part["j"], part["i"]) if len(shape) == 2 else (part["j"],)
            p[name][tuple(c.to_numpy() for c in at)] = part["w"].to_numpy()
        out[int(r["fold"])] = p
    return out


# --- scoring ------------------------------------------------------------------------------

OUTPUTS = ("prob", "logits", "gates", "tcp", "fused", "loss")


def out_fields(cfg: Config, outputs) -> list[T.StructField]:
    vector, number = T.ArrayType(T.DoubleType()), T.DoubleType()
    names = []
    for o in outputs:
        if o not in OUTPUTS:
            raise ValueError(f"unknown output {o!r}, choose from {OUTPUTS}")
        if o in ("gates", "tcp") and cfg.model != "dynamic":
            raise ValueError(f"{o} needs the dynamic model")
        if o == "gates":
            names += [(f"gate_{m}", vector) for m in cfg.modalities]
        elif o == "tcp":
            names += [(f"{c}_{m}", number) for m in cfg.modalities for c in ("tcp_pred", "tcp_true")]
        else:
            names.append((o, number if o == "loss" else vector))
    return [T.StructField(n, t) for n, t in names]


def batch_outputs(state: dict, cfg: Config, outputs, y, w) -> list:
    cols = []
    for o in outputs:
        if o == "gates":
            cols += [as_lists(r["gate"]) for r in state["views"]]
        elif o == "tcp":
            for r in state["views"]:
                cols += [pa.array(r["c"]), pa.array(softmax(r["t"])[np.arange(len(y)), y])]
        elif o == "loss":
            cols.append(pa.array(row_loss(state, cfg, y, w)))
        else:
            cols.append(as_lists(softmax(state["logits"]) if o == "prob" else state[o]))
    return cols


def score(
    df: DataFrame,
    models: Mapping[int, Params],
    cfg: Config,
    keep: list[str],
    outputs=("prob",),
    class_weights: Mapping[int, list[float]] | None = None,
) -> DataFrame:
    """Forward pass over rows with a ``fold`` column and one vector column per modality.

    Each row is scored by the parameters of its fold. A NULL vector is a missing
    modality and adds nothing; a NULL fold is an error. ``tcp`` and ``loss`` read the label column ``y``.
    """
    fields = out_fields(cfg, outputs)
    labelled = {"tcp", "loss"} & set(outputs)
    columns = list(dict.fromkeys([*keep, "fold", *(["y"] if labelled else []), *cfg.modalities]))
    schema = T.StructType([*df.select(*keep).schema.fields, *fields])
    size = sum(v.nbytes for p in models.values() for v in p.values())
    if size > BROADCAST_LIMIT and len(models) > 1:
        parts = [
            score(df.where(F.col("fold") == f), {f: p}, cfg, keep, outputs, class_weights)
            for f, p in models.items()
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    if size > BROADCAST_LIMIT:
        from modalweave.operators import wide  # it is built on this module

        widths = {m: p[f"{m}.enc.w"].shape[1] for p in models.values() for m in cfg.modalities}
        model = wide.WideModel(params_table(df.sparkSession, models), cfg, widths, wide.BLOCK)
        return model.score(df, keep, outputs)
    sent = df.sparkSession.sparkContext.broadcast(
        ({f: p for f, p in models.items()}, {f: np.asarray(c) for f, c in (class_weights or {}).items()})
    )

    def run(batches):
        by_fold, weights = sent.value
        for batch in batches:
            if batch.column("fold").null_count:
                raise ValueError("rows without a fold have no model; leave them out before scoring")
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(folds):
                rows = batch.take(pa.array(np.flatnonzero(folds == f)))
                p = by_fold[int(f)]
                xs = [as_matrix(rows.column(m), p[f"{m}.enc.w"].shape[1]) for m in cfg.modalities]
                present = [np.asarray(rows.column(m).is_valid(), np.float64) for m in cfg.modalities]
                y = rows.column("y").to_numpy(zero_copy_only=False).astype(np.int64) if labelled else None
                w = weights[int(f)][y] if labelled and weights else np.ones(rows.num_rows)
                state = forward(p, cfg, xs, present)
                cols = [rows.column(c) for c in keep] + batch_outputs(state, cfg, outputs, y, w)
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return df.select(*columns).mapInArrow(run, schema)
