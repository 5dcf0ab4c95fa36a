"""Whole experiments: prepare, train per fold, score, evaluate, explain, store."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.config import Config
from modalweave.functions import vectors as V
from modalweave.operators import baselines as B
from modalweave.operators import calibration as C
from modalweave.operators import folds as FO
from modalweave.operators import importance as I
from modalweave.operators import keys as K
from modalweave.operators import metrics as M
from modalweave.operators.fusion import load_params, save_params, score
from modalweave.operators.training import Fit, train
from modalweave.sources import sinks


@dataclass
class Prepared:
    """Cells with one vector per modality and their folds, class weights and widths."""

    cells: DataFrame
    plan: FO.FoldPlan
    folds: list[int]
    widths: dict[str, int]
    class_weights: dict[int, list[float]]


def prepare(meta: DataFrame, modalities: Mapping[str, DataFrame], cfg: Config) -> Prepared:
    """Join once for all folds. The split is drawn on the metadata ids, before the join.

    The joined cells are written to the shared folder, since every training step
    reads them. What is fetched has one row per fold, modality or class.
    """
    chosen = K.select_modalities(modalities, cfg.modalities)
    labelled = K.reject_unlabelled(K.map_label(K.keep_first(meta, ["cell_id"]), cfg.classes))
    plan = FO.fold_plan(labelled, fraction=cfg.val_fraction, seed=cfg.seed)
    cells = sinks.durable(FO.membership(K.align(labelled, chosen), plan), "cells")
    sizes = cells.agg(*[F.max(F.size(m)).alias(m) for m in cfg.modalities]).first()
    folds = [f.fold for f in plan.folds]
    train_sizes = (
        cells.select(F.explode("train_folds").alias("fold"), F.lit("train").alias("split"), "y")
        .groupBy("fold", "split", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    weights: dict[int, list[float]] = {f: [float("nan")] * cfg.n_classes for f in folds}
    for r in FO.class_weights(train_sizes, cfg.n_classes).collect():
        if r["weight"] is not None:
            weights[r["fold"]][r["y"]] = r["weight"]
    return Prepared(cells, plan, folds, {m: sizes[m] for m in cfg.modalities}, weights)


def target_rows(data: Prepared) -> DataFrame:
    rows = data.cells.where(F.col("donor").isNotNull())
    return rows.withColumn("fold", F.col("donor").cast("bigint")).drop("train_folds", "val_folds")


def masked_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    """The masked modalities are uniform vectors; a missing one stays missing."""
    for name in cfg.masked:
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), V.fill_like(F.col(name), cfg.mask_value)))
    return rows


def val_rows(data: Prepared) -> DataFrame:
    return data.cells.withColumn("fold", F.explode("val_folds")).drop("train_folds", "val_folds")


def predict(rows: DataFrame, models, cfg: Config) -> DataFrame:
    scored = score(rows, models, cfg, ["fold", "cell_id", "y"], ("prob",))
    return M.with_prediction(scored).select("fold", "cell_id", F.col("y").alias("y_true"), "y_pred", "prob")


def fit(data: Prepared, cfg: Config) -> Fit:
    held_out = val_rows(data).persist()

    def validated(models) -> dict[int, dict[str, float]]:
        own = held_out.where(F.col("fold").isin(list(models)))
        rows = M.evaluate(predict(own, models, cfg), ["fold"]).select("fold", *M.METRICS).collect()
        return {r["fold"]: {m: r[m] for m in M.METRICS} for r in rows}

    try:
        return train(data.cells, data.folds, data.widths, cfg, data.class_weights, validated)
    finally:
        held_out.unpersist()


@dataclass
class Outcome:
    predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame
    confusion: DataFrame
    fit: Fit | None


def cross_validate(meta: DataFrame, modalities: Mapping[str, DataFrame], cfg: Config) -> Outcome:
    """Train and test one model per fold; with ``test_only`` the parameters are read from ``weights_dir``."""
    return run(prepare(meta, modalities, cfg), cfg)


def run(data: Prepared, cfg: Config) -> Outcome:
    spark = data.cells.sparkSession
    if cfg.test_only:
        if not cfg.weights_dir:
            raise ValueError("test_only needs weights_dir")
        done, models = None, load_params(spark, cfg.weights_dir, cfg, data.widths)
    else:
        done = fit(data, cfg)
        models = done.models
    preds = predict(masked_rows(target_rows(data), cfg), models, cfg).withColumn("model", F.lit(cfg.model))
    by = ["model", "fold"]
    counts = sinks.durable(M.confusion(preds, by), "confusion")  # scored once for all result tables
    metrics = M.metrics_of(M.per_class(counts, by), by)
    grid = M.confusion_grid(counts, by, cfg.n_classes)
    return Outcome(
        preds, metrics, M.over_folds(metrics, ["model"]), M.confusion_over_folds(grid, ["model"]), done
    )


def write_outcome(out: Outcome, cfg: Config, attempt: int = 0) -> str:
    """Metric tables, confusion matrices, parameters, the options and the epoch log of a run.

    Everything is written under the run's name, and the rows of the common tables ``runs`` and ``log`` under run and
    attempt, so writing again replaces what an earlier try has left.
    """
    spark = out.metrics.sparkSession
    here = sinks.run_path(cfg.results, cfg.run_name)
    sinks.write_run(spark, asdict(cfg), f"{cfg.results.rstrip('/')}/runs", cfg.run_name, attempt)
    means = [c for c in out.summary.columns if c.endswith("_mean")]
    sds = [c for c in out.summary.columns if c.endswith("_sd_samp")]
    sinks.write_metrics(out.summary.select("model", *means), f"{here}/metrics_mean")
    sinks.write_metrics(out.summary.select("model", *sds), f"{here}/metrics_std")
    sinks.write_confusion(out.confusion, "n_mean", cfg.n_classes, f"{here}/cfm_mean")
    sinks.write_confusion(out.confusion, "n_sd_pop", cfg.n_classes, f"{here}/cfm_std")
    if out.fit is not None:
        save_params(spark, out.fit.models, f"{here}/weights")
        if out.fit.log:
            log = spark.createDataFrame(out.fit.log, "fold bigint, epoch int, metric string, value double")
            sinks.append_log(log, f"{cfg.results.rstrip('/')}/log", cfg.run_name, attempt)
    return here


def component_ablation(meta, modalities, cfg: Config) -> DataFrame:
    """Gate on or off times confidence on or off, all on the same prepared cells."""
    data = prepare(meta, modalities, cfg)
    parts = []
    for gate in (cfg.feature_import_loss, None):
        for conf in (cfg.modality_import_loss, None):
            switched = cfg.with_(model="dynamic", feature_import_loss=gate, modality_import_loss=conf)
            out = run(data, switched).metrics
            parts.append(
                out.withColumn("gate", F.lit(gate is not None)).withColumn("confidence", F.lit(conf is not None))
            )
    return reduce(DataFrame.unionByName, parts)


def modality_sets(names: list[str]) -> dict[str, list[str]]:
    """Each modality alone, and all of them."""
    return {n: [n] for n in names} | ({"both": list(names)} if len(names) > 1 else {})


def modality_ablation(meta, modalities: Mapping[str, DataFrame], classes, models=("KNN",)) -> DataFrame:
    """Baseline metrics per modality set, model and fold on concatenated vectors."""
    labelled = K.reject_unlabelled(K.map_label(K.keep_first(meta, ["cell_id"]), classes))
    parts = []
    for name, members in modality_sets(list(modalities)).items():
        cells = K.early_fusion(labelled, {m: modalities[m] for m in members})
        preds = B.run_baselines(cells, models)
        parts.append(M.evaluate(preds, ["model", "fold"]).withColumn("modalities", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def gate_rows(data: Prepared, models, cfg: Config, weights_fold: int | None = None) -> DataFrame:
    """``(fold, cell_id, modality, gate)`` of the test rows; ``weights_fold`` scores all folds by one model."""
    used = models if weights_fold is None else {f: models[weights_fold] for f in data.folds}
    scored = score(target_rows(data), used, cfg, ["fold", "cell_id"], ("gates",))
    views = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"gate_{m}").alias("gate")) for m in cfg.modalities])
    return scored.select("fold", "cell_id", F.inline(views))


def tcp_rows(data: Prepared, models, cfg: Config, weights_fold: int | None = None) -> DataFrame:
    """``(fold, cell_id, modality, tcp_true, tcp_pred)`` of the test rows."""
    used = models if weights_fold is None else {f: models[weights_fold] for f in data.folds}
    scored = score(target_rows(data), used, cfg, ["fold", "cell_id", "y"], ("tcp",))
    views = F.array(
        *[
            F.struct(
                F.lit(m).alias("modality"),
                F.col(f"tcp_true_{m}").alias("tcp_true"),
                F.col(f"tcp_pred_{m}").alias("tcp_pred"),
            )
            for m in cfg.modalities
        ]
    )
    return scored.select("fold", "cell_id", F.inline(views))


def importance_report(
    data: Prepared, models, cfg: Config, names: Mapping[str, list[str]], k: int = 10, weights_fold: int | None = None
) -> DataFrame:
    """Named top and bottom features per fold and modality."""
    means = I.mean_importance(gate_rows(data, models, cfg, weights_fold), ["fold", "modality"])
    listed = I.extremes(means, ["fold", "modality"], k)
    return listed.withColumn("name", K.feature_name(names, F.col("modality"), F.col("idx")))


def calibration_report(
    data: Prepared, models, cfg: Config, cumulative: bool = False, weights_fold: int | None = None
) -> dict[str, DataFrame]:
    pairs = tcp_rows(data, models, cfg, weights_fold)
    if cumulative:
        pairs = C.pool_modalities(pairs, list(cfg.modalities))
    pairs = sinks.durable(pairs, "tcp")  # scored once for all tables of the report
    shares = C.threshold_shares(pairs, ["fold", "modality"], digits=None)
    return {
        "errors": C.error_summary(pairs, ["fold", "modality"]),
        "shares": shares,
        "summary": C.shares_summary(shares),
        "running": C.running_summary(shares),
    }
