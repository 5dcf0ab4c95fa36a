"""The registered queries: every operator on the driver's tables.

Each entry takes ``(spark, sf_dir)``. Column names match the SQL in ``plans.oracle``;
fractions are rounded to 6 digits, whole numbers are 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalweave.config import META_COLUMNS, Config
from modalweave.functions import vectors as V
from modalweave.operators import attention as A
from modalweave.operators import baselines as B
from modalweave.operators import calibration as C
from modalweave.operators import folds as FO
from modalweave.operators import fusion as FU
from modalweave.operators import importance as I
from modalweave.operators import keys as K
from modalweave.operators import matrix as X
from modalweave.operators import metrics as M
from modalweave.operators import neighbours as N
from modalweave.operators import raster as R
from modalweave.operators import tiles as TL
from modalweave.operators import training as TR
from modalweave.operators.skew import salted_join
from modalweave.operators.wide import WideModel
from modalweave.plans import experiment as E
from modalweave.sources import roles, sinks, tables
from modalweave.sources.images import image_vectors
from modalweave.sources.roles import (
    EVENT_TYPES,
    LANGS,
    PRIORITIES,
    PROTEIN_NAMES,
    doc_meta,
    doc_modalities,
    doc_protein,
    doc_rna,
    load,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A three-token kernel of a 3x3 focal sum, an edge filter and a 2x2 filter with two outputs.
KERNEL3 = [(dy, dx, 0, 0, (dy + 2) * 0.25 + dx * 0.125) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
KERNEL2 = [(dy, dx, 0, co, 0.5 - 0.25 * dy + 0.125 * dx + co) for dy in (0, 1) for dx in (0, 1) for co in (0, 1)]
LATENTS = [[0.5, -0.25, 1.0], [-0.5, 0.75, 0.25], [1.0, 1.0, -1.0]]
DYNAMIC = Config(
    modalities=("protein", "rna"),
    hidden_dims=(4, 8),
    model="dynamic",
    classification_loss_weight=1.3,
    feature_import_loss=0.7,
    modality_import_loss=0.9,
    classes=LANGS,
)
STATIC = Config(
    modalities=("protein", "rna"), hidden_dims=(4, 8), model="static", modality_weights=(3.0, 1.0), classes=LANGS
)
WIDTHS = {"protein": 6, "rna": 64}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else "value"))


def i64(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or (c if isinstance(c, str) else "value"))


def elements(vec: str | Column, n: int, prefix: str) -> list[Column]:
    """The first ``n`` positions of a vector as rounded columns."""
    col = F.col(vec) if isinstance(vec, str) else vec
    return [r6(F.get(col, F.lit(i)), f"{prefix}{i}") for i in range(n)]


def indexed(df: DataFrame, keys: list[str], vector: Column, name: str) -> DataFrame:
    """One row per vector element."""
    return V.unfold(df, keys, vector, name).select(*keys, i64("idx"), r6(name))


def cells(spark, sf) -> DataFrame:
    """Labelled documents, one row per cell."""
    return K.reject_unlabelled(K.map_label(K.keep_first(doc_meta(spark, sf), ["cell_id"]), LANGS))


def split_cells(spark, sf) -> DataFrame:
    base = cells(spark, sf)
    return FO.expand_folds(base, FO.fold_plan(base))


def order_cells(spark, sf) -> DataFrame:
    return K.reject_unlabelled(K.map_label(roles.order_meta(spark, sf), PRIORITIES))


def order_folds(spark, sf) -> DataFrame:
    base = order_cells(spark, sf).select("cell_id", "donor", "y")
    return FO.expand_folds(base, FO.fold_plan(base))


def fused_cells(spark, sf) -> DataFrame:
    """Cells with both vector modalities; the fold is the one the cell is tested in."""
    two = {"protein": doc_protein(spark, sf), "rna": doc_rna(spark, sf)}
    return K.align(cells(spark, sf), two).withColumn("fold", F.col("donor"))


def document_weights(spark, sf) -> dict[int, list[float]]:
    """Class weights per fold (one row per fold and class)."""
    rows = FO.class_weights(FO.split_sizes(split_cells(spark, sf)), len(LANGS)).collect()
    out: dict[int, list[float]] = {}
    for r in rows:
        weight = float("nan") if r["weight"] is None else r["weight"]
        out.setdefault(r["fold"], [0.0] * len(LANGS))[r["y"]] = weight
    return out


def scored(spark, sf, cfg: Config, outputs, keep=("cell_id", "fold", "y"), rows=None, weights=None) -> DataFrame:
    rows = fused_cells(spark, sf) if rows is None else rows
    folds = [r[0] for r in FO.fold_list(doc_meta(spark, sf)).collect()]
    params = FU.formula_params(cfg, WIDTHS)
    return FU.score(rows, {f: params for f in folds}, cfg, list(keep), outputs, weights)


# --- preparation --------------------------------------------------------------------------


@query
def meta_join_modality(spark, sf):
    joined = K.join_modality(doc_meta(spark, sf), doc_protein(spark, sf))
    return joined.select("cell_id", "cell_type", i64("donor"), *elements("features", 6, "f"))


@query
def early_fusion_join(spark, sf):
    two = {"protein": doc_protein(spark, sf), "rna": doc_rna(spark, sf)}
    fused = K.early_fusion(doc_meta(spark, sf), two)
    return fused.select(
        "cell_id",
        i64("donor"),
        "cell_type",
        i64(F.size("features"), "n_features"),
        r6(V.total(F.col("features")), "total"),
        r6(F.element_at("features", 1), "first"),
        r6(F.element_at("features", -1), "last"),
    )


@query
def early_fusion_meta_keys(spark, sf):
    meta = doc_meta(spark, sf)
    left = K.join_modality(meta, doc_protein(spark, sf)).withColumnRenamed("features", "protein")
    right = K.join_modality(meta, doc_rna(spark, sf)).withColumnRenamed("features", "rna")
    both = K.join_null_safe(left, right, META_COLUMNS)
    return both.select(
        "cell_id",
        "day",
        i64("donor"),
        "technology",
        "cell_type",
        r6(V.total(F.col("protein")), "protein_total"),
        r6(V.total(F.col("rna")), "rna_total"),
    )


@query
def three_way_fusion_join(spark, sf):
    fused = K.early_fusion(doc_meta(spark, sf), doc_modalities(spark, sf))
    return fused.select(
        "cell_id", i64("donor"), i64(F.size("features"), "n_features"), r6(V.total(F.col("features")), "total")
    )


@query
def sample_aligned(spark, sf):
    rows = K.align(cells(spark, sf), doc_modalities(spark, sf))
    widths = [i64(F.size(m), f"{m}_width") for m in ("protein", "rna", "tags")]
    return rows.select("cell_id", i64("y"), *widths, *elements("tags", 2, "tag"))


@query
def missing_modality_rows(spark, sf):
    rows = K.align(cells(spark, sf), doc_modalities(spark, sf), missing="keep")
    flags = [f"has_{m}" for m in ("protein", "rna", "tags")]
    return rows.select("cell_id", *flags, i64(sum((F.col(f).cast("int") for f in flags), F.lit(0)), "n_present"))


@query
def first_line_in_file(spark, sf):
    """Of every supplier the order line that stands first in the file, which is not its smallest."""
    lines = load(spark, sf, "lineitem")
    lines = lines.select("l_suppkey", "l_orderkey", "l_linenumber", tables.position(indexed=True).alias(tables.POSITION))
    return tables.first_in_file(lines, ["l_suppkey"]).select(i64("l_suppkey"), i64("l_orderkey"), i64("l_linenumber"))


@query
def dedup_keep_first(spark, sf):
    first = K.keep_first(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return first.withColumn("l_linenumber", i64("l_linenumber")).withColumn(
        "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")
    )


@query
def semi_join_ids(spark, sf):
    ids = load(spark, sf, "labels").select(F.col("doc_id").alias("cell_id"))
    return K.semi_join(cells(spark, sf), ids).select("cell_id", i64("y"))


@query
def fold_list(spark, sf):
    return FO.fold_list(doc_meta(spark, sf)).select(i64("donor", "fold"))


@query
def lodo_split(spark, sf):
    return split_cells(spark, sf).select("fold", "cell_id", (F.col("split") == "test").alias("is_test"))


@query
def train_val_split(spark, sf):
    return split_cells(spark, sf).select("fold", "cell_id", "split")


@query
def fold_membership(spark, sf):
    base = cells(spark, sf)
    rows = FO.membership(base, FO.fold_plan(base))
    return rows.select(
        "cell_id",
        i64("donor", "test_fold"),
        i64(F.size("train_folds"), "n_train"),
        i64(F.size("val_folds"), "n_val"),
        F.concat_ws(",", F.array_sort("train_folds").cast("array<string>")).alias("train_in"),
    )


@query
def hash_val_split(spark, sf):
    return cells(spark, sf).select("cell_id", FO.hash_split().alias("is_val"))


@query
def split_sizes(spark, sf):
    sizes = FO.split_sizes(split_cells(spark, sf))
    return sizes.select("fold", "split", i64("y"), "n")


@query
def split_by_modality(spark, sf):
    base = cells(spark, sf)
    totals = [
        table.select("cell_id", F.lit(name).alias("modality"), V.total(F.col("features")).alias("total"))
        for name, table in ((n, K.keep_first(t, ["cell_id"])) for n, t in doc_modalities(spark, sf).items())
    ]
    rows = base.join(reduce(DataFrame.unionByName, totals), "cell_id")
    return (
        FO.expand_folds(rows, FO.fold_plan(base))
        .groupBy("fold", "split", "modality")
        .agg(F.count(F.lit(1)).alias("n"), i64(F.sum("y"), "y_sum"), r6(F.sum("total"), "total"))
    )


@query
def class_weights(spark, sf):
    weights = FO.class_weights(FO.split_sizes(split_cells(spark, sf)), len(LANGS))
    return weights.select("fold", i64("y"), "n", r6("frequency"), r6("weight"))


@query
def minibatch_counts(spark, sf):
    rows = FO.assign_batches(split_cells(spark, sf), batch_size=64, epochs=3)
    return rows.groupBy("fold", i64("epoch"), i64("batch")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_map(spark, sf):
    return K.map_label(doc_meta(spark, sf), LANGS).select("cell_id", "cell_type", i64("y"))


@query
def drop_columns(spark, sf):
    rows = K.map_label(K.join_modality(doc_meta(spark, sf), doc_protein(spark, sf)), LANGS)
    model_input = rows.drop("day", "donor", "technology", "cell_type")
    return model_input.select("cell_id", i64("y"), *elements("features", 6, "f"))


@query
def modality_width(spark, sf):
    tables = doc_modalities(spark, sf, dealt=False) | {"image": doc_rna(spark, sf)}
    widths = K.feature_widths(tables, {"image": "image"})
    return widths.select("modality", "kind", i64("width"), "n_rows")


@query
def named_features(spark, sf):
    named = K.name_features(doc_protein(spark, sf), "features", PROTEIN_NAMES)
    return named.select("cell_id", i64("idx"), "name", r6("value"))


@query
def orders_fused(spark, sf):
    lines = roles.order_lines(spark, sf).withColumnRenamed("features", "lines")
    owner = roles.customer_features(spark, sf).withColumnRenamed("features", "owner")
    joined = salted_join(order_cells(spark, sf), owner, ["custkey"]).join(lines, "cell_id")
    fused = joined.withColumn("features", V.concat_views([F.col("lines"), F.col("owner")]))
    return fused.select("cell_id", i64("donor"), i64("y"), *elements("features", 7, "f"))


@query
def orders_split_sizes(spark, sf):
    return FO.split_sizes(order_folds(spark, sf)).select("fold", "split", i64("y"), "n")


@query
def orders_class_weights(spark, sf):
    weights = FO.class_weights(FO.split_sizes(order_folds(spark, sf)), len(PRIORITIES))
    return weights.select("fold", i64("y"), "n", r6("frequency"), r6("weight"))


# --- vector functions ---------------------------------------------------------------------


def embeddings(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"), V.as_doubles(F.col("embedding")).alias("x"), F.col("label").alias("y")
    )


@query
def sigmoid_gate(spark, sf):
    rows = embeddings(spark, sf)
    gated = rows.select("cell_id", V.multiply(F.col("x"), V.sigmoid_each(F.col("x"))).alias("g"))
    return indexed(gated, ["cell_id"], F.col("g"), "gated")


@query
def relu_vec(spark, sf):
    return indexed(embeddings(spark, sf), ["cell_id"], V.relu_each(F.col("x")), "relu")


@query
def cast_features(spark, sf):
    stored = load(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding")
    wide = stored.withColumn("d", V.as_doubles(F.col("embedding")))
    narrow = wide.withColumn("f", F.col("d").cast("array<float>"))
    same = F.forall(F.zip_with("f", "embedding", lambda a, b: a == b), lambda t: t)
    return narrow.select("cell_id", same.alias("same"), r6(V.total(F.col("d")), "total"))


@query
def softmax_probs(spark, sf):
    rows = roles.logits(spark, sf).withColumn("p", V.softmax(F.col("z")))
    return rows.select("cell_id", *elements("p", 5, "p"))


@query
def resoftmax_argmax(spark, sf):
    rows = roles.logits(spark, sf).withColumn("p", V.softmax(F.col("z")))
    again = rows.withColumn("pp", V.softmax(F.col("p")))
    return again.select("cell_id", i64(V.argmax(F.col("p")), "once"), i64(V.argmax(F.col("pp")), "twice"))


@query
def true_class_prob(spark, sf):
    rows = roles.logits(spark, sf)
    return rows.select("cell_id", "fold", r6(V.pick(V.softmax(F.col("z")), F.col("y_true")), "tcp"))


@query
def one_hot(spark, sf):
    hot = roles.predictions(spark, sf).withColumn("h", V.one_hot(F.col("y_true"), 5))
    return hot.select("cell_id", *elements("h", 5, "h"))


@query
def argmax_pred(spark, sf):
    rows = roles.logits(spark, sf).withColumn("q", F.transform("z", lambda v: F.round(v, 0)))
    return rows.select("cell_id", i64(V.argmax(F.col("z")), "y_pred"), i64(V.argmax(F.col("q")), "first_of_ties"))


@query
def weighted_concat(spark, sf):
    rows = K.align(cells(spark, sf), doc_modalities(spark, sf))
    vec = V.concat_views([F.col("protein"), F.col("rna"), F.col("tags")], [3, 1, 6])
    return indexed(rows.select("cell_id", vec.alias("v")), ["cell_id"], F.col("v"), "value")


@query
def confidence_scale(spark, sf):
    rows = embeddings(spark, sf).withColumn("c", F.sin(F.col("cell_id").cast("double")))
    return indexed(rows, ["cell_id"], V.scale(F.col("x"), F.col("c")), "scaled")


@query
def layer_norm(spark, sf):
    return indexed(embeddings(spark, sf), ["cell_id"], V.layer_norm(F.col("x")), "normed")


@query
def residual_add(spark, sf):
    rows = embeddings(spark, sf).withColumn("s", V.add(F.col("x"), V.layer_norm(F.col("x"))))
    return rows.select("cell_id", *elements("s", 8, "s"), r6(V.total(F.col("s")), "total"))


@query
def fourier_encode(spark, sf):
    events = load(spark, sf, "events").select("event_id", (F.col("event_id") % 100 / 100.0).alias("p"))
    return events.select("event_id", *elements(V.fourier_encode(F.col("p"), bands=2, max_freq=4.0), 5, "e"))


@query
def mask_modality(spark, sf):
    rows = K.align(cells(spark, sf), {"rna": doc_rna(spark, sf)})
    rows = FO.expand_folds(rows, FO.fold_plan(cells(spark, sf)))
    masked = rows.withColumn("m", V.mask_modality(F.col("rna"), F.col("split"), 0.5))
    return masked.select("fold", "cell_id", "split", *elements("m", 4, "m"), r6(V.total(F.col("m")), "total"))


@query
def error_terms(spark, sf):
    gap = F.col("tcp_true") - F.col("tcp_pred")
    return roles.predictions(spark, sf).select(
        "cell_id",
        r6(F.abs(gap), "abs_error"),
        r6(F.pow(gap, 2), "sq_error"),
        r6(F.try_divide(F.abs(gap), F.col("tcp_true")), "rel_error"),
    )


@query
def vector_distance(spark, sf):
    rows = K.align(cells(spark, sf), {"rna": doc_rna(spark, sf)})
    unit = V.layer_norm(F.col("rna"))
    return rows.select("cell_id", r6(V.euclidean(F.col("rna"), unit), "distance"))


# --- evaluation ---------------------------------------------------------------------------


def fold_grid(spark, sf) -> DataFrame:
    return M.confusion_grid(M.confusion(roles.predictions(spark, sf), ["fold"]), ["fold"], len(EVENT_TYPES))


@query
def confusion_matrix(spark, sf):
    return fold_grid(spark, sf).select("fold", i64("y_true"), i64("y_pred"), "n")


@query
def confusion_out_of_grid(spark, sf):
    """Three classes declared, five found, one of them read as NULL."""
    preds = roles.predictions(spark, sf).withColumn("y_true", F.nullif("y_true", F.lit(1)))
    grid = M.confusion_grid(M.confusion(preds, ["fold"]), ["fold"], 3)
    return grid.select("fold", i64("y_true"), i64("y_pred"), "n")


@query
def confusion_wide(spark, sf):
    total = fold_grid(spark, sf).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    wide = sinks.confusion_wide(total, "n", len(EVENT_TYPES))
    return wide.select(i64("y_true"), *[F.col(str(k)).alias(f"pred{k}") for k in range(len(EVENT_TYPES))])


@query
def confusion_mean_std(spark, sf):
    stats = M.confusion_over_folds(fold_grid(spark, sf), [])
    return stats.select(i64("y_true"), i64("y_pred"), r6("n_mean"), r6("n_sd_pop"))


@query
def per_class_prf(spark, sf):
    classes = M.per_class(M.confusion(roles.predictions(spark, sf), ["fold"]), ["fold"])
    return classes.select(
        "fold", i64("label"), "tp", "support", "predicted", r6("precision"), r6("recall"), r6("f1")
    )


@query
def weighted_macro_metrics(spark, sf):
    return M.evaluate(roles.predictions(spark, sf), ["fold"]).select("fold", *[r6(m) for m in M.METRICS])


@query
def balanced_accuracy(spark, sf):
    rows = M.evaluate(roles.predictions(spark, sf), ["fold", "modality"])
    return rows.select("fold", "modality", r6("accuracy"), r6("balanced_accuracy"))


@query
def result_rows(spark, sf):
    rows = M.result_rows(M.evaluate(roles.predictions(spark, sf), ["fold"]), STATIC.run_name)
    return rows.select("model", "fold", *[r6(m) for m in M.METRICS])


@query
def metrics_mean_std(spark, sf):
    by = ["modality", "fold"]
    summary = M.over_folds(M.evaluate(roles.predictions(spark, sf), by), ["modality"])
    return summary.select("modality", "n_folds", *[r6(f"{m}_{s}") for s in ("mean", "sd_samp") for m in M.METRICS])


@query
def best_epoch(spark, sf):
    log = M.evaluate(roles.predictions(spark, sf), ["fold", "epoch"])
    rounded = log.withColumn("f1_macro", F.round("f1_macro", 1))
    return M.best_epoch(rounded, ["fold"]).select("fold", i64("epoch"), r6("f1_macro"))


@query
def epoch_loss(spark, sf):
    rows = roles.logits(spark, sf).withColumn("loss", V.cross_entropy(F.col("z"), F.col("y_true")))
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(2))))
    batches = epochs.withColumn("batch", FO.batch_id("cell_id", F.col("epoch"), F.lit(8)))
    losses = M.loss_per_epoch(batches)
    return losses.select("fold", i64("epoch"), r6("loss_sum"), r6("loss_mean"))


# --- models -------------------------------------------------------------------------------


def linear_weights(n_in: int, n_out: int) -> tuple[list[list[float]], list[float]]:
    p = FU.formula_params(
        Config(modalities=("a",), hidden_dims=(n_in,), model="static", classes={str(k): k for k in range(n_out)}),
        {"a": 1},
    )
    return p["out.w"].tolist(), p["out.b"].tolist()


@query
def linear_layer(spark, sf):
    w, b = linear_weights(64, 4)
    rows = X.linear_rows(doc_rna(spark, sf), w, b)
    return rows.select("cell_id", *elements("out", 4, "out"))


@query
def linear_layer_join(spark, sf):
    w, b = linear_weights(64, 4)
    rows = [(-1, b)] + [(i, [w[j][i] for j in range(4)]) for i in range(64)]
    table = spark.createDataFrame(rows, "i int, w array<double>")
    out = X.linear_join(doc_rna(spark, sf), table, 4)
    return out.select("cell_id", *[r6(f"out{j}") for j in range(4)])


@query
def static_fusion_logits(spark, sf):
    rows = M.with_prediction(scored(spark, sf, STATIC, ("logits", "prob")))
    return rows.select("cell_id", i64("y"), *elements("logits", 4, "z"), i64("y_pred"))


@query
def dynamic_fusion_logits(spark, sf):
    rows = M.with_prediction(scored(spark, sf, DYNAMIC, ("logits", "prob")))
    return rows.select("cell_id", i64("y"), *elements("logits", 4, "z"), i64("y_pred"))


@query
def wide_fusion_logits(spark, sf):
    """The model of ``dynamic_fusion_logits`` in blocks of 16, as if its gates were too wide to be sent."""
    folds = [r[0] for r in FO.fold_list(doc_meta(spark, sf)).collect()]
    params = FU.params_table(spark, dict.fromkeys(folds, FU.formula_params(DYNAMIC, WIDTHS)))
    model = WideModel(params, DYNAMIC, WIDTHS, block=16)
    return model.score(fused_cells(spark, sf), ["cell_id"], ("logits",)).select("cell_id", *elements("logits", 4, "z"))


@query
def ungated_fusion_logits(spark, sf):
    cfg = DYNAMIC.with_(feature_import_loss=None, modality_import_loss=None)
    return scored(spark, sf, cfg, ("logits",)).select("cell_id", *elements("logits", 4, "z"))


@query
def fusion_embedding(spark, sf):
    return indexed(scored(spark, sf, DYNAMIC, ("fused",)), ["cell_id"], F.col("fused"), "value")


@query
def missing_modality_logits(spark, sf):
    two = {"protein": doc_protein(spark, sf), "rna": doc_rna(spark, sf)}
    rows = K.align(cells(spark, sf), two, missing="keep").withColumn("fold", F.col("donor"))
    out = scored(spark, sf, STATIC, ("logits",), keep=("cell_id", "has_rna"), rows=rows)
    return out.select("cell_id", "has_rna", *elements("logits", 4, "z"))


@query
def masked_modality_logits(spark, sf):
    """The static model when the second modality of the test rows is masked by a uniform vector."""
    cfg = STATIC.with_(masked=("rna",), mask_value=0.5)
    rows = M.with_prediction(scored(spark, sf, cfg, ("logits", "prob"), rows=E.masked_rows(fused_cells(spark, sf), cfg)))
    return rows.select("cell_id", i64("y"), *elements("logits", 4, "z"), i64("y_pred"))


def gates(spark, sf) -> DataFrame:
    out = scored(spark, sf, DYNAMIC, ("gates",))
    views = F.array(
        *[F.struct(F.lit(m).alias("modality"), F.col(f"gate_{m}").alias("gate")) for m in DYNAMIC.modalities]
    )
    return out.select("cell_id", "fold", F.inline(views))


def tcp_pairs_long(spark, sf) -> DataFrame:
    out = scored(spark, sf, DYNAMIC, ("tcp",))
    views = F.array(
        *[
            F.struct(
                F.lit(m).alias("modality"),
                F.col(f"tcp_true_{m}").alias("tcp_true"),
                F.col(f"tcp_pred_{m}").alias("tcp_pred"),
            )
            for m in DYNAMIC.modalities
        ]
    )
    return out.select("cell_id", "fold", F.inline(views))


@query
def fusion_gates(spark, sf):
    return indexed(gates(spark, sf), ["cell_id", "modality"], F.col("gate"), "gate")


@query
def tcp_pairs(spark, sf):
    return tcp_pairs_long(spark, sf).select("cell_id", "fold", "modality", r6("tcp_true"), r6("tcp_pred"))


@query
def fusion_loss(spark, sf):
    rows = scored(spark, sf, DYNAMIC, ("loss",), weights=document_weights(spark, sf))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("loss"), "loss"))


@query
def weighted_ce(spark, sf):
    weight = F.element_at(F.array(*[F.lit(0.5 + 0.25 * k) for k in range(5)]), F.col("y_true") + 1)
    rows = roles.logits(spark, sf).withColumn("l", V.cross_entropy(F.col("z"), F.col("y_true"), weight))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l"), "loss"))


@query
def confidence_mse(spark, sf):
    gap = F.col("tcp_pred") - F.col("tcp_true")
    pairs = roles.predictions(spark, sf)
    return pairs.groupBy("fold", "modality").agg(r6(F.avg(gap * gap), "mse"))


@query
def gate_penalty(spark, sf):
    return I.gate_penalty(gates(spark, sf), ["fold", "modality"]).select("fold", "modality", r6("gate_mean"))


@query
def gradient_step(spark, sf):
    w, b = linear_weights(6, 4)
    rows = K.align(cells(spark, sf), {"features": doc_protein(spark, sf)})
    grad = X.softmax_gradient(rows, V.affine(F.col("features"), w, b), ["donor"], 4)
    return grad.select(i64("donor", "fold"), i64("i"), i64("j"), r6("gradient"))


def baseline_cells(spark, sf, modality: str) -> DataFrame:
    return K.align(cells(spark, sf), {"features": doc_modalities(spark, sf)[modality]})


@query
def knn_neighbours(spark, sf):
    near = N.k_nearest_of_others(sinks.durable(baseline_cells(spark, sf, "rna"), "cells"), 5)
    return near.select("fold", "cell_id", i64("rank"), "train_id", i64("y"), r6("distance"))


@query
def knn_neighbours_indexed(spark, sf):
    """With a metric index of sixteen pivots, whatever the table's size."""
    near = N.k_nearest_of_others(sinks.durable(baseline_cells(spark, sf, "rna"), "cells"), 5, pivots=16)
    return near.select("fold", "cell_id", i64("rank"), "train_id", i64("y"), r6("distance"))


@query
def knn_predict(spark, sf):
    preds = B.k_neighbours(baseline_cells(spark, sf, "rna"))
    return preds.select("fold", "cell_id", i64("y_true"), i64("y_pred"))


@query
def lodo_knn_eval(spark, sf):
    """Join, de-duplicate, split by donor, predict by 5 neighbours, evaluate, average over donors."""
    preds = B.k_neighbours(baseline_cells(spark, sf, "protein")).withColumn("model", F.lit("KNN"))
    summary = M.over_folds(M.evaluate(preds, ["model", "fold"]), ["model"])
    return summary.select("model", "n_folds", *[r6(f"{m}_{s}") for s in ("mean", "sd_samp") for m in M.METRICS])


@query
def modality_ablation_knn(spark, sf):
    two = {"protein": doc_protein(spark, sf), "rna": doc_rna(spark, sf)}
    results = E.modality_ablation(doc_meta(spark, sf), two, LANGS)
    return results.select("modalities", "model", "fold", *[r6(m) for m in M.METRICS])


def baseline_metrics(preds: DataFrame, model: str) -> DataFrame:
    return M.result_rows(M.evaluate(preds, ["fold"]), model)


@query
def logistic_baseline(spark, sf):
    return baseline_metrics(B.logistic_regression(baseline_cells(spark, sf, "protein")), "LR")


@query
def forest_baseline(spark, sf):
    return baseline_metrics(B.random_forest(baseline_cells(spark, sf, "protein")), "RF")


@query
def svm_baseline(spark, sf):
    return baseline_metrics(B.rbf_svm(baseline_cells(spark, sf, "protein")), "SVM")


@query
def dense_net_baseline(spark, sf):
    return baseline_metrics(B.dense_net(baseline_cells(spark, sf, "protein")), "NN")


def experiment_config(model: str) -> Config:
    return Config(
        modalities=("protein", "rna"),
        hidden_dims=(8, 16),
        model=model,
        epochs=20,
        learning_rate=0.01,
        classes=LANGS,
    )


@query
def cross_validate_static(spark, sf):
    out = E.cross_validate(doc_meta(spark, sf), doc_modalities(spark, sf), experiment_config("static"))
    return M.result_rows(out.metrics, "static")


@query
def cross_validate_dynamic(spark, sf):
    out = E.cross_validate(doc_meta(spark, sf), doc_modalities(spark, sf), experiment_config("dynamic"))
    return M.result_rows(out.metrics, "dynamic")


@query
def component_ablation(spark, sf):
    cfg = experiment_config("dynamic").with_(epochs=10)
    out = E.component_ablation(doc_meta(spark, sf), doc_modalities(spark, sf), cfg)
    return out.select("gate", "confidence", "fold", *M.METRICS)


@query
def training_gradient(spark, sf):
    """Data-parallel gradient of the static model and the weights after one Adam step."""
    cfg = STATIC.with_(dropout=0.0, learning_rate=0.01, weight_decay=0.0)
    base = cells(spark, sf)
    rows = FO.membership(fused_cells(spark, sf), FO.fold_plan(base))
    used = rows.select(F.xxhash64("cell_id").alias("row_id"), "y", "train_folds", *cfg.modalities)
    weights = document_weights(spark, sf)
    params = FU.formula_params(cfg, WIDTHS)
    out = []
    for fold, (n, _, flat) in TR.gradient_sums(used, {f: params for f in weights}, cfg, weights, 1).items():
        after = FU.unpack(TR.Adam(cfg).step(FU.pack(params), flat / n, 1), params)
        for layer, g in FU.unpack(flat / n, params).items():
            if layer.endswith(".w"):
                out += [
                    (fold, layer, i, j, round(float(g[j, i]), 6) + 0.0, round(float(after[layer][j, i]), 6) + 0.0)
                    for j in range(g.shape[0])
                    for i in range(g.shape[1])
                ]
    return spark.createDataFrame(
        out, "fold bigint, layer string, i bigint, j bigint, gradient double, updated double"
    )


# --- explanation --------------------------------------------------------------------------


@query
def feature_importance_mean(spark, sf):
    means = I.mean_importance(gates(spark, sf), ["fold", "modality"])
    return means.select("fold", "modality", i64("idx"), r6("importance"))


def importance_list(spark, sf, largest: bool) -> DataFrame:
    means = I.mean_importance(gates(spark, sf), ["fold", "modality"])
    names = {"protein": PROTEIN_NAMES, "rna": [f"dim{i}" for i in range(64)]}
    top = I.ranked(means.withColumn("importance", F.round("importance", 9)), ["fold", "modality"], 10, largest)
    named = top.withColumn("name", K.feature_name(names, F.col("modality"), F.col("idx")))
    return named.select("fold", "modality", i64("rank"), "name", r6("importance"))


@query
def top10_features(spark, sf):
    return importance_list(spark, sf, True)


@query
def bottom10_features(spark, sf):
    return importance_list(spark, sf, False)


@query
def mean_importance_grid(spark, sf):
    means = I.mean_importance(gates(spark, sf).where("modality = 'rna'"), ["fold"])
    return means.select(
        "fold", i64(F.floor(F.col("idx") / 8), "y"), i64(F.col("idx") % 8, "x"), r6("importance")
    )


@query
def tcp_error_summary(spark, sf):
    out = C.error_summary(roles.predictions(spark, sf), ["fold", "modality"])
    return out.select("fold", "modality", "n", *[r6(c) for c in out.columns[3:]])


def shares(spark, sf) -> DataFrame:
    return C.threshold_shares(roles.predictions(spark, sf), ["fold", "modality"])


@query
def tcp_threshold_shares(spark, sf):
    return shares(spark, sf).select("fold", "modality", i64("step"), "n", "n_above", r6("share"))


@query
def tcp_threshold_summary(spark, sf):
    out = C.shares_summary(shares(spark, sf))
    return out.select(i64("step"), *[r6(c) for c in ("mean", "sd_pop", "min", "max")])


@query
def tcp_running_stats(spark, sf):
    out = C.running_summary(shares(spark, sf))
    return out.select(i64("step"), "fold", *[r6(c) for c in ("mean", "sd_pop", "min", "max")]).distinct()


@query
def tcp_cumulative_pool(spark, sf):
    pooled = C.pool_modalities(roles.predictions(spark, sf), ["protein", "rna"])
    out = C.error_summary(pooled, ["fold", "modality"])
    return out.select("fold", "modality", "n", r6("true_mean"), r6("mse"), r6("mae"), r6("r2"))


@query
def fusion_calibration(spark, sf):
    out = C.error_summary(tcp_pairs_long(spark, sf), ["fold", "modality"])
    return out.select("fold", "modality", "n", r6("true_mean"), r6("pred_mean"), r6("mse"), r6("mae"), r6("err_sd_pop"))


# --- raster -------------------------------------------------------------------------------


def pixel_rows(px: DataFrame) -> DataFrame:
    return px.select("img", i64("y"), i64("x"), i64("c"), r6("v"))


def image_pixels(spark, sf, operator: TL.Operator) -> DataFrame:
    return pixel_rows(TL.pixels(TL.apply(roles.image_arrays(spark, sf), operator)))


@query
def block_max_pool(spark, sf):
    return image_pixels(spark, sf, lambda a: TL.max_pool(a, 4))


@query
def nearest_upsample(spark, sf):
    return image_pixels(spark, sf, lambda a: TL.resize_nearest(TL.max_pool(a, 2), (6, 6)))


@query
def focal_sum(spark, sf):
    return image_pixels(spark, sf, lambda a: TL.focal(a, KERNEL3))


@query
def focal_sum_in_tiles(spark, sf):
    """From pixel rows, in tiles of 3 x 3 with a halo of one."""
    return pixel_rows(TL.focal_in_tiles(roles.pixels(spark, sf), KERNEL3, (8, 8), 1, 3))


@query
def focal_stride2(spark, sf):
    return image_pixels(spark, sf, lambda a: TL.focal(a, KERNEL2, 2, [0.5, -0.5]))


@query
def focal_off_centre(spark, sf):
    return image_pixels(spark, sf, lambda a: TL.focal(a, [(5, 5, 0, 0, 0.5)], bias=[0.25]))


@query
def focal_sum_rows(spark, sf):
    """The same as an aggregate over pixel rows."""
    return pixel_rows(R.focal_sum(roles.pixels(spark, sf), KERNEL3, (8, 8)))


@query
def patch_gate(spark, sf):
    gated = TL.apply(roles.image_arrays(spark, sf), lambda a: TL.gates(a, 4), "gate")
    rows = TL.pixels(gated, ("v", "gate")).withColumn("gated", F.col("v") * F.col("gate"))
    return rows.select("img", i64("y"), i64("x"), i64("c"), r6("gate"), r6("gated"))


@query
def patch_gate_channels(spark, sf):
    """Two channels, of which each patch has a gate of its own: the image and its negative half."""
    two = TL.apply(roles.image_arrays(spark, sf), lambda a: np.concatenate([a, np.minimum(a, 0.0)], axis=1))
    rows = TL.pixels(TL.apply(two, lambda a: TL.gates(a, 4), "gate"), ("v", "gate"))
    rows = rows.withColumn("gated", F.col("v") * F.col("gate"))
    return rows.select("img", i64("y"), i64("x"), i64("c"), r6("gate"), r6("gated"))


@query
def flip_pixels(spark, sf):
    return pixel_rows(TL.pixels(TL.flip(roles.image_arrays(spark, sf), R.flip_bits(F.col("img")))))


@query
def channel_stack(spark, sf):
    def both(a):
        pooled = TL.max_pool(a, 2)
        return np.concatenate([pooled, TL.resize_nearest(TL.max_pool(pooled, 2), (4, 4))], axis=1)

    return image_pixels(spark, sf, both)


@query
def image_vector(spark, sf):
    means = TL.apply(roles.image_arrays(spark, sf), lambda a: TL.mean_pool(a, 2))
    return indexed(means, ["img"], F.col("v"), "value")


# --- attention ----------------------------------------------------------------------------

VALUES = ["v0", "v1", "v2"]


def scaled_tokens(spark, sf) -> DataFrame:
    return roles.tokens(spark, sf).withColumn("v0", F.col("v0") / 1000.0)


@query
def attention_pool(spark, sf):
    out = A.attention_pool(roles.tokens(spark, sf), ["conv_id"], "score", VALUES)
    return out.select("conv_id", *[r6(v) for v in VALUES])


@query
def attention_weights(spark, sf):
    out = A.attention_weights(roles.tokens(spark, sf), ["conv_id"], "score")
    return out.select("conv_id", "turn", r6("weight"))


@query
def cross_attention(spark, sf):
    out = A.cross_attention(scaled_tokens(spark, sf), ["conv_id"], LATENTS, VALUES, VALUES)
    return out.select("conv_id", i64("latent"), *[r6(v) for v in VALUES])


@query
def cross_attention_weights(spark, sf):
    tokens = scaled_tokens(spark, sf).select("conv_id", "turn", *VALUES)
    out = A.attention_weights(A.latent_scores(tokens, LATENTS, VALUES), ["conv_id", "latent"], "score")
    return out.select("conv_id", i64("latent"), "turn", r6("weight"))


@query
def latent_mean_pool(spark, sf):
    attended = A.cross_attention(scaled_tokens(spark, sf), ["conv_id"], LATENTS, VALUES, VALUES)
    return A.latent_mean(attended, ["conv_id"], VALUES).select("conv_id", *[r6(v) for v in VALUES])


@query
def co_attention(spark, sf):
    vec = F.array(*VALUES)
    rows = scaled_tokens(spark, sf)
    asking = rows.where("v2 = 1").select("conv_id", "turn", vec.alias("q"))
    given = rows.where("v2 = 0").select("conv_id", F.col("turn").alias("kid"), vec.alias("k"), vec.alias("v"))
    out = A.co_attention(asking, given, "conv_id", "turn", 3)
    return out.select("conv_id", "turn", *[r6(f"o{i}") for i in range(3)])


@query
def outer_product_fusion(spark, sf):
    two = {"protein": doc_protein(spark, sf), "tags": roles.doc_tags(spark, sf)}
    rows = K.align(cells(spark, sf), two)
    return indexed(rows, ["cell_id"], X.outer_product(F.col("protein"), F.col("tags")), "value")


@query
def survival_curve(spark, sf):
    out = A.survival(roles.tokens(spark, sf), ["conv_id"], "turn", F.col("score") - 1.0)
    return out.select("conv_id", "turn", r6("hazard"), r6("survival"))


@query
def survival_risk(spark, sf):
    out = A.risk(A.survival(roles.tokens(spark, sf), ["conv_id"], "turn", F.col("score") - 1.0), ["conv_id"])
    return out.select("conv_id", r6("risk"))


# --- sources and sinks --------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{sinks.checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def metadata_csv(spark, sf):
    path = scratch(spark, "metadata")
    doc_meta(spark, sf).select(*META_COLUMNS).write.csv(path, header=True)
    rows = tables.read_metadata(spark, path)
    return rows.select(
        F.col("cell_id").cast("bigint").alias("cell_id"), i64("day"), i64("donor"), "technology", "cell_type"
    )


@query
def modality_csv(spark, sf):
    path = scratch(spark, "modality")
    wide = doc_rna(spark, sf).select("cell_id", *[F.get("features", F.lit(i)).alias(f"gene{i}") for i in range(64)])
    wide.write.csv(path, header=True)
    rows, names = tables.read_modality(spark, path)
    named = K.name_features(rows, "features", names)
    return named.select(F.col("cell_id").cast("bigint").alias("cell_id"), i64("idx"), "name", r6("value"))


@query
def modality_csv_reordered(spark, sf):
    """Even and odd cells in files that order the columns differently."""
    path = scratch(spark, "reordered")
    wide = doc_rna(spark, sf).select("cell_id", *[F.get("features", F.lit(i)).alias(f"gene{i}") for i in range(64)])
    wide.where("cell_id % 2 = 0").write.csv(path, header=True)
    wide.where("cell_id % 2 = 1").select(*reversed(wide.columns)).write.mode("append").csv(path, header=True)
    rows, names = tables.read_modality(spark, path)
    named = K.name_features(rows, "features", names)
    return named.select(F.col("cell_id").cast("bigint").alias("cell_id"), "name", r6("value"))


@query
def metrics_csv(spark, sf):
    by = ["modality", "fold"]
    summary = M.over_folds(M.evaluate(roles.predictions(spark, sf), by), ["modality"])
    means = summary.select("modality", *[r6(f"{m}_mean") for m in M.METRICS])
    path = scratch(spark, "metrics")
    sinks.write_metrics(means, path)
    return spark.read.csv(path, header=True, schema=means.schema)


@query
def confusion_csv(spark, sf):
    stats = M.confusion_over_folds(fold_grid(spark, sf), []).withColumn("n_mean", F.round("n_mean", 6))
    path = scratch(spark, "confusion")
    sinks.write_confusion(stats, "n_mean", len(EVENT_TYPES), path)
    names = ", ".join(f"pred{k} double" for k in range(len(EVENT_TYPES)))
    return spark.read.csv(path, header=False, schema=names)


@query
def metric_log(spark, sf):
    rows = M.evaluate(roles.predictions(spark, sf), ["fold", "epoch"])
    path = scratch(spark, "log")
    for run in ("first", "second", "first"):  # the first run is written twice and there once
        sinks.append_log(rows.select("fold", i64("epoch"), r6("f1_macro")), path, run)
    return spark.read.parquet(path).select("run_id", "fold", "epoch", "f1_macro")


def decoded_images(spark, sf) -> DataFrame:
    """Embeddings as 8x8 grey images in the form the image source decodes to."""
    grey = F.transform("embedding", lambda v: F.abs(F.floor(v * 100)) % 256)
    data = F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return load(spark, sf, "embeddings").select(
        F.concat(F.lit("img"), F.col("vec_id").cast("string"), F.lit(".png")).alias("file"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("channels"),
        data.alias("data"),
    )


@query
def image_resize(spark, sf):
    vectors = image_vectors(decoded_images(spark, sf), size=4, patch=None)
    return indexed(vectors, ["file"], F.col("features"), "value")


@query
def image_manifest_join(spark, sf):
    file = F.concat(F.lit("/data/img"), F.col("cell_id").cast("string"), F.lit(".png"))
    manifest = cells(spark, sf).select("cell_id", "y", file.alias("file"))
    joined = tables.attach_images(manifest, decoded_images(spark, sf)).where(F.col("data").isNotNull())
    return joined.select("cell_id", i64("y"), "file", i64(F.length("data"), "n_bytes"))


@query
def image_manifest_rejects(spark, sf):
    """Cells whose manifest names a file that is not there."""
    file = F.concat(F.lit("/data/img"), F.col("cell_id").cast("string"), F.lit(".png"))
    manifest = cells(spark, sf).select("cell_id", "y", file.alias("file"))
    joined = tables.attach_images(manifest, decoded_images(spark, sf))
    return tables.rejected_images(joined).select("cell_id", i64("y"), "file")
