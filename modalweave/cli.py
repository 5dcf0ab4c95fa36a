"""Command line: ``python -m modalweave.cli train|baselines|explain --root DIR --results DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from modalweave.config import Config
from modalweave.operators import baselines as B
from modalweave.operators import metrics as M
from modalweave.operators.fusion import load_params
from modalweave.plans import experiment as E
from modalweave.sources import images, sinks, tables

# Names of the input files under the root folder.
FILES = {
    "meta": "meta_data_train.csv",
    "protein": "protein_data_train.csv",
    "rna": "rna_rand_data_train.csv",
    "image": "image_data.csv",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modalweave", description="Leave-one-donor-out experiments on feature tables")
    p.add_argument("command", choices=["train", "baselines", "explain"])
    p.add_argument("--root", required=True, help="folder of the CSV files")
    p.add_argument("--results", required=True, help="folder for result tables")
    p.add_argument("--image-dir", help="folder of the image files")
    p.add_argument("--hidden-dims", nargs="+", type=int, default=[35, 250, 500])
    p.add_argument("--modalities", nargs="+", default=["protein", "rna", "image"], choices=["protein", "rna", "image"])
    p.add_argument("--epochs", type=int, default=250)
    p.add_argument("--classification-loss-weight", type=float, default=1.0)
    p.add_argument("--feature-import-loss", type=optional_number, default=1.0, help="a number, or none")
    p.add_argument("--modality-import-loss", type=optional_number, default=1.0, help="a number, or none")
    p.add_argument("--model", choices=["dynamic", "static"], default="static")
    p.add_argument("--modality-weights", nargs="+", type=float, default=[3.0, 1.0, 6.0])
    p.add_argument("--weights-dir", help="parameters of an earlier run")
    p.add_argument("--test-only", action="store_true")
    p.add_argument("--mask", nargs="+", default=[], metavar="MODALITY", help="modalities made uniform in the test rows")
    p.add_argument("--mask-value", type=float, default=0.5)
    p.add_argument("--flip", action="store_true", help="mirror the images of train rows at random")
    p.add_argument("--weights-fold", type=int, help="explain all folds by the model of this one")
    p.add_argument("--batch-size", type=int, default=1024, help="train rows of a step; an epoch reads all of them")
    return p


def optional_number(text: str) -> float | None:
    return None if text.lower() == "none" else float(text)


def config(args: argparse.Namespace) -> Config:
    return Config(
        root=args.root,
        results=args.results,
        image_dir=args.image_dir,
        modalities=tuple(args.modalities),
        hidden_dims=tuple(args.hidden_dims),
        model=args.model,
        modality_weights=tuple(args.modality_weights),
        classification_loss_weight=args.classification_loss_weight,
        feature_import_loss=args.feature_import_loss,
        modality_import_loss=args.modality_import_loss,
        epochs=args.epochs,
        batch_size=args.batch_size,
        weights_dir=args.weights_dir,
        test_only=args.test_only,
        masked=tuple(args.mask),
        mask_value=args.mask_value,
        flipped=tuple(m for m in args.modalities if m == "image") if args.flip else (),
    )


def load_tables(spark: SparkSession, cfg: Config) -> tuple[DataFrame, dict[str, DataFrame], dict[str, list[str]]]:
    """Metadata, the chosen modalities as vectors, and the feature names."""

    def path(name: str) -> str:
        return f"{cfg.root.rstrip('/')}/{FILES[name]}"

    mods: dict[str, DataFrame] = {}
    names: dict[str, list[str]] = {}
    for name in cfg.modalities:
        if name == "image":
            if not cfg.image_dir:
                raise ValueError("the image modality needs an image folder")
            found = tables.attach_images(
                tables.read_manifest(spark, path(name)), tables.read_images(spark, cfg.image_dir)
            )
            tables.require_images(found)
            mods[name] = images.image_vectors(found).select("cell_id", "features")
            names[name] = [f"patch_{c}_{y}_{x}" for c in "rgb" for y in range(8) for x in range(8)]
        else:
            mods[name], names[name] = tables.read_modality(spark, path(name))
    return tables.read_metadata(spark, path("meta")), mods, names


def run_baselines(spark: SparkSession, cfg: Config) -> DataFrame:
    """All baselines on each modality alone and on all; mean and deviation tables per modality set."""
    meta, mods, _ = load_tables(spark, cfg)
    results = E.modality_ablation(meta, mods, cfg.classes, tuple(B.BASELINES))
    results = sinks.durable(results, "baselines")
    summary = M.over_folds(results, ["modalities", "model"])
    for name in E.modality_sets(list(mods)):
        rows = summary.where(summary["modalities"] == name)
        for part in ("mean", "sd_samp"):
            cols = [f"{m}_{part}" for m in M.METRICS]
            sinks.write_metrics(rows.select("model", *cols), f"{cfg.results.rstrip('/')}/{name}_{part}")
    return summary


def run_explain(spark: SparkSession, cfg: Config, weights_fold: int | None = None) -> dict[str, DataFrame]:
    """Feature importance and calibration of stored dynamic models, written as tables; with ``weights_fold``, of one model."""
    if not cfg.weights_dir:
        raise ValueError("explain needs --weights-dir")
    meta, mods, names = load_tables(spark, cfg)
    data = E.prepare(meta, mods, cfg)
    models = load_params(spark, cfg.weights_dir, cfg, data.widths)
    out = {"importance": E.importance_report(data, models, cfg, names, weights_fold=weights_fold)}
    out |= E.calibration_report(data, models, cfg, weights_fold=weights_fold)
    for name, table in out.items():
        sinks.write_metrics(table, sinks.run_path(cfg.results, cfg.run_name, name))
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = config(args)
    spark = SparkSession.builder.appName("modalweave").getOrCreate()
    if args.command == "baselines":
        run_baselines(spark, cfg).show(truncate=False)
    elif args.command == "explain":
        run_explain(spark, cfg, args.weights_fold)["importance"].show(truncate=False)
    else:
        meta, mods, _ = load_tables(spark, cfg)
        out = E.cross_validate(meta, mods, cfg)
        E.write_outcome(out, cfg)
        out.summary.show(truncate=False)


if __name__ == "__main__":
    main()
