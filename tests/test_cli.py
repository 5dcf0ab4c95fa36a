import random

import pytest

from modalweave import cli


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    rnd = random.Random(0)
    names = ["BP", "EryP", "MoP", "NeuP"]
    meta, protein, rna = ["cell_id,day,donor,technology,cell_type"], ["cell_id,p0,p1"], ["cell_id,r0,r1,r2"]
    for i in range(120):
        y = i % 4
        meta.append(f"c{i},2,{100 + rnd.randrange(3)},cite,{names[y]}")
        protein.append(f"c{i},{y // 2 + rnd.gauss(0, 0.1):.4f},{y % 2 + rnd.gauss(0, 0.1):.4f}")
        rna.append(f"c{i}," + ",".join(f"{rnd.gauss(0, 1):.4f}" for _ in range(3)))
    for name, rows in (("meta", meta), ("protein", protein), ("rna", rna)):
        (folder / cli.FILES[name]).write_text("\n".join(rows) + "\n")
    return folder


def test_train_then_explain(spark, root, tmp_path):
    common = ["--root", str(root), "--results", str(tmp_path), "--modalities", "protein", "rna", "--hidden-dims", "4"]
    common += ["--model", "dynamic", "--epochs", "2"]
    cli.main(["train", *common])
    run = next(p for p in tmp_path.iterdir() if p.name.startswith("run_id="))
    assert {"metrics_mean", "metrics_std", "cfm_mean", "cfm_std", "weights"} <= {p.name for p in run.iterdir()}
    cli.main(["explain", *common, "--weights-dir", str(run / "weights")])
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r["run_id"] for r in log.collect()} == {run.name.removeprefix("run_id=")} and log.where("metric = 'loss'").count() == 6
    (options,) = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert options["options"]["epochs"] == "2" and options["options"]["modalities"] == '["protein", "rna"]'
    cli.main(["train", *common])  # a second try of the same run replaces its rows
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6 and spark.read.parquet(str(tmp_path / "runs")).count() == 1
    rows = spark.read.csv(str(run / "importance"), header=True).collect()
    assert {r["name"] for r in rows} == {"p0", "p1", "r0", "r1", "r2"}
    assert spark.read.csv(str(run / "errors"), header=True).count() == 6


def test_baselines(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.B, "BASELINES", {"KNN": cli.B.k_neighbours, "LR": cli.B.logistic_regression})
    cli.main(["baselines", "--root", str(root), "--results", str(tmp_path), "--modalities", "protein", "rna", "--hidden-dims", "4", "--modality-weights", "1"])
    table = spark.read.csv(str(tmp_path / "protein_mean"), header=True, inferSchema=True)
    scores = {r["model"]: r["accuracy_mean"] for r in table.collect()}
    assert set(scores) == {"KNN", "LR"} and min(scores.values()) > 0.9
    assert spark.read.csv(str(tmp_path / "both_sd_samp"), header=True).count() == 2


def test_parts_can_be_switched_off():
    args = cli.parser().parse_args(["train", "--root", "r", "--results", "o", "--model", "dynamic", "--feature-import-loss", "none", "--modality-import-loss", "0"])
    cfg = cli.config(args)
    assert not cfg.gated and cfg.confident and cfg.test_only is False


def test_masked_test_rows(spark, root, tmp_path):
    common = ["--root", str(root), "--results", str(tmp_path), "--modalities", "protein", "rna", "--hidden-dims", "4"]
    common += ["--modality-weights", "1", "--epochs", "2"]
    cfg = cli.config(cli.parser().parse_args(["train", *common]))
    masked = cli.config(cli.parser().parse_args(["train", *common, "--mask", "protein", "--mask-value", "0.5"]))
    assert masked.masked == ("protein",) and masked.run_name != cfg.run_name
    meta, mods, _ = cli.load_tables(spark, cfg)
    data = cli.E.prepare(meta, mods, cfg)
    rows = cli.E.masked_rows(cli.E.target_rows(data), masked)
    assert {tuple(r["protein"]) for r in rows.collect()} == {(0.5, 0.5)} and rows.count() == 120
    out, hidden = cli.E.run(data, cfg), cli.E.run(data, masked)
    assert out.fit.models.keys() == hidden.fit.models.keys()
    a, b = ({r["cell_id"]: r["prob"] for r in o.predictions.collect()} for o in (out, hidden))
    assert a != b
    with pytest.raises(ValueError, match="none of the modalities"):
        cfg.with_(masked=("image",))


def test_all_validation_metrics_are_logged(spark, root, tmp_path):
    args = ["train", "--root", str(root), "--results", str(tmp_path), "--modalities", "protein", "--hidden-dims", "4"]
    cfg = cli.config(cli.parser().parse_args([*args, "--modality-weights", "1", "--epochs", "2"])).with_(test_interval=1)
    meta, mods, _ = cli.load_tables(spark, cfg)
    log = cli.E.cross_validate(meta, mods, cfg).fit.log
    names = {"val_f1", "val_f1_macro", "val_recall", "val_precision", "val_accuracy", "val_balanced_accuracy", "loss"}
    assert {r["metric"] for r in log} == names and len(log) == 7 * 2 * 3
