"""Fusion models whose gates are too wide to be sent to every task: matrix products in blocks.

Parameters stay a table ``(fold, layer, i, j, w)``; Spark cuts the gate and the encoder of a modality into
blocks of outputs x inputs. Rows are packed into blocks of rows x inputs. A cell of the product is one row
block and one output block; its row and weight blocks come to one task sorted by input block, weights
before rows, so the task holds one pair and the cell's sum, whatever the width. Nothing but the finished
sums leaves a cell. Layers behind the encoder depend on the hidden width only and are sent as usual.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalweave.config import Config
from modalweave.operators import fusion as FU
from modalweave.operators.blocks import as_matrix
from modalweave.sources.sinks import durable

BLOCK = 1024  # rows, inputs and outputs of a block: 8 MB each
HELD = "fold long, rb long, ib int, n int, data binary"


def weight_blocks(params: DataFrame, layer: str, outputs: int, inputs: int, block: int) -> DataFrame:
    """``(fold, jb, ib, data)``: the weights of a layer, outputs x inputs of a block as doubles."""
    rows = params.where((F.col("layer") == layer) & (F.col("i") >= 0))
    keys = [F.floor(F.col(c) / block).cast("int").alias(f"{c}b") for c in ("j", "i")]
    rows = rows.select(F.col("fold").cast("long").alias("fold"), *keys, "j", "i", "w")

    def fill(table: pa.Table) -> pa.Table:
        jb, ib = table["jb"][0].as_py(), table["ib"][0].as_py()
        data = np.zeros((min(block, outputs - jb * block), min(block, inputs - ib * block)))
        data[table["j"].to_numpy() - jb * block, table["i"].to_numpy() - ib * block] = table["w"].to_numpy()
        one = table.select(["fold", "jb", "ib"]).slice(0, 1)
        return one.append_column("data", pa.array([data.tobytes()], pa.binary()))

    return rows.groupBy("fold", "jb", "ib").applyInArrow(fill, "fold long, jb int, ib int, data binary")


def vectors(params: DataFrame, layers: list[str]) -> dict[tuple[int, str], np.ndarray]:
    """Biases, whose size is a width: by fold and layer."""
    rows = params.where(F.col("layer").isin(layers)).select("fold", "layer", "j", "w").toArrow()
    found: dict[tuple[int, str], dict[int, float]] = {}
    for f, name, j, w in zip(*(rows[c].to_pylist() for c in ("fold", "layer", "j", "w")), strict=True):
        found.setdefault((f, name), {})[j] = w
    return {key: np.array([own[j] for j in range(len(own))]) for key, own in found.items()}


def row_blocks(rows: DataFrame, modality: str, width: int, block: int) -> DataFrame:
    """Blocks (fold, rb, ib, n, data) of one modality of ``numbered`` rows. A NULL vector counts as zeros.

    Every vector is cut by inputs before rows meet, so no task holds a block of whole rows.
    """
    v = F.coalesce(F.col(modality), F.array_repeat(F.lit(0.0), width))
    wrong = F.raise_error(F.concat(F.lit(f"vectors of {width} numbers expected, found "), F.size(v).cast("string")))
    v = F.when(F.size(v) == width, v).otherwise(wrong.cast("array<double>"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(-(-width // block) - 1)), lambda i: F.slice(v, i * block + 1, block))
    cut = rows.select("fold", "rb", "seq", F.posexplode(parts).alias("ib", "x"))
    held = cut.groupBy("fold", "rb", "ib").agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = as_matrix(batch.column("items").slice(r, 1).flatten().field("x"))
                one = [batch.column(c).slice(r, 1) for c in ("fold", "rb", "ib")]
                arrays = [*one, pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["fold", "rb", "ib", "n", "data"])

    return held.mapInArrow(run, HELD)


def product(x: DataFrame, weights: DataFrame, outputs: int, block: int) -> DataFrame:
    """x times the transposed weights: ``(fold, rb, jb, n, data)``, the sums over all input blocks."""
    last = -(-outputs // block) - 1
    cells = x.select("fold", "rb").distinct()
    mine = x.withColumn("jb", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("kind", F.lit(1))
    theirs = weights.join(cells, "fold").withColumn("n", F.lit(0)).withColumn("kind", F.lit(0))
    keys = ["fold", "rb", "jb"]
    columns = [*keys, "ib", "kind", "n", "data"]
    met = mine.select(columns).unionByName(theirs.select(columns))
    met = met.repartition(*keys).sortWithinPartitions(*keys, "ib", "kind")
    names = [*keys, "n", "data"]

    def told(cell: tuple, total: np.ndarray) -> pa.RecordBatch:
        values = ([cell[0]], [cell[1]], [cell[2]], [len(total)], [total.tobytes()])
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, total, weight, at = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in columns}
                own = tuple(row[k] for k in keys)
                if own != cell:
                    if total is not None:
                        yield told(cell, total)
                    cell, total = own, None
                if row["kind"] == 0:
                    wide = min(block, outputs - row["jb"] * block)
                    weight, at = np.frombuffer(row["data"]).reshape(wide, -1), (own, row["ib"])
                    continue
                if at != (own, row["ib"]):
                    raise ValueError(f"no weights for block {row['ib']} of inputs in fold {row['fold']}")
                part = np.frombuffer(row["data"]).reshape(row["n"], -1) @ weight.T
                total = part if total is None else total + part
        if total is not None:
            yield told(cell, total)

    return met.mapInArrow(run, "fold long, rb long, jb int, n int, data binary")


def gated(x: DataFrame, sums: DataFrame, bias: Mapping[int, np.ndarray], block: int) -> DataFrame:
    """Blocks of gates and of gated inputs: fold, rb, ib, n, data (x times gate), gate."""
    sums = sums.select("fold", "rb", F.col("jb").alias("ib"), F.col("data").alias("z"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gates, out = [], []
            for row in batch.to_pylist():
                own = bias[row["fold"]][row["ib"] * block : (row["ib"] + 1) * block]
                gate = FU.sigmoid(np.frombuffer(row["z"]).reshape(row["n"], -1) + own)
                gates.append(gate.tobytes())
                out.append((np.frombuffer(row["data"]).reshape(row["n"], -1) * gate).tobytes())
            columns = [batch.column(c) for c in ("fold", "rb", "ib", "n")]
            arrays = [*columns, pa.array(out, pa.binary()), pa.array(gates, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["fold", "rb", "ib", "n", "data", "gate"])

    return x.join(sums, ["fold", "rb", "ib"]).mapInArrow(run, HELD + ", gate binary")


def numbered(df: DataFrame, keep: list[str], modalities: tuple[str, ...], block: int) -> DataFrame:
    """Written rows: fold, rb (number of the row block), seq (number of the row), kept, the vectors.

    A NULL fold is an error.
    """
    rows = df.select(
        F.coalesce(F.col("fold").cast("long"), F.raise_error(F.lit("rows without a fold have no model"))).alias("fold"),
        F.monotonically_increasing_id().alias("seq"),
        F.struct(*keep).alias("kept"),
        *modalities,
    )
    # A row's number is its task and its place there; `block` places make a block.
    return durable(rows.withColumn("rb", F.col("seq") - F.pmod("seq", F.lit(block))), "rows")


class WideModel:
    """A dynamic or static fusion model of any width, its parameters a table ``(fold, layer, i, j, w)``."""

    def __init__(self, params: DataFrame, cfg: Config, widths: Mapping[str, int], block: int = BLOCK):
        self.params, self.cfg, self.widths, self.block = params, cfg, dict(widths), block
        self.shapes = FU.shapes(cfg, widths)

    def _bias(self, layer: str) -> dict[int, np.ndarray]:
        return {f: v for (f, _), v in vectors(self.params, [layer]).items()}

    def _blocks(self, layer: str) -> DataFrame:
        outputs, inputs = self.shapes[layer]
        return weight_blocks(self.params, layer, outputs, inputs, self.block)

    def inputs(self, rows: DataFrame, modality: str) -> DataFrame:
        """Blocks of a modality as they enter the encoder, beside the gates where there are any."""
        x = durable(row_blocks(rows, modality, self.widths[modality], self.block), "inputs")
        if not self.cfg.gated:
            return x.withColumn("gate", F.lit(None).cast("binary"))
        sums = product(x, self._blocks(f"{modality}.gate.w"), self.widths[modality], self.block)
        return durable(gated(x, sums, self._bias(f"{modality}.gate.b"), self.block), "gated")

    def encoded(self, blocks: DataFrame, modality: str) -> DataFrame:
        """fold, rb, and the encoder's sums of a block of rows (rows x hidden)."""
        hidden, block = self.shapes[f"{modality}.enc.w"][0], self.block
        sums = product(blocks.select("fold", "rb", "ib", "n", "data"), self._blocks(f"{modality}.enc.w"), hidden, block)
        parts = F.sort_array(F.collect_list(F.struct("jb", "data")))
        return sums.groupBy("fold", "rb").agg(parts.alias(f"{modality}_pre"))

    def score(self, df: DataFrame, keep: list[str], outputs=("prob",)) -> DataFrame:
        """As ``fusion.score`` for prob, logits, tcp and fused; the forward pass behind the encoders runs per block of rows."""
        cfg = self.cfg
        wrong = set(outputs) - {"prob", "logits", "tcp", "fused"}
        if wrong:
            raise ValueError(f"outputs {sorted(wrong)} are not offered for wide models; gates: see mean_gates")
        labelled = "tcp" in outputs
        columns = list(dict.fromkeys([*keep, *(["y"] if labelled else [])]))
        rows = numbered(df, columns, tuple(cfg.modalities), self.block)
        item = F.struct("seq", "kept", *[F.col(m).isNotNull().alias(m) for m in cfg.modalities])
        found = rows.groupBy("fold", "rb").agg(F.sort_array(F.collect_list(item)).alias("items"))
        for m in cfg.modalities:
            found = found.join(durable(self.encoded(self.inputs(rows, m), m), "encoded"), ["fold", "rb"])
        small = [n for n in self.shapes if n.split(".")[-2] in ("tcp", "conf", "out") or n.endswith("enc.b")]
        tail = self._tail(small)
        fields = FU.out_fields(cfg, outputs)
        schema = T.StructType([*df.select(*keep).schema.fields, *fields])
        hidden = dict(zip(cfg.modalities, cfg.hidden, strict=True))
        block = self.block

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    p = tail[batch.column("fold")[r].as_py()]
                    items = batch.column("items").slice(r, 1).flatten()
                    kept = items.field("kept")
                    state = {"views": []}
                    for v, m in enumerate(cfg.modalities):
                        parts = [np.frombuffer(x["data"]) for x in batch.column(f"{m}_pre")[r].as_py()]
                        wide = [min(block, hidden[m] - j * block) for j in range(len(parts))]
                        pre = np.hstack([x.reshape(-1, w) for x, w in zip(parts, wide, strict=True)]) + p[f"{m}.enc.b"]
                        view = {"h": np.maximum(pre, 0.0)}
                        if cfg.model == "dynamic":
                            view["t"] = view["h"] @ p[f"{m}.tcp.w"].T + p[f"{m}.tcp.b"]
                            view["c"] = (view["h"] @ p[f"{m}.conf.w"].T + p[f"{m}.conf.b"])[:, 0]
                        factor = view["c"][:, None] if cfg.confident else cfg.view_weights[v]
                        there = items.field(m).to_numpy(zero_copy_only=False).astype(np.float64)
                        view["f"] = view["h"] * factor * there[:, None]
                        state["views"].append(view)
                    state["fused"] = np.concatenate([x["f"] for x in state["views"]], axis=1)
                    state["logits"] = state["fused"] @ p["out.w"].T + p["out.b"]
                    y = kept.field("y").to_numpy(zero_copy_only=False).astype(np.int64) if labelled else None
                    cols = [kept.field(c) for c in keep] + FU.batch_outputs(state, cfg, outputs, y, None)
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

        return found.mapInArrow(run, schema)

    def _tail(self, names: list[str]) -> dict[int, FU.Params]:
        rows = self.params.where(F.col("layer").isin(names)).select("fold", "layer", "i", "j", "w").toPandas()
        out: dict[int, FU.Params] = {}
        for (fold, name), part in rows.groupby(["fold", "layer"]):
            value = np.zeros(self.shapes[name])
            at = (part["j"], part["i"]) if value.ndim == 2 else (part["j"],)
            value[tuple(c.to_numpy() for c in at)] = part["w"].to_numpy()
            out.setdefault(int(fold), {})[name] = value
        return out

    def mean_gates(self, df: DataFrame, modality: str) -> DataFrame:
        """fold, idx, n, gate: the mean gate of every input, from sums of blocks; no row's gates are put together."""
        rows = numbered(df, ["fold"], (modality,), self.block)
        blocks, block = self.inputs(rows, modality), self.block

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    total = np.frombuffer(row["gate"]).reshape(row["n"], -1).sum(axis=0)
                    m = len(total)
                    columns = [np.full(m, row["fold"]), np.arange(m) + row["ib"] * block, np.full(m, row["n"]), total]
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
                    arrays = [pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["fold", "idx", "n", "s"])

        sums = blocks.mapInArrow(run, "fold long, idx int, n long, s double").groupBy("fold", "idx")
        sums = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return sums.select("fold", "idx", "n", (F.col("s") / F.col("n")).alias("gate"))
