"""Attention over bags of tokens, and the survival risk read off a bag."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.functions import vectors as V
from modalweave.operators.blocks import as_matrix, paired
from modalweave.operators.skew import (
    BAND,
    merge_bands,
    running_sum,
    salted_join,
    softmax_sums,
    softmax_weights,
)

PAIR_ROWS = 4096  # tokens of one group in one block
SHARED_GROUPS = 256  # groups below one block that share a task


def attention_pool(tokens: DataFrame, by: list[str], score: str, values: list[str]) -> DataFrame:
    """Sum of the token values weighted by the softmax of their scores in the bag."""
    return softmax_sums(tokens, by, F.col(score), {v: F.col(v) for v in values}).drop("_max", "_norm", "_rows")


def attention_weights(tokens: DataFrame, by: list[str], score: str) -> DataFrame:
    return softmax_weights(tokens, by, F.col(score))


def latent_scores(tokens: DataFrame, latents: list[list[float]], keys: list[str]) -> DataFrame:
    """Scaled dot product of every token with every latent query: ``latent, score`` per token.

    The latents are a fixed short list, so a token gives a fixed number of rows.
    """
    d = len(keys)
    items = []
    for i, q in enumerate(latents):
        if len(q) != d:
            raise ValueError(f"latent {i} has {len(q)} numbers for {d} key columns")
        s = sum((F.col(c) * F.lit(float(x)) for c, x in zip(keys, q, strict=True)), F.lit(0.0))
        items.append(F.struct(F.lit(i).alias("latent"), (s / math.sqrt(d)).alias("score")))
    return tokens.select("*", F.inline(F.array(*items)))


def cross_attention(
    tokens: DataFrame, by: list[str], latents: list[list[float]], keys: list[str], values: list[str]
) -> DataFrame:
    """Each latent query attends to the tokens of each bag; one row per bag and latent."""
    scored = latent_scores(tokens.select(*by, *dict.fromkeys([*keys, *values])), latents, keys)
    return attention_pool(scored, [*by, "latent"], "score", values)


def latent_mean(attended: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return attended.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def _partials(q: np.ndarray, k: np.ndarray, v: np.ndarray):
    """Score band, sum of exponentials and weighted value sums for each query of one group."""
    out = []
    step = max(1, 2_000_000 // max(1, len(k)))
    for s in range(0, len(q), step):
        z = q[s : s + step] @ k.T / math.sqrt(q.shape[1])
        band = np.floor(z.max(axis=1) / BAND)
        e = np.exp(z - BAND * (band[:, None] + 1))
        out.append((band, e.sum(axis=1), e @ v))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def co_attention(queries: DataFrame, keys: DataFrame, by: str, qid: str, width: int) -> DataFrame:
    """Each query token attends to all key tokens of its group: ``(by, qid, o0 .. o<width-1>)``.

    ``queries`` has ``(by, qid, q)``, ``keys`` has ``(by, kid, k, v)``, ``v`` of length
    ``width``. Groups larger than a block are cut on both sides and small groups
    share a task. A pair of blocks returns one partial softmax sum per query, never
    the pairs; the partial sums are added per ``(by, qid, band)`` with map-side sums.
    """
    q_rows = queries.groupBy(by).agg(F.count(F.lit(1)).alias("_q_rows"))
    k_rows = keys.groupBy(by).agg(F.count(F.lit(1)).alias("_k_rows"))
    sizes = q_rows.join(k_rows, by)
    for side, rows in (("_nq", "_q_rows"), ("_nk", "_k_rows")):
        sizes = sizes.withColumn(side, F.ceil(F.col(rows) / PAIR_ROWS).cast("int"))
    packs = max(1, math.ceil(sizes.count() / SHARED_GROUPS))
    shared = F.concat(F.lit("p"), F.pmod(F.xxhash64(by), F.lit(packs)).cast("string"))
    own = F.concat(F.lit("g"), F.col(by).cast("string"))
    pack = F.when((F.col("_nq") == 1) & (F.col("_nk") == 1), shared).otherwise(own)
    left = salted_join(queries, sizes, [by], size="_q_rows").withColumn("_pack", pack)
    right = salted_join(keys, sizes, [by], size="_k_rows").withColumn("_pack", pack)
    types = dict(queries.dtypes)
    sums = [f"o{i}" for i in range(width)]
    schema = f"{by} {types[by]}, {qid} {types[qid]}, band double, norm double, " + ", ".join(
        f"{c} double" for c in sums
    )

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        ga, gb = a[by].to_numpy(), b[by].to_numpy()
        q, k, v = as_matrix(a["q"]), as_matrix(b["k"]), as_matrix(b["v"], width)
        keys_of = {gb[run[0]]: run for run in _runs(gb)}
        taken, parts = [], []
        for run in _runs(ga):
            found = keys_of.get(ga[run[0]])
            if found is not None:
                taken.append(run)
                parts.append(_partials(q[run], k[found], v[found]))
        if not parts:
            taken, parts = [np.zeros(0, np.int64)], [(np.zeros(0), np.zeros(0), np.zeros((0, width)))]
        rows = np.concatenate(taken)
        band, norm, acc = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = {by: a[by].take(rows), qid: a[qid].take(rows), "band": band, "norm": norm}
        return pa.table(out | {c: acc[:, i] for i, c in enumerate(sums)})

    parts = paired(left, right, ["_pack"], qid, "kid", F.col("_nq"), F.col("_nk")).applyInArrow(block, schema)
    banded = parts.groupBy(by, qid, "band").agg(*[F.sum(c).alias(c) for c in ["norm", *sums]])
    return merge_bands(banded, [by, qid], "band", "norm", sums)


def _runs(values: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each distinct value."""
    if len(values) == 0:
        return []
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return np.split(order, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)


def survival(steps: DataFrame, by: list[str], order: str, logit: Column) -> DataFrame:
    """Hazard, and the survival as running product of ``1 - hazard`` in each group.

    The product is a running sum of logarithms; a hazard of 1 gives survival 0 from there on.
    """
    rows = steps.withColumn("hazard", V.sigmoid(logit))
    log_s = F.ln(F.greatest(1.0 - F.col("hazard"), F.lit(1e-300)))
    return running_sum(rows, by, order, log_s, "_log").withColumn("survival", F.exp("_log")).drop("_log")


def risk(survived: DataFrame, by: list[str]) -> DataFrame:
    """Risk score: minus the sum of the survival values."""
    return survived.groupBy(*by).agg((-F.sum("survival")).alias("risk"))
