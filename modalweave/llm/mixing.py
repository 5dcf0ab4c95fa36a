"""Mixing to target weights: iterative proportional fitting of token weights to marginals, then calibrated sampling.

Documents are reduced to one row per cell (source x language x topic) with its tokens, by an aggregate with map-side
sums. On that table the weights are raked: for each dimension in turn, weight *= target share / present share, until no
share is off by more than `tolerance`, or the error no longer falls (see `rake`). Every few rounds are written, so lineage doesn't
grow; no cell comes to the driver.
A document's probability is min(1, c x weight of its cell) with c such that the expected tokens are `fraction` of all:
a closed search over the capped weights, two sums a step. The document stays if the hash of its id, a number in [0, 1),
is below its probability, so a rerun or a retried task chooses the same documents.

Defined results: a null category is a category of its own; a null id hashes like the empty text; repeated rows share
their fate; an empty text has no tokens, belongs to its cell and shares its probability; where all texts are empty every
weight is 1; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import WORD, durable, unpack, whole_row

CELLS_PER_TASK = 200_000
#: Rounds between two looks at the error, and looks within which it has to fall by a tenth.
ROUNDS, WINDOW = 6, 4
#: Decimals of weights and probabilities in the query: what the tolerance surely leaves right.
DECIMALS = 6
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A topic for tables that have none: the shape of the text."""
    return (
        F.when(text.rlike("[%#*$&]{3}"), "marked")
        .when(text.rlike(r" \| "), "table")
        .when(text.rlike("[0-9]{6}"), "numeric")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target shares proportional to the present share to a power: below 1 lifts small categories."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    sums = sums.withColumn("t", F.pow("t", F.lit(exponent)))
    total = sums.agg(F.sum("t")).first()[0] or 1.0
    return sums.select(dimension, (F.col("t") / F.lit(total)).alias("target"))


def _rounds(now: DataFrame, dimensions: list[str], total: float, together: bool) -> DataFrame:
    """ROUNDS rounds; off_... tell what the last one changed. together: all cells are in one partition, so windows need no
    exchange; otherwise shares are summed with partial sums in each task and joined back, and each dimension is written."""
    now = now.drop(*[f"off_{d}" for d in dimensions])
    for k in range(ROUNDS):
        for d in dimensions:
            mass = F.col("tokens") * F.col("weight")
            if together:
                share = F.sum(mass).over(Window.partitionBy(d))
            else:
                now = durable(now, "cells").join(now.groupBy(d).agg(F.sum(mass).alias("share")), d)
                share = F.col("share")
            factor = F.col(f"target_{d}") * F.lit(float(total)) / F.nullif(share, F.lit(0.0))
            now = now.withColumn("factor", F.coalesce(factor, F.lit(1.0)))
            now = now.withColumn("weight", F.col("weight") * F.col("factor"))
            if k == ROUNDS - 1:
                now = now.withColumn(f"off_{d}", F.abs(F.col("factor") - 1.0))
            now = now.drop("factor", "share")
    return now


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-11) -> DataFrame:
    """cells (dimensions, tokens) with `weight` and `off`, the largest |target / present share - 1| of the last round.

    targets: for each dimension its categories and their target shares. Categories without a target keep their present
    share; targets are scaled to what the other categories leave. Rounds end at `tolerance`, or when WINDOW looks, of
    ROUNDS rounds each, lower the error by less than a tenth. The latter is so with targets that contradict each other or
    the table, as tempered shares of sources in one language each may: the last round is the result, the shares of the last
    dimension are met, and `off` and a warning tell the remaining error.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0)).withColumn("off", F.lit(0.0))
    # A table of few cells stays in one partition, where no step of a round needs an exchange.
    partitions = cells.count() // CELLS_PER_TASK + 1
    now, aims = cells.withColumn("weight", F.lit(1.0)), {}
    for d, target in targets.items():
        present = cells.groupBy(d).agg((F.sum("tokens") / F.lit(total)).alias("present")).where("present > 0")
        aim = present.join(target, d, "left").withColumn("target", F.coalesce("target", "present"))
        scale = aim.agg(F.sum("target")).first()[0]
        aims[d] = durable(aim.select(d, (F.col("target") / F.lit(scale)).alias("target")), f"aim-{d}")
    for d, aim in aims.items():
        now = now.join(aim.withColumnRenamed("target", f"target_{d}"), d, "left")
    now, errors = durable(now.coalesce(partitions), "cells"), []
    while True:
        now = durable(_rounds(now.coalesce(partitions), list(aims), total, partitions == 1), "cells")
        worst = max(x or 0.0 for x in now.agg(*[F.max(f"off_{d}") for d in aims]).first())
        errors.append(worst)
        stuck = len(errors) > WINDOW and worst > 0.9 * errors[-1 - WINDOW]
        if stuck and worst > tolerance:
            text = f"a share is still off by a factor of {worst:.3g} after {ROUNDS * len(errors)} rounds: the targets contradict the table"
            warnings.warn(text, RuntimeWarning, stacklevel=2)
        if stuck or worst <= tolerance:
            return now.select(*cells.columns, "weight", F.lit(worst).alias("off"))


def calibrate(cells: DataFrame, fraction: float) -> DataFrame:
    """cells with `probability` = min(1, c x weight) whose expected tokens are `fraction` of all."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    tokens, weight, c = F.col("tokens").cast("double"), F.col("weight"), 0.0
    while total:
        # Cells that c takes in whole; the others share what is left. c only grows, so this ends.
        whole = weight * F.lit(c) >= 1.0
        sums = cells.agg(F.sum(F.when(whole, tokens)).alias("w"), F.sum(F.when(~whole, tokens * weight)).alias("r")).first()
        if not sums["r"]:
            break
        new = (fraction * total - (sums["w"] or 0.0)) / sums["r"]
        if new <= c * (1 + 1e-13):
            break
        c = new
    if not total:
        return cells.withColumn("probability", F.lit(float(fraction)))
    return cells.withColumn("probability", F.least(F.lit(1.0), weight * F.lit(c)))


def unit_hash(id_col: Column) -> Column:
    """A number in [0, 1) from the id: the first 12 hex digits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def mix(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source: Column,
    lang: Column,
    topic: Column,
    exponents: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    fraction: float = 0.7,
) -> DataFrame:
    """The rows of df as `row` beside source, lang, topic, n_tokens, weight, probability, sampled.

    Targets are tables (dimension, target), or else tempered shares by `exponents` (0.7 unless given).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    kind = {"source": source, "lang": lang, "topic": topic}
    named = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(k) for k, c in kind.items()]
    counted = df.select(*named, n_tokens.alias("tokens"))
    cells = durable(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    exponents = exponents or {}
    aims = targets or {d: tempered(cells, d, exponents.get(d, 0.7)) for d in DIMENSIONS}
    cells = durable(calibrate(rake(cells, aims), fraction), "cells")
    rows = df.select(whole_row(df).alias("row"), F.col(id_col).alias("id"), *named, n_tokens.alias("n_tokens"))
    found = rows.join(cells.drop("tokens", "off"), list(DIMENSIONS))
    return found.withColumn("sampled", unit_hash(F.col("id")) < F.col("probability"))


def mixture(df: DataFrame, fraction: float = 0.7, exponents: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every document."""
    topic = topic_of(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = mix(df, "doc_id", "text", F.col("source"), F.col("lang"), topic, exponents, fraction=fraction)
    numbers = [F.round(c, DECIMALS).alias(c) for c in ("weight", "probability")]
    return found.select(F.col("row").getField("doc_id").alias("doc_id"), *DIMENSIONS, "n_tokens", *numbers, "sampled")


def keep_sampled(df: DataFrame, fraction: float, exponents: dict[str, float] | None = None) -> DataFrame:
    """The sampled documents with all their columns."""
    topic = topic_of(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = mix(df, "doc_id", "text", F.col("source"), F.col("lang"), topic, exponents, fraction=fraction)
    return unpack(found.where("sampled"), "row", df.columns)
