"""Joins, softmax and running sums that survive one very large group.

Any key may own a third of all rows, so nothing here sends a whole group to
one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.sources.sinks import durable

# A key is hot when it owns more than 1 / HOT_SHARE of the rows; there are fewer
# than HOT_SHARE such keys, which bounds the broadcast below.
HOT_SHARE = 512
TRACKED = 8192  # items of a task's summary of frequent keys
# Width of a score band in softmax sums: exp() of a band spans e^32, far from overflow.
BAND = 32.0


def hot_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """``(key, _salts)`` for the keys that own more than 1/HOT_SHARE of the rows.

    At most HOT_SHARE rows by construction. A key with share ``s`` gets about
    ``s * HOT_SHARE`` salts, so each salted group is as small as the largest
    group that is left alone.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.agg(F.sum("_n")).scalar()
    share = F.col("_n") * HOT_SHARE / rows
    return counts.where(share > 1).select(*key, F.ceil(share).cast("int").alias("_salts"))


def key_hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def hot_hashes(df: DataFrame, key: list[str]) -> DataFrame:
    """``(_hash, _salts)`` for the hashes of keys that own more than 1/HOT_SHARE of the rows, in one pass.

    A summary of the most frequent items (TRACKED of them a task, merged) holds every such key and overrates none by more
    than 4/3 of 1/TRACKED of the rows, so only one small row a task is exchanged. At most HOT_SHARE rows by construction.
    Keys that share a hash share their salts, on both sides of a join.
    """
    items = ", ".join(f"`{c}`" for c in key)
    top = F.expr(f"approx_top_k(xxhash64({items}), {HOT_SHARE}, {TRACKED})")
    found = df.agg(top.alias("_top"), F.count(F.lit(1)).alias("_rows")).select("_rows", F.explode("_top").alias("_t"))
    share = F.col("_t.count") * HOT_SHARE / F.col("_rows")
    return found.where(share > 1).select(F.col("_t.item").alias("_hash"), F.ceil(share).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame, small: DataFrame, key: list[str], how: str = "inner", size: str | None = None
) -> DataFrame:
    """Equi-join where ``small`` has one row per key and ``big`` may be badly skewed.

    Rows of a hot key are spread over salts by a hash of their other columns and their
    task, and the one matching row is copied per salt. All other keys keep salt 0, so nothing
    else is copied. ``size`` names a column of ``small`` with the number of ``big`` rows of
    the key; without it a summary of ``big`` tells the hot ones.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join does inner and left joins")
    # Equal rows of different tasks part; a task that is repeated gives its rows the same salts.
    others = [F.col(c) for c in big.columns if c not in key]
    spread = F.xxhash64(*others, F.spark_partition_id())
    if size is None:
        # Written: both sides must see the same salts, and a summary may differ from run to run.
        hot, on = F.broadcast(durable(hot_hashes(big, key), "hot")), ["_hash"]
        left = big.withColumn("_hash", key_hash(key)).join(hot, on, "left").drop("_hash")
        sized = small.withColumn("_hash", key_hash(key)).join(hot, on, "left").drop("_hash")
        sized = sized.withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    else:
        rows = small.agg(F.sum(size)).scalar()
        sized = small.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col(size) * HOT_SHARE / rows).cast("int")))
        left = big.join(F.broadcast(sized.where(F.col("_salts") > 1).select(*key, "_salts")), key, "left")
    left = left.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(spread, F.col("_salts")).cast("int")))
    right = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*key, "_salt"], how).drop("_salt")


def softmax_sums(df: DataFrame, key: list[str], score: Column, values: dict[str, Column]) -> DataFrame:
    """Per key: ``_max`` band, ``_norm``, ``_rows`` and one softmax-weighted sum per value.

    A plain softmax needs the group maximum before it can add anything, i.e. a
    second pass joined back on a possibly hot key. Here every score is shifted by
    the top of its own 32-wide band, summed per ``(key, band)`` with map-side
    partial sums, and the few bands of a key are rescaled to the highest one.
    Weights of the result are ``exp(score - BAND * (_max + 1)) / _norm``.
    """
    band = F.floor(score / BAND)
    banded = df.select(*key, band.alias("_band"), score.alias("_s"), *[v.alias(n) for n, v in values.items()])
    weight = F.exp(F.col("_s") - BAND * (F.col("_band") + 1))
    sums = banded.groupBy(*key, "_band").agg(
        F.sum(weight).alias("_norm"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(weight * F.col(n)).alias(n) for n in values],
    )
    return merge_bands(sums, key, "_band", "_norm", list(values), rows="_rows")


def merge_bands(sums: DataFrame, key: list[str], band: str, norm: str, values: list[str], rows: str | None = None):
    """Rescale the band sums of a key to its highest band and divide by the total weight.

    A key has one row per 32-wide score band, a handful of rows. With ``rows`` the top
    band, the total weight and the number of rows are kept as ``_max, _norm, _rows``.
    """
    names = {n: f"_v{i}" for i, n in enumerate([norm, *values])}
    fields = [F.col(band).alias("_b"), *[F.col(n).alias(short) for n, short in names.items()]]
    counted = [] if rows is None else [F.sum(rows).alias("_rows")]
    packed = sums.groupBy(*key).agg(
        F.max(band).alias("_max"), F.collect_list(F.struct(*fields)).alias("_bands"), *counted
    )

    def rescaled(name: str) -> Column:
        return F.aggregate(
            "_bands",
            F.lit(0.0),
            lambda acc, b: acc + b[names[name]] * F.exp(BAND * (b["_b"] - F.col("_max")).cast("double")),
        )

    extra = [] if rows is None else ["_max", "_norm", "_rows"]
    out = packed.withColumn("_norm", rescaled(norm)).withColumns({n: rescaled(n) / F.col("_norm") for n in values})
    return out.select(*key, *extra, *values)


def softmax_weights(df: DataFrame, key: list[str], score: Column, name: str = "weight") -> DataFrame:
    """Softmax of ``score`` within each key, one weight per row."""
    norms = softmax_sums(df, key, score, {})
    joined = salted_join(df, norms, key)
    return joined.withColumn(name, F.exp(score - BAND * (F.col("_max") + 1)) / F.col("_norm")).drop(
        "_max", "_norm", "_rows"
    )


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, name: str, width: int = 65536):
    """Running sum in ``order`` (an integer, unique within a key) without one task per key.

    Rows are cut into chunks of ``width`` consecutive positions. Chunk totals are
    summed up over the short list of chunks, then each chunk is summed up on its own.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(order) / width)).withColumn("_v", value)
    totals = rows.groupBy(*key, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(order)
    return (
        rows.join(offsets, [*key, "_chunk"])
        .withColumn(name, F.col("_offset") + F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_chunk", "_v", "_offset")
    )


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a table after counting that it is short; leave a longer one to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ceil_div(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
