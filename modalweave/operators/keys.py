"""Key handling: first row per key, joins of metadata and modalities, missing parts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.functions import vectors as V


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """First row per key in the given order (all other columns when none is given).

    An aggregate, not a window: map-side partial results shrink a key with many
    copies to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    first = F.min(row) if order is None else F.min_by(row, F.struct(*order))
    picked = df.groupBy(*keys).agg(first.alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def semi_join(df: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows whose key is in the id list. Adaptive execution splits a key with very many rows."""
    return df.join(ids.select(key), key, "left_semi")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on several keys in which NULL equals NULL."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, "inner").drop(*[f"_r_{k}" for k in keys])


def join_modality(meta: DataFrame, modality: DataFrame, key: str = "cell_id", order=None) -> DataFrame:
    """Metadata with one modality, one row per key.

    Joining first and keeping the first joined row gives the first metadata row
    with the first modality row, so both sides are reduced before the join and
    copies of a key never multiply.
    """
    return keep_first(meta, [key], order).join(keep_first(modality, [key]), key, "inner")


def early_fusion(
    meta: DataFrame, modalities: Mapping[str, DataFrame], key: str = "cell_id", vector: str = "features"
) -> DataFrame:
    """Cells present in every modality, with their vectors concatenated to ``features``.

    After ``keep_first`` the metadata columns depend on the key alone, so joining
    the modalities on the key equals joining on key and metadata columns.
    """
    fused = align(meta, modalities, key=key, vector=vector)
    return fused.withColumn(vector, V.concat_views([F.col(m) for m in modalities])).drop(*modalities)


def align(
    meta: DataFrame,
    modalities: Mapping[str, DataFrame],
    key: str = "cell_id",
    vector: str = "features",
    missing: str = "drop",
) -> DataFrame:
    """One row per cell with one vector column per modality, matched by key.

    ``missing="drop"`` keeps cells that have all modalities; ``"keep"`` keeps every
    cell and adds ``has_<modality>``.
    """
    if missing not in ("drop", "keep"):
        raise ValueError("missing must be 'drop' or 'keep'")
    out = keep_first(meta, [key])
    for name, table in modalities.items():
        part = keep_first(table.select(key, F.col(vector).alias(name)), [key])
        out = out.join(part, key, "inner" if missing == "drop" else "left")
        if missing == "keep":
            out = out.withColumn(f"has_{name}", F.col(name).isNotNull())
    return out


def select_modalities(registry: Mapping[str, DataFrame], names: Iterable[str]) -> dict[str, DataFrame]:
    """The modality tables that take part; the others are never scanned."""
    names = list(names)
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unknown modalities {unknown}; known: {sorted(registry)}")
    return {n: registry[n] for n in names}


def map_label(df: DataFrame, classes: Mapping[str, int], column: str = "cell_type", name: str = "y") -> DataFrame:
    """Category to class id; a category outside the map gives NULL."""
    pairs = [F.lit(v) for kv in classes.items() for v in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(column)).cast("int"))


def reject_unlabelled(df: DataFrame, name: str = "y") -> DataFrame:
    return df.where(F.col(name).isNotNull())


def feature_widths(modalities: Mapping[str, DataFrame], kinds: Mapping[str, str], vector: str = "features"):
    """Vector width per modality and its declared kind (``tabular`` or ``image``)."""
    parts = [
        table.agg(F.max(F.size(vector)).alias("width"), F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("modality"), F.lit(kinds.get(name, "tabular")).alias("kind"), "width", "n_rows"
        )
        for name, table in modalities.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def feature_name(names: Mapping[str, list[str]], modality: Column, idx: Column) -> Column:
    """Name of a feature by modality and position.

    The names are a constant as long as the tables are wide, so no join is needed.
    """
    table = F.from_json(F.lit(json.dumps(dict(names))), "map<string, array<string>>")
    return F.get(F.try_element_at(table, modality), idx.cast("int"))


def name_features(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Vector to one named row per feature."""
    keep = [c for c in df.columns if c != vector]
    long = V.unfold(df, keep, vector, "value")
    return long.withColumn("name", feature_name({"": names}, F.lit(""), F.col("idx")))
