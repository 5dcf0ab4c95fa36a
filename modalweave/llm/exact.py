"""Exact duplicates: deduplicate locally, merge salted digest groups, combine the winners of the salts.

Every stage groups by the whole normalised text beside its digest, so a digest alone never decides that texts are equal.
The first aggregate runs within each scan task; its winners meet per (digest, salt, text), then per (digest, text). A
group that holds a third of all rows is thus at most one row per task before the first shuffle and `salts` rows before
the second. Only groups of two or more are then looked up, by digest; where different texts share a digest (with SHA-256
there are none) their rows are looked up by text.

Defined results: null text counts as empty; a null id is larger than every id; repeated rows (same id, same text) all
have the verdict of their id, and `drop_copies` keeps one of them; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import SPACES, durable, narrow, unpack, whole_row


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def contents(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = narrow(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def merged(rows: DataFrame, salts: int) -> DataFrame:
    """One row per text: digest, content, low (smallest id), n. All texts of a digest are in one task then."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    salted = rows.groupBy("digest", salt, "content").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    by_text = salted.repartition("digest").groupBy("digest", "content")
    return by_text.agg(F.min("low").alias("low"), F.sum("n").alias("n"))


def copies(rows: DataFrame, salts: int) -> DataFrame:
    """Digests of two rows or more: digest, texts (different ones that share it), keep_id, group_size."""
    by_digest = merged(rows, salts).groupBy("digest")
    sums = by_digest.agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    return durable(sums.where("group_size > 1"), "copies")


def verdicts(rows: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """Rows with digest and content beside keep_id and group_size of their group (null: nobody else has the text)."""
    found = rows.join(groups.where("texts = 1").drop("texts"), "digest", "left")
    clashing = groups.where("texts > 1").select("digest")
    if clashing.isEmpty():
        return found
    # Different texts under one digest: their rows are grouped and looked up by the text itself.
    own = ["doc_id", "digest", "content"]
    by_text = merged(rows.select(own).join(clashing, "digest", "left_semi"), salts)
    other = by_text.select("digest", "content", F.col("low").alias("other_id"), F.col("n").alias("other_size"))
    return found.join(other, ["digest", "content"], "left").select(
        *[c for c in found.columns if c not in ("keep_id", "group_size")],
        F.coalesce("keep_id", "other_id").alias("keep_id"),
        F.coalesce("group_size", "other_size").alias("group_size"),
    )


def exact_duplicates(
    df: DataFrame, id_col: str, text_col: str, salts: int = 64, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = contents(df, id_col, text_col, digest)
    groups = copies(rows, salts)
    found = verdicts(rows.withColumn("text_sha256", sha256(F.col("content"))), groups, salts)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str, text_col: str, salts: int = 64) -> DataFrame:
    """The rows of df that stay, with all their columns; of repeated rows one."""
    groups = copies(contents(df, id_col, text_col, sha256), salts)
    content = normalised(F.col(text_col))
    rows = df.select(
        whole_row(df).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        content.alias("content"),
        sha256(content).alias("digest"),
    )
    found = verdicts(rows, groups, salts)
    kept = found.where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return unpack(kept.select("row", "doc_id", "digest").dropDuplicates(["digest", "doc_id"]), "row", df.columns)
