"""One registered query per operator, with production parameters, on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalweave.llm import (
    exact,
    langid,
    merkle,
    mixing,
    negatives,
    neighbours,
    ngram,
    packing,
    pii,
    secrets,
    simhash,
    simple8b,
    substring,
)
from modalweave.llm.common import table


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    # No other stage needs the workers' memory.
    return packing.best_fit(docs, "doc_id", "text", path, end_id=0, size=2048, memory=400_000, kept=400_000)


def op5_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), "doc_id", "text", key="pseudonyms-1")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), fraction=0.7)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = simple8b.write_ids(table(spark, sf_dir, "documents"), "doc_id", "text", path, spaces=False, end_id=2)
    return simple8b.read_ids(files)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(table(spark, sf_dir, "pages"))


def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"), "doc_id", "text", folds=7, held_out=2, order=3)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", window=13, period=7)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the checksum of the id, the row to be proven has one character too many."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(fields)]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.proofs(docs, "doc_id", "lang", fields, F.when(chosen, merkle.leaf_digest(tampered)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id, the label is moved on by one."""
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(own + 1, F.lit(10))).otherwise(own)
    vectors = table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(vectors, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simple8b": op2_simple8b,
    "op3_simhash": op3_simhash,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_block_neighbours": op5_block_neighbours,
    "op6_pii_feistel": op6_pii_feistel,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_ngram_scores": op9_ngram_scores,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
}
