"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Every stage works on all documents its predecessor kept; what it returns is written and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from modalweave.llm import exact, langid, mixing, packing, simhash
from modalweave.llm.common import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; lang holds it. Those without letters or like no language go."""
    return langid.keep_identified(docs, "text", "lang", "source")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact.drop_copies(docs, "doc_id", "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (3-word shingles, 3 bits) the document with the smallest id."""
    return simhash.drop_near_duplicates(docs, "doc_id", "text", shingle=3, radius=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled towards tempered shares of source, language and topic: 70 % of the tokens."""
    return mixing.keep_sampled(docs, fraction=0.7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2,048."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.best_fit(docs, "doc_id", "text", path, end_id=0, size=2048)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL has neither the language model, nor XXH64, nor the tokenizer; tests/llm/test_pipeline.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
