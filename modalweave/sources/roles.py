"""The driver's tables in the roles of metadata, modalities, predictions and token bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalweave.operators.tiles import images


# Class ids of the label columns and the character classes of the text features.
LANGS = {"de": 0, "en": 1, "es": 2, "fr": 3}
EVENT_TYPES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
CHAR_CLASSES = ["aeiou", "äöüß", "éèêàçù", "áíóúñ¿¡", " "]
PROTEIN_NAMES = ["vowel", "german", "french", "spanish", "space", "log_length"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Documents whose texts are searched by every core: a file of one row group is read by one task, so the rows of
    an input with fewer splits than cores are dealt out first. Larger inputs stay where they are read."""
    docs, cores = load(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if dealt and docs.rdd.getNumPartitions() < cores else docs


# --- cells from documents ---------------------------------------------------------------


def doc_meta(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("cell_id"),
        (F.col("n_chars") % 3).alias("day"),
        (F.expr("substr(source, 4)").cast("bigint") % 3).alias("donor"),
        F.lit("text").alias("technology"),
        F.col("lang").alias("cell_type"),
    )


def _only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]+", "")


def doc_protein(spark, sf_dir, dealt: bool = True) -> DataFrame:
    """Rates of the character classes, and the log length.

    The rare classes are counted in the few characters that belong to any of them,
    so the whole text is read twice instead of once per class.
    """
    text = F.col("text")
    rare = _only(text, "".join(CHAR_CLASSES[1:]))
    found = [F.length(_only(text, CHAR_CLASSES[0])), *[F.length(_only(rare, c)) for c in CHAR_CLASSES[1:]]]
    size = F.length(text)
    rates = [n / F.greatest(size, F.lit(1)) for n in found]
    return texts(spark, sf_dir, dealt).select(
        F.col("doc_id").alias("cell_id"), F.array(*rates, F.ln(1.0 + size) / 10.0).alias("features")
    )


def doc_rna(spark, sf_dir) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("features"))


def doc_tags(spark, sf_dir) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").alias("cell_id"), F.array("quality", "toxic").cast("array<double>").alias("features")
    )


def doc_modalities(spark, sf_dir, dealt: bool = True) -> dict[str, DataFrame]:
    return {
        "protein": doc_protein(spark, sf_dir, dealt),
        "rna": doc_rna(spark, sf_dir),
        "tags": doc_tags(spark, sf_dir),
    }


def pixels(spark, sf_dir) -> DataFrame:
    """Embeddings as one-channel 8x8 images in long form."""
    emb = load(spark, sf_dir, "embeddings")
    long = emb.select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("idx", "v"))
    return long.select(
        "img",
        F.expr("cast(idx div 8 as int)").alias("y"),
        (F.col("idx") % 8).alias("x"),
        F.lit(0).alias("c"),
        F.col("v").cast("double").alias("v"),
    )


def image_arrays(spark, sf_dir) -> DataFrame:
    """Embeddings as one-channel 8x8 images, one array each."""
    return images(load(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), (1, 8, 8))


# --- cells from orders ------------------------------------------------------------------


def order_meta(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        (F.col("o_custkey") % 3).alias("donor"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("cell_type"),
    )


def order_lines(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
    )
    return sums.select("cell_id", F.array("n", "qty", "price", "discount", "tax").alias("features"))


def customer_features(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"),
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("features"),
    )


# --- predictions and confidences from events --------------------------------------------


def class_of(column: str, classes: dict[str, int]) -> Column:
    pairs = [F.lit(v) for kv in classes.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def predictions(spark, sf_dir) -> DataFrame:
    """``fold, model, y_true, y_pred, tcp_true, tcp_pred, epoch`` of every event."""
    e = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(
        e.alias("cell_id"),
        (F.col("user_id") % 3).alias("fold"),
        F.when(e % 2 == 0, "protein").otherwise("rna").alias("modality"),
        class_of("event_type", EVENT_TYPES).alias("y_true"),
        ((F.col("user_id") % 25 + 1) * 10).alias("epoch"),
    )
    c = F.col("cell_id")
    guess = F.when(c % 10 < 7, F.col("y_true")).otherwise((c * 7 % 5).cast("int"))
    return rows.select(
        "*",
        guess.alias("y_pred"),
        ((c % 97 + 1) / 100.0).alias("tcp_true"),
        (c * 31 % 101 / 100.0).alias("tcp_pred"),
    )


def logits(spark, sf_dir) -> DataFrame:
    """Five logits per event: sin(event_id + 3k)."""
    z = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.sin((F.col("cell_id") + 3 * k).cast("double")))
    return predictions(spark, sf_dir).select("cell_id", "fold", "y_true", z.alias("z"))


# --- token bags from conversations ------------------------------------------------------


def tokens(spark, sf_dir) -> DataFrame:
    size = F.length("text")
    return load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        (size / 100.0).alias("score"),
        size.cast("double").alias("v0"),
        F.col("turn").cast("double").alias("v1"),
        (F.col("role") == "user").cast("double").alias("v2"),
    )
