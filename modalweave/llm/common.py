"""What the operators of this folder share: reading, words, and tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalweave.sources.sinks import checkpoint_folder

#: ASCII white space as Java's regular expressions write it.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Spark removes an execution's shuffle files at its end; what was written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[str]:
    """A new path in the shared folder; executions within free their shuffle files at their end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, frees the shuffle files."""
    spark = df.sparkSession
    with freeing_shuffles(spark) as path:
        df.write.parquet(f"{path}-{name}")
    return spark.read.schema(df.schema).parquet(f"{path}-{name}")


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As `durable`, in buckets by a key: later joins on the key read it as it lies, without an exchange."""
    spark = df.sparkSession
    with freeing_shuffles(spark) as path:
        table = f"{name}_{path.rpartition('/')[2]}"
        writer = df.repartition(buckets, key).write.option("path", f"{path}-{name}").option("compression", "zstd")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files lie outside the warehouse and stay; what was resolved knows its buckets
    return found


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under names of our own, so other columns can't clash; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def whole_row(df: DataFrame) -> Column:
    """All columns as one, to carry them past columns of our own whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpack(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])
