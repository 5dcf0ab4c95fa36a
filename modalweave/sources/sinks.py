"""Writers: result tables, confusion matrices, model parameters, metric log, durable tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table has one row per model and run, so one CSV file is enough."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def confusion_wide(matrix: DataFrame, value: str, n_classes: int) -> DataFrame:
    """Long matrix to one row per true class and one column per predicted class."""
    wide = matrix.groupBy("y_true").pivot("y_pred", list(range(n_classes))).agg(F.first(value))
    return wide.orderBy("y_true")


def write_confusion(matrix: DataFrame, value: str, n_classes: int, path: str) -> None:
    outside = [F.col(c).isNull() | ~F.col(c).between(0, n_classes - 1) for c in ("y_true", "y_pred")]
    if not matrix.where(outside[0] | outside[1]).isEmpty():
        raise ValueError(f"the matrix has labels outside 0 to {n_classes - 1}, which the file has no place for")
    wide = confusion_wide(matrix, value, n_classes).coalesce(1).sortWithinPartitions("y_true")
    wide.drop("y_true").write.mode("overwrite").csv(path, header=False)


def run_path(results: str, run_id: str, *parts: str) -> str:
    return "/".join([results.rstrip("/"), f"run_id={run_id}", *parts])


def put_rows(df: DataFrame, path: str, run_id: str, attempt: int = 0) -> None:
    """Rows of a run and attempt in a table of all runs. Written again, they replace themselves and nothing else."""
    named = df.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "attempt").parquet(path)


def append_log(df: DataFrame, path: str, run_id: str, attempt: int = 0) -> None:
    """Metric rows of a run in the log table."""
    put_rows(df, path, run_id, attempt)


def write_run(spark: SparkSession, options: dict, path: str, run_id: str, attempt: int = 0) -> None:
    """One row of options, each as JSON, in the table of runs."""
    values = {k: json.dumps(v) for k, v in options.items()}
    rows = spark.createDataFrame([(values,)], "options map<string, string>").coalesce(1)
    put_rows(rows, path, run_id, attempt)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Spark removes an execution's shuffle files at its end; what was written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For tables whose rows are blocks of megabytes: few are read, written or handed to Python at once.
BLOCKWISE = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
BLOCK_FILES = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}


@contextmanager
def held_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the executions within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def durable(df: DataFrame, name: str = "table", freed: bool = False, blocks: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: what follows reads columns from storage, whatever executors are lost. ``freed``: shuffle files go at
    the end; ``blocks``: also, and rows of megabytes are read or written. Both set what is the session's while they write,
    so they are not for threads side by side.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with held_conf(df.sparkSession, ({CLEANUP: "true"} if freed or blocks else {}) | (BLOCKWISE if blocks else {})):
        df.write.options(**(BLOCK_FILES if blocks else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
