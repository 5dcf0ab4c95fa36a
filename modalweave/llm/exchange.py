"""Exchange of keys between blocks of documents and shards of the key space.

A block is a row that holds whole documents of a few megabytes. Of all its keys it sends each once, packed with the others
of the same shard, so a key that a third of all documents hold costs one entry a block, and a shard holds an even share of
the key space. The shard answers every entry in the order it came; the answers of a block are joined to its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import bucketed, narrow

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
BUCKETS = 8192
NO_ID = np.iinfo(np.int64).max
BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
BLOCK_SQL = "block long, size long, doc_ids array<long>"
TEXTS = pa.schema([("texts", pa.list_(pa.string()))])


def text_blocks(
    df: DataFrame,
    id_col: str,
    text_col: str,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
    buckets: int = BUCKETS,
    form: Callable[[list[str]], tuple] | None = None,
    columns: pa.Schema = TEXTS,
) -> tuple[DataFrame, int]:
    """The documents in blocks (block, size, doc_ids, texts), and the number of shards for their keys.

    A block holds what ``form`` makes of its texts, in ``columns``, in place of the texts.

    Blocks are written in buckets by their number, as many as shards but at most `buckets` (Spark allows 100,000), so
    answers are joined without moving the texts. Shards grow with the text whatever the buckets.
    """
    schema = pa.schema([*BLOCK, *columns])
    kinds = {pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made, part = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            values = ((part << 32) + made, size, ids, *(form(texts) if form else (texts,)))
            arrays = [pa.array([v], f.type) for v, f in zip(values, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= block_bytes or len(ids) >= 50_000:
                    yield row()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield row()

    spark, rows = df.sparkSession, narrow(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shard_bytes + 1)
    blocks = rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        run, ", ".join([BLOCK_SQL, *(f"{c.name} {kinds[c.type]}" for c in columns)])
    )
    return bucketed(blocks, "block", min(shards, buckets), "blocks"), shards


def packed(keys: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def planes(values: np.ndarray, dtype: str) -> bytes:
    """Numbers byte by byte: all lowest bytes first. High bytes are mostly equal and compress."""
    values = values.astype(dtype)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def slices(shard_of: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """shard, from, to of every shard that has entries; shard_of is sorted."""
    cuts = np.searchsorted(shard_of, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, int(cuts[s]), int(cuts[s + 1])


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks beside their answers: for each name an array of (shard, payload). answers: block, shard, payload."""
    for name, rows in answers.items():
        own = rows.groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias(name))  # a row per shard
        blocks = blocks.join(own, "block", "left")
    return blocks


def answer(of_block: list[dict] | None) -> dict[int, bytes]:
    return {a["shard"]: a["payload"] for a in of_block or ()}


def batched(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 256):
        columns = zip(*rows[lo : lo + 256], strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
