"""Token ids in files: Simple-8b, 64-bit words whose top four bits say how many ids of which width follow.

A file row is a self-contained segment: a header, the offset of the first word of every block of 1,024 ids, the words,
and the escapes. A block starts a new word, so blocks decode alone or all at once with numpy. Values of 60 bits or more
are escaped: the word holds 0 and a side list holds the position and the full 64 bits.

The writer sorts by range of doc_id, so partition and row order follow the ids; each task packs whole documents into
segments of bounded size and the totals of the partitions (one number each) give the global start of every document.

Defined results: null text is empty and has the end id alone; null ids sort last; rows with the same id are ordered by
text; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable, narrow
from modalweave.llm.tokens import ChunkEncoder

# Ids per word and bits per id of each selector. The first two hold runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
BLOCK = 1024
#: Chunks in each generation that a worker of the writer remembers.
MEMORY = 400_000
LIMIT = np.uint64(1) << np.uint64(60)
HEADER = struct.Struct("<4sIIII")


def _choice(values: np.ndarray) -> np.ndarray:
    """For every position the selector a word that starts there takes: the first whose ids all fit. One row per block."""
    n, size = values.shape
    best, before = np.full(values.shape, 15, np.uint8), np.zeros((n, size + 241), np.int16)
    widest = int(values.max(initial=0)).bit_length()
    for s in range(14, -1, -1):
        if widest <= WIDTHS[s]:
            best[:] = s
            continue
        large = values >= np.uint64(1 << int(WIDTHS[s])).astype(values.dtype)
        if size - int(np.count_nonzero(large, axis=1).min(initial=size)) < COUNTS[s]:
            continue  # no block holds enough that fit
        # The values before each place that don't fit; after a block's end there are only zeros, which always fit.
        np.cumsum(large, axis=1, out=before[:, 1 : size + 1])
        before[:, size + 1 :] = before[:, size : size + 1]
        best[before[:, COUNTS[s] : COUNTS[s] + size] == before[:, :size]] = s
    return best


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of unsigned integers."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    escaped = np.flatnonzero(ids >= LIMIT)
    n_blocks = -(-n // block)
    padded = np.zeros(n_blocks * block, np.uint64)
    padded[:n] = ids
    padded[escaped] = 0
    values = padded.reshape(n_blocks, block)
    small = values.astype(np.uint32) if n and values.max() < 1 << 32 else values
    best = _choice(small)
    # All blocks step together: from each block's position by the count of the selector found there.
    position, live = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    owners, starts = [], []
    while len(live):
        owners.append(live)
        starts.append(position[live])
        position[live] += COUNTS[best[live, position[live]]]
        live = live[position[live] < block]
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    selector = best[owner, start]
    words = selector.astype(np.uint64) << np.uint64(60)
    wide = np.concatenate([values, np.zeros((n_blocks, 240), np.uint64)], axis=1).ravel() if n else values.ravel()
    place = owner * (values.shape[1] + 240) + start
    for s in range(2, 16):
        here = np.flatnonzero(selector == s)
        if len(here):
            first, word = place[here], words[here]
            for j in range(int(COUNTS[s])):
                word |= wide[first + j] << np.uint64(j * int(WIDTHS[s]))
            words[here] = word
    offsets = np.searchsorted(owner, np.arange(n_blocks + 1)).astype("<u4")
    body = [HEADER.pack(MAGIC, n, block, len(words), len(escaped)), offsets.tobytes(), words.astype("<u8").tobytes()]
    return b"".join([*body, escaped.astype("<u4").tobytes(), ids[escaped].astype("<u8").tobytes()])


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default) of a segment."""
    magic, n, block, n_words, n_escapes = HEADER.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    n_blocks = -(-n // block)
    at = HEADER.size
    offsets = np.frombuffer(segment, "<u4", n_blocks + 1, at).astype(np.int64)
    at += 4 * (n_blocks + 1)
    last = n_blocks if last is None else min(last, n_blocks)
    lo, hi = offsets[first], offsets[last]
    words = np.frombuffer(segment, "<u8", hi - lo, at + 8 * lo)
    at += 8 * n_words
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    owner = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
    place = np.cumsum(count) - count
    place -= place[offsets[first:last] - lo][owner] if len(words) else 0
    out = np.zeros((last - first) * block + 240, np.uint64)
    for s in range(2, 16):
        here = np.flatnonzero(selector == s)
        mask = (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
        for j in range(int(COUNTS[s])):
            inside = here[place[here] + j < block]
            value = words[inside] >> np.uint64(j * int(WIDTHS[s])) & mask
            out[owner[inside] * block + place[inside] + j] = value
    out = out[: min(last * block, n) - first * block]
    escaped = np.frombuffer(segment, "<u4", n_escapes, at).astype(np.int64) - first * block
    raw = np.frombuffer(segment, "<u8", n_escapes, at + 4 * n_escapes)
    inside = (escaped >= 0) & (escaped < len(out))
    out[escaped[inside]] = raw[inside]
    return out


FILES = pa.schema(
    [
        ("part", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("segment", pa.binary()),
    ]
)
ROWS = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_ids(
    df: DataFrame, id_col: str, text_col: str, path: str, spaces: bool, end_id: int, segment_ids: int = 1 << 18
) -> DataFrame:
    """Encode every text, append end_id, write segments in ascending id order; returns the written table.

    path: the tokenizer's file, the same on every executor. Columns: part, first (ids before the segment in its part),
    doc_ids, lengths, segment.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.shared(path, spaces, MEMORY)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, held, first, part = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids, lengths = np.frombuffer(b"".join(parts), "<u4"), [len(p) // 4 for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip((part, first, doc_ids, lengths, pack(ids)), FILES, strict=True)],
                schema=FILES,
            )

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= segment_ids:
                    yield segment()
                    first += held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield segment()

    key = F.col("doc_id").asc_nulls_last()
    rows = narrow(df, id_col, text_col).repartitionByRange(key).sortWithinPartitions(key, "text")
    schema = "part int, first long, doc_ids array<long>, lengths array<long>, segment binary"
    return durable(rows.withColumn("part", F.spark_partition_id()).mapInArrow(encode, schema), "token-ids")


def read_ids(files: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["segment"]).astype("<u4").tobytes()
                lengths = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), row["lengths"], strict=True)]
                columns = (row["doc_ids"], row["start"] + ends - lengths, lengths, crcs)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=ROWS)

    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.groupBy("part").agg(F.sum(size).alias("total"))  # one row for each partition of the writer
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    placed = files.join(totals.select("part", before.alias("before")), "part")
    placed = placed.select("doc_ids", "lengths", "segment", (F.col("first") + F.col("before")).alias("start"))
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
