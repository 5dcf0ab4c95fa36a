"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most `size` tokens (only longer ones are cut; the first piece takes the remainder), pieces
of full size are sequences of their own. For the others as many sequences are opened as their tokens need. In a round the
open pieces and the gaps of all sequences are sorted by size, and a sweep over the sorted list matches every gap with the
longest open piece that fits and no other gap took: a gap that follows a piece closes it, like brackets. Gaps are updated
and the round is repeated; new sequences are opened only for pieces that are longer than every gap.

The sweep is distributed. Its depth at a size follows from the counts of pieces and gaps per size (at most 2 x `size`
rows); a row's depth follows from that and its rank among equals, and ranks come from counts per salt, so a length that a
third of all rows share is split over tasks. Rows of equal depth alternate between pieces and gaps and meet in one group;
as equal sizes are ordered pieces first, a depth is met at most twice per size, which bounds a group by 2 x `size` rows.
A sequence with room for several of the longest open pieces offers several gaps (slots); the rank resolves who gets which.

Defined results: null text is empty and has the end id alone; a null id is kept as it is; repeated rows are packed each;
an empty table gives no rows; ties between equal lengths are resolved by hash of id and piece, so results repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable, narrow
from modalweave.llm.tokens import KEPT, MEMORY, ChunkEncoder

SALTS = 64
#: Tables of fewer rows stay in one partition, where the steps of a sweep need no exchange.
ROWS_PER_TASK = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, size: int, memory: int = MEMORY, kept: int = KEPT
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    memory: chunks that a worker remembers in each generation; kept: those it keeps from one task to the next.
    """
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema(list(zip(names, types, strict=True)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.shared(path, True, memory)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % size + 1)  # the remainder first, then full pieces
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, piece = to, piece + 1
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        encoder.rest(kept)

    return narrow(df, id_col, text_col).mapInArrow(cut, PIECES)


def ranked(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """rows with `rank` (from 0) among those of equal keys: a window per salt, and the counts of the salts before."""
    rows = rows.withColumn("salt", F.pmod(F.hash(tie), F.lit(SALTS)))
    inner = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(tie)) - 1)
    sums = rows.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("salt")) - F.col("n")
    found = inner.join(sums.select(*keys, "salt", before.alias("before")), [*keys, "salt"])
    return found.withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def offers(gaps: dict[int, int], low: int, high: int, wanted: int) -> dict[int, int]:
    """Slots a sequence offers, by its gap. gaps: sequences by gap; pieces of low < length <= high, `wanted` of them.

    Small gaps come first, and no more slots than pieces, but for rounding up within the last gap size.
    """
    out = {}
    for gap in sorted(g for g in gaps if g > low):
        if wanted <= 0:
            break
        each = min(max(1, gap // high), -(-wanted // gaps[gap]))
        out[gap] = each
        wanted -= each * gaps[gap] if gap >= high else 0
    return out


def sweep_counts(lengths: dict[int, int], slots: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """From pieces per length and slots per size: the depth before each size, and the pieces left of each length.

    The longest open piece is closed first, and of equal ones those of highest rank, so the pieces left of a length are
    its first ranks.
    """
    depth, before, stack = 0, {}, []
    for size in sorted({*lengths, *slots}):
        before[size] = depth
        depth += lengths.get(size, 0) - slots.get(size, 0)
        if lengths.get(size):
            stack.append([size, lengths[size]])
        closing = slots.get(size, 0)
        while closing and stack:
            taken = min(closing, stack[-1][1])
            stack[-1][1] -= taken
            closing -= taken
            if not stack[-1][1]:
                stack.pop()
    return before, dict(stack)


def sweep(
    items: DataFrame, gaps: DataFrame, lengths: dict[int, int], offered: dict[int, int], high: int, hist: dict[int, int]
) -> tuple[DataFrame, dict[int, int]]:
    """One matching of open pieces with slots: the placements, and the pieces left of each length.

    items: pieces with `rank` among their length, open while rank < lengths[length]. gaps: seq, gap.
    """
    spark, slot_sizes = items.sparkSession, {}
    for gap, each in offered.items():
        last = gap - (each - 1) * high
        slot_sizes[last] = slot_sizes.get(last, 0) + hist[gap]
        if each > 1:
            slot_sizes[high] = slot_sizes.get(high, 0) + (each - 1) * hist[gap]
    before, left = sweep_counts(lengths, slot_sizes)
    # Both tables have a row per size at most, so they are sent to every task.
    sizes = [(s, d, lengths.get(s, 0)) for s, d in before.items()]
    depths = F.broadcast(spark.createDataFrame(sizes, "size long, depth long, open long"))
    each = F.broadcast(spark.createDataFrame(list(offered.items()), "gap long, each int"))
    slots = gaps.join(each, "gap").select("seq", "gap", "each", F.explode(F.sequence(F.lit(1), "each")).alias("slot"))
    size = F.when(F.col("slot") == F.col("each"), F.col("gap") - (F.col("each") - 1) * high).otherwise(F.lit(high))
    slots = slots.select("seq", size.cast("long").alias("size"), F.xxhash64("seq", "slot").alias("tie"))
    slots = ranked(slots, ["size"], "tie").join(depths, "size")
    level = F.col("depth") + F.col("open") - F.col("rank")
    slots = slots.select(level.alias("level"), "size", F.lit(1).alias("kind"), "seq", F.lit(None).alias("item"))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    open_items = items.join(depths, items["length"] == depths["size"]).where("rank < open")
    level = F.col("depth") + F.col("rank") + 1
    open_items = open_items.select(
        level.alias("level"), "size", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), item.alias("item")
    )
    in_order = Window.partitionBy("level").orderBy("size", "kind")
    closed = open_items.unionByName(slots).withColumn("closes", F.lag("item").over(in_order))
    return closed.where("kind = 1 AND closes IS NOT NULL").select("closes.*", "seq"), left


def counts(df: DataFrame, column: str) -> dict[int, int]:
    """Rows by value of a column that has at most `size` values."""
    return {int(r[0]): int(r[1]) for r in df.groupBy(column).agg(F.count(F.lit(1))).collect()}


def best_fit(
    df: DataFrame,
    id_col: str,
    text_col: str,
    path: str,
    end_id: int = 0,
    size: int = 2048,
    memory: int = MEMORY,
    kept: int = KEPT,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in its sequence).

    memory, kept: chunks that a worker remembers within and between tasks; they never change a result.
    """
    spark = df.sparkSession
    cut = durable(pieces(df, id_col, text_col, path, end_id, size, memory, kept), "pieces")
    whole = cut.where(F.col("length") == size).withColumn("seq", -1 - F.monotonically_increasing_id())
    short = cut.where(F.col("length") < size).withColumn("tie", F.xxhash64("doc_id", "piece", "ids_crc32"))
    items = durable(ranked(short, ["length"], "tie"), "items")
    lengths = counts(items, "length")
    gaps = spark.range(0).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap"))
    opened, placed = 0, []
    while lengths:
        hist = counts(gaps, "gap")
        room = max(hist, default=0)
        stuck = {k: n for k, n in lengths.items() if k > room}
        if stuck:  # no gap takes the longest: as many new sequences as those pieces need at least
            tokens, alone = sum(k * n for k, n in stuck.items()), sum(n for k, n in stuck.items() if 2 * k > size)
            more = max(-(-tokens // size), alone)
            fresh = spark.range(opened, opened + more)
            fresh = fresh.select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap"))
            gaps, opened = gaps.unionAll(fresh), opened + more
            hist[size] = hist.get(size, 0) + more
        low, high = min(lengths), max(lengths)
        near = items.where(F.col("length").between(low, high)).coalesce(sum(lengths.values()) // ROWS_PER_TASK + 1)
        gaps = gaps.coalesce(sum(hist.values()) // ROWS_PER_TASK + 1)
        offered = offers(hist, low - 1, high, sum(lengths.values()))
        found, lengths = sweep(near, gaps, lengths, offered, high, hist)
        placed.append(durable(found, "placed"))
        used = placed[-1].groupBy("seq").agg(F.sum("length").alias("used"))
        gap = (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")
        gaps = durable(gaps.join(used, "seq", "left").select("seq", gap).where("gap > 0"), "gaps")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "seq"]
    result = whole.select(columns)
    for part in placed:
        result = result.unionAll(part.select(columns))
    in_order = Window.partitionBy("seq").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    offset = F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return result.withColumn("offset", offset).withColumnRenamed("seq", "sequence_id")
