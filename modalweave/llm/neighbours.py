"""Nearest neighbours by a block matrix join with 8-bit tiles and float recomputation.

Queries and candidates are packed into blocks of at most `block` vectors; every query block meets every candidate block
(a stated query set against all rows). A piece of work is some query blocks and a group of candidate blocks, which are
dealt out and sorted together, queries first: nothing is joined, so nothing is sent through the driver, and a task holds
the query blocks of one piece and one candidate block. In a tile the 8-bit codes are multiplied (sums of such products are
exact in single precision up to 1,040 dimensions, in double beyond). Each vector carries its scale and the exact norm of
what rounding took from it, so Cauchy-Schwarz bounds every distance from below and above. A candidate whose lower bound
exceeds the k-th smallest upper bound of its query can't be among the k nearest; the others are recomputed from the
original vectors in double precision. A task keeps a heap of k per query (and hands them on when it
holds too many); the heaps are merged by rank.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without
id; vectors meet only those of the same length; rows that repeat id and vector count once; a candidate with the query's id
is the query's own; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable

#: Candidate blocks of a piece of work at least; at most MOST_BLOCKS, and fewer only while there are GROUPS groups.
BLOCKS_PER_GROUP, MOST_BLOCKS, GROUPS = 4, 64, 32
#: Query blocks that a piece of work holds, on average.
QUERY_BLOCKS = 8
MOST_TASKS = 4096
#: Heaps a task keeps before it hands them on.
HELD = 50_000
BLOCKS = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles), dim of the vectors that take part, each once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0.0)
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(~bad & ~zero)
    return rows.dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector"))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows of up to `block` vectors of one length: dim, ids (longs), vectors (doubles), both as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            values = (dim, np.array(ids, np.int64).tobytes(), np.array(vectors, np.float64).tobytes())
            arrays = [pa.array([v], f.type) for v, f in zip(values, BLOCKS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=BLOCKS)

        for batch in batches:
            for vec_id, dim, vector in zip(*(batch[c].to_pylist() for c in ("vec_id", "dim", "vector")), strict=True):
                ids, vectors = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) == block:
                    yield row(dim)
        for dim in list(held):
            yield row(dim)

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary")


class Quantised:
    """A block in 8 bits: codes, scale, and the norm of the rounding errors of every vector."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)
        top = np.abs(self.vectors).max(axis=1)
        self.scale = np.maximum(top / 127, np.finfo(float).tiny)
        codes = np.rint(self.vectors / self.scale[:, None]).astype(np.int8)
        self.codes = codes.astype(np.float32 if dim <= 1040 else np.float64)
        near = codes * self.scale[:, None]
        self.error = np.sqrt(((self.vectors - near) ** 2).sum(axis=1))
        self.norm, self.square = np.sqrt((near**2).sum(axis=1)), (self.vectors**2).sum(axis=1)


def bounds(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Below and above every squared distance of the tile, rounding of doubles included."""
    product = (a.codes @ b.codes.T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    slack = a.error[:, None] * (b.norm + b.error)[None, :] + a.norm[:, None] * b.error[None, :]
    sums = a.square[:, None] + b.square[None, :]
    slack = 2 * slack + 1e-9 * sums
    middle = sums - 2 * product
    return middle - slack, middle + slack


def tile(a: Quantised, b: Quantised, k: int, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a: candidates of b that may be among its k nearest, and their exact distances.

    limit: a squared distance per query that its k-th neighbour is known not to exceed.
    """
    below, above = bounds(a, b)
    own = a.ids[:, None] == b.ids[None, :]
    above[own] = below[own] = np.inf
    if b.ids.size > k:
        limit = np.minimum(limit, np.partition(above, k - 1, axis=1)[:, k - 1])
    for i, at in enumerate(below <= limit[:, None]):
        at = np.flatnonzero(at & np.isfinite(below[i]))
        if len(at):
            yield i, b.ids[at], np.sqrt(np.cumsum((b.vectors[at] - a.vectors[i]) ** 2, axis=1)[:, -1])


def nearest(
    df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, block: int = 1024
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest rows of every query row.

    is_query: a condition on vec_id. An id with several vectors counts once for each of them, on both sides, as in the SQL.
    """
    rows = durable(usable(df, id_col, vector_col), "vectors")
    all_blocks = durable(packed(rows, block), "blocks")
    asked = rows.where(is_query)
    queries = durable(packed(asked.coalesce(asked.count() // block + 1), block), "queries")
    # Every group of candidate blocks meets every chunk of query blocks: the one is copied per chunk, the other per group.
    n_blocks = all_blocks.count()
    groups = min(n_blocks // BLOCKS_PER_GROUP + 1, max(GROUPS, n_blocks // MOST_BLOCKS))
    chunks = queries.count() // QUERY_BLOCKS + 1
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(chunks * groups, MOST_TASKS))

    def side(blocks: DataFrame, role: int, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        part = blocks.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n_own)).cast("int"))
        part = part.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return part.select("dim", "chunk", "group", F.lit(role).alias("role"), "ids", "vectors")

    pieces = side(queries, 0, "chunk", chunks, "group", groups).unionByName(side(all_blocks, 1, "group", groups, "chunk", chunks))
    keys = ["dim", "chunk", "group"]
    pieces = pieces.repartition(tasks, *keys).sortWithinPartitions(*keys, "role")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        piece, held = None, []

        def flush() -> pa.RecordBatch:
            found = [(q, -v, -s) for (_, q), heap in heaps.items() for s, v in heap]
            heaps.clear()
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for row in (batch.slice(r, 1).to_pylist()[0] for batch in batches for r in range(batch.num_rows)):
            if piece != (now := tuple(row[c] for c in keys)):
                if len(heaps) > HELD:
                    yield flush()
                piece, held = now, []
            block_ = Quantised(row["ids"], row["vectors"], row["dim"])
            if row["role"] == 0:
                held.append((block_, [heaps.setdefault((row["dim"], int(q)), []) for q in block_.ids]))
                continue
            for a, own in held:
                limit = np.array([h[0][0] ** 2 * (1 + 1e-9) if len(h) == k else np.inf for h in own])
                for i, ids, scores in tile(a, block_, k, limit):
                    for vec_id, score in zip(ids.tolist(), scores.tolist(), strict=True):
                        entry = (-score, -vec_id)  # the worst of the k is on top
                        if len(own[i]) < k:
                            heapq.heappush(own[i], entry)
                        elif entry > own[i][0]:
                            heapq.heapreplace(own[i], entry)
        yield flush()

    tiles = pieces.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranks = tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
