"""Hard negatives by exact integer scores: products in a residue number system, then selection within score windows.

Vectors are scaled and floored to integers. A score is an inner product of integers, which single precision doesn't hold
exactly; its remainders by small primes do. Each block of vectors is reduced modulo the primes, centred, and the remainders
are multiplied as float32 matrices: with primes below 256 and slices of 1,024 components every sum stays below 2^24, so it is
exact. The signed score is put together from the remainders by Chinese remaindering in mixed radix. A tile takes as many
primes as its own bound (Cauchy-Schwarz on the largest norms) asks for.

Blocks lie sorted by label. The first pass meets anchor blocks with the candidate blocks whose labels overlap theirs and keeps
the `positives` best rows of the anchor's label; the second meets all and keeps, for each positive, the `negatives` best rows
of other labels whose score lies within the window that the positive's score opens. Both are joins on a grid of cells of
block pairs (a stated query set against all rows): a cell is bounded in blocks, and a block goes to the cells of its row or
column of the grid only. A task keeps the best per anchor, never the pairs; the cells' results are ranked by a window.

Defined results: rows without label or vector, or with a null or non-finite component, take no part, nor rows without id;
vectors meet only those of as many components; rows that repeat id, label and integers count once; other rows with the
anchor's id are the anchor's own and no candidates of it; higher scores come first, ties by smaller id; an empty table
gives no rows. Components beyond 2^30 after scaling, or scores that may pass 2^56, are errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable

# The largest primes below 256. Their product is above 2^62, so each score below 2^56 has its own remainders.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Components multiplied at once: 1024 x 125^2 is below 2^24.
SLICE = 1024
LARGEST = 1 << 56
BLOCK = 1024
#: Block pairs of a cell, unless the table is so small that some cores would be idle.
PAIRS = 4096
#: In place of the score of a positive that an anchor doesn't have.
NO_SCORE = -(1 << 62)
#: Results a task keeps before it hands them on.
HELD = 200_000
BLOCKS = "dim int, block long, low long, high long, seqs binary, ids binary, labels binary, codes binary"
FOUND = pa.schema([(n, pa.int64()) for n in ("anchor_seq", "slot", "seq", "vec_id", "score")])


def residues(codes: np.ndarray, prime: int) -> np.ndarray:
    """Remainders between -prime / 2 and prime / 2, in single precision."""
    r = np.mod(codes, prime)
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as tell all integers from -bound to bound apart."""
    if bound >= LARGEST:
        raise ValueError(f"scores may reach {bound}, beyond {LARGEST}")
    product, n = 1, 0
    while product < 2 * bound + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[: max(n, 1)]


class Block:
    """Vectors of one length with the remainders asked for so far."""

    def __init__(self, row: dict):
        self.seqs, self.ids = np.frombuffer(row["seqs"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.int32).reshape(len(self.ids), row["dim"])
        squares = (self.codes.astype(np.float64) ** 2).sum(axis=1)
        self.norm = math.sqrt(float(squares.max(initial=0.0))) * (1 + 1e-12)
        self.known: dict[int, np.ndarray] = {}

    def modulo(self, prime: int) -> np.ndarray:
        if prime not in self.known:
            self.known[prime] = residues(self.codes, prime)
        return self.known[prime]


def product_modulo(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a x b' modulo the prime, from 0 on: float32 products of slices, each sum exact."""
    total = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, a.shape[1], SLICE):
        total += (a[:, lo : lo + SLICE] @ b[:, lo : lo + SLICE].T).astype(np.int64)
    return total % prime


def exact_scores(a: Block, b: Block) -> np.ndarray:
    """All inner products of two blocks as signed integers, by Chinese remaindering."""
    value, product = None, 1
    for prime in primes_for(int(a.norm * b.norm) + 1):
        remainder = product_modulo(a.modulo(prime), b.modulo(prime), prime)
        if value is None:
            value = remainder
        else:
            digit = (remainder - value) % prime * pow(product, -1, prime) % prime
            value += product * digit
        product *= prime
    return np.where(value > product // 2, value - product, value)


class Best:
    """The k best (score, then smaller id, then smaller seq) of every slot of an anchor block."""

    def __init__(self, slots: int, k: int):
        self.k, self.rows = k, np.zeros((4, 0), np.int64)  # slot, score, id, seq
        self.score = np.full(slots, np.iinfo(np.int64).min)  # of the k-th, if there is one
        self.id = np.full(slots, np.iinfo(np.int64).max)

    def promising(
        self, scores: np.ndarray, allowed: np.ndarray, slots: np.ndarray, ids: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places of the allowed scores that may be among the k best. slots: the slot of each row; ids: of each column."""
        limit = self.score[slots][:, None]
        allowed = allowed & ((scores > limit) | ((scores == limit) & (ids[None, :] <= self.id[slots][:, None])))
        if np.count_nonzero(allowed) > 4 * self.k * len(slots) and len(ids) > self.k:
            masked = np.where(allowed, scores, np.iinfo(np.int64).min)
            cut = len(ids) - self.k
            allowed &= scores >= np.partition(masked, cut, axis=1)[:, cut : cut + 1]
        return np.nonzero(allowed)

    def merge(self, found: list[np.ndarray]) -> None:
        """found: arrays of (slot, score, id, seq)."""
        rows = np.concatenate([self.rows, *found], axis=1)
        if rows.shape[1] == self.rows.shape[1]:
            return
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.k]
        last = rows[:, place == self.k - 1]
        self.score[last[0]], self.id[last[0]] = last[1], last[2]


def integers(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, dim, codes of the rows that take part, each once."""
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(~bad)
    big = F.raise_error(F.lit("a component is beyond 2^30 after scaling")).cast("int")

    def code(x: Column) -> Column:
        scaled = F.floor(x * float(scale))
        return F.when(F.abs(x) < float(2**30) / scale, scaled.cast("int")).otherwise(big)

    rows = rows.select("vec_id", "label", F.size("vector").alias("dim"), F.transform("vector", code).alias("codes"))
    return rows.dropDuplicates(["vec_id", "label", "codes"])


def packed(rows: DataFrame, block: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of up to `block` vectors of one length, in the order in which they come. extra: array<long> columns to take along."""
    kinds = {"dim": pa.int32(), "block": pa.int64(), "low": pa.int64(), "high": pa.int64()}
    names = ["dim", "block", "low", "high", "seqs", "ids", "labels", "codes", *extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}

        def row(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            labels = [r["label"] for r in own]
            numbers = {n: np.array([r[c] for r in own], np.int64).tobytes() for n, c in (("seqs", "seq"), ("ids", "vec_id"), ("labels", "label"))}
            values = {"dim": dim, "block": own[0]["seq"], "low": min(labels), "high": max(labels), **numbers}
            values["codes"] = np.array([r["codes"] for r in own], np.int32).tobytes()
            values |= {e: np.array([r[e] for r in own], np.int64).tobytes() for e in extra}
            arrays = [pa.array([values[n]], kinds.get(n, pa.binary())) for n in names]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                for r in batch.slice(lo, block).to_pylist():
                    own = held.setdefault(r["dim"], [])
                    own.append(r)
                    if len(own) == block:
                        yield row(r["dim"])
        for dim in list(held):
            yield row(dim)

    return rows.mapInArrow(run, BLOCKS + "".join(f", {e} binary" for e in extra))


def by_label(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    keys = ["dim", "label", "vec_id", "codes"] if "seq" not in rows.columns else ["dim", "label", "vec_id", "seq"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *keys)
    return ranged.sortWithinPartitions(*keys)


def meeting(anchors: DataFrame, candidates: DataFrame, useful: Column, pairs: int) -> DataFrame:
    """Anchor blocks (columns a_...) beside candidate blocks (c_...), cell by cell."""
    n_a, n_c = max(anchors.count(), 1), max(candidates.count(), 1)
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    per = max(1, min(pairs, n_a * n_c // (4 * cores)))
    side = min(n_a, math.isqrt(per - 1) + 1)
    rows, columns = -(-n_a // side), -(-n_c // max(1, per // side))

    def spread(df: DataFrame, prefix: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        named = df.select("dim", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "dim"])
        named = named.withColumn(own, F.pmod(F.xxhash64(f"{prefix}_block"), F.lit(n_own)).cast("int"))
        return named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = spread(anchors, "a", "cell_row", rows, "cell_column", columns)
    right = spread(candidates, "c", "cell_column", columns, "cell_row", rows)
    return left.join(right, ["dim", "cell_row", "cell_column"]).where(useful)


def search(met: DataFrame, k: int, slots: int = 0, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """The k best candidates of every slot: anchor_seq, slot, seq, vec_id, score. Without slots: rows of the anchor's label;
    else, for each of its positives (a_scores), rows of other labels in the window."""
    extra = ["a_scores"] if slots else []
    fields = ["block", "seqs", "ids", "labels", "codes"]
    used = met.select("dim", *[f"{p}_{f}" for p in "ac" for f in fields], *extra)
    width = max(slots, 1)

    def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        scores = np.frombuffer(raw, np.int64).reshape(-1, slots)
        there = scores != NO_SCORE
        scores = np.where(there, scores, 0)
        return np.where(there, -(-scores * window[0] // 100), 0), np.where(there, scores * window[1] // 100, -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, Best]] = {}
        seen: dict[str, tuple[int, Block]] = {}

        def block(row: dict, p: str) -> Block:
            key = row[f"{p}_block"]
            if p not in seen or seen[p][0] != key:
                seen[p] = (key, Block({"dim": row["dim"]} | {f: row[f"{p}_{f}"] for f in fields}))
            return seen[p][1]

        def flush() -> Iterator[pa.RecordBatch]:
            for seqs, best in state.values():
                slot, score, ids, own = best.rows
                columns = [seqs[slot // width], slot % width, own, ids, score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)
            state.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                a, b = block(row, "a"), block(row, "c")
                seqs, best = state.setdefault(row["a_block"], (a.seqs, Best(len(a.ids) * width, k)))
                scores, found = exact_scores(a, b), []
                same = a.labels[:, None] == b.labels[None, :]
                other = a.ids[:, None] != b.ids[None, :]

                def keep(rows: np.ndarray, slot: np.ndarray, allowed: np.ndarray) -> None:
                    at, who = best.promising(scores[rows], allowed, slot, b.ids)
                    found.append(np.array([slot[at], scores[rows[at], who], b.ids[who], b.seqs[who]], np.int64))

                if slots:
                    lows, highs = windows(row["a_scores"])
                    free = ~same & other & (scores >= lows.min(axis=1)[:, None]) & (scores <= highs.max(axis=1)[:, None])
                    rows = np.flatnonzero(free.any(axis=1))
                    for j in range(slots if len(rows) else 0):
                        inside = (scores[rows] >= lows[rows, j, None]) & (scores[rows] <= highs[rows, j, None])
                        keep(rows, rows * slots + j, free[rows] & inside)
                else:
                    keep(np.arange(len(a.ids)), np.arange(len(a.ids)), same & other)
                if found:
                    best.merge(found)
                if sum(x.rows.shape[1] for _, x in state.values()) > HELD:
                    yield from flush()
        yield from flush()

    return used.mapInArrow(run, "anchor_seq long, slot long, seq long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_seq", "slot").orderBy(F.desc("score"), "vec_id", "seq")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    label: Column,
    is_anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    block: int = BLOCK,
    pairs: int = PAIRS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on vec_id. window: percentages of the positive's score between which a negative's score lies.
    """
    rows = by_label(durable(integers(df, id_col, vector_col, label, scale), "integers"))
    rows = durable(rows.withColumn("seq", F.monotonically_increasing_id()), "rows")
    candidates = durable(packed(rows, block), "candidates")
    asked = durable(rows.where(is_anchor), "asked")
    tasks = asked.count() // block + 1
    anchors = durable(packed(by_label(asked, tasks), block), "anchors")
    overlap = (F.col("a_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("a_high"))
    firsts = durable(ranked(search(meeting(anchors, candidates, overlap, pairs), positives), positives), "positives")

    # Each anchor with its positives.
    own = firsts.groupBy(F.col("anchor_seq").alias("seq")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own")
    )
    with_own = asked.join(own, "seq").withColumn("own", F.transform("own", lambda x: F.struct(x["vec_id"], x["score"])))
    places = F.sequence(F.lit(0), F.lit(positives - 1))
    scores = F.transform(places, lambda i: F.coalesce(F.get("own", i)["score"], F.lit(NO_SCORE)))
    with_own = durable(with_own.withColumn("scores", scores), "with-positives")
    again = with_own.select("seq", "vec_id", "label", "dim", "codes", "scores")
    anchors = durable(packed(by_label(again, tasks), block, ("scores",)), "anchors")
    alike = (F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("c_low"))
    found = ranked(search(meeting(anchors, candidates, ~alike, pairs), negatives, positives, window), negatives)
    told = with_own.select(F.col("seq").alias("anchor_seq"), F.col("vec_id").alias("anchor_id"), "own")
    positive = F.get("own", F.col("slot").cast("int"))
    return found.join(told, "anchor_seq").select(
        "anchor_id",
        positive["vec_id"].alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
