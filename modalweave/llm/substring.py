"""Passages that repeat across documents, found by difference-cover anchors.

A set of residues modulo `period` is a difference cover if every difference modulo the period is one of two of its
members. For any two places i and j some shift d < period then brings both i + d and j + d to covered residues. Anchors are
hashes of `window` - `period` + 1 words at covered places only; two equal windows, wherever they start, thus share an
anchor at the same shift. Anchors that only one document holds rule out every window around them.

1. Blocks send their anchors (48-bit hashes) to shards; a shard answers which of them another document holds too.
2. Where an anchor is shared it is extended: every window that contains it is hashed with 128 bits of which 96 are kept,
   and sent with the smallest id that has it; a shard answers whether a smaller id has it elsewhere.
3. Words under a window that starts in a document with a smaller id are removed. Windows are judged on the input.

An anchor or window counts once per block however often it comes, so a line that a third of all documents hold is no hot
key. A false 48-bit match only costs a window's extension; equal 96-bit hashes of different windows don't occur in practice.

Defined results: null and empty texts have no words; a null id is larger than every id; rows that share an id don't remove
each other's words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from modalweave.llm.common import durable
from modalweave.llm.exchange import (
    BLOCK_BYTES,
    NO_ID,
    answer,
    batched,
    packed,
    planes,
    slices,
    text_blocks,
    unpacked,
    unplanes,
    with_answers,
)

LOW48 = np.uint64((1 << 48) - 1)


def difference_cover(period: int) -> list[int]:
    """The smallest set of residues, first in order, whose differences are all residues."""
    for size in range(1, period + 1):
        for chosen in combinations(range(period), size):
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return list(chosen)
    return []


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hashes of the windows of `size` word hashes that start at the given places."""
    out = np.zeros(len(at), np.uint64)
    for j, c in enumerate(factors(size, seed)):
        out += words[at + j] * c
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


class Words:
    """The words of a block's documents one after another."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.words = [t.encode().split() for t in row["texts"]]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        n = int(lengths.sum())
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w) for own in self.words for w in own), np.uint64, n)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.id_of = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        self.left = self.end[self.doc] - np.arange(n)  # words from here to the document's end
        self.place = np.arange(n) - self.start[self.doc]

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, the block's distinct keys in order, and the key number of each place."""
        size, covered = window - period + 1, np.zeros(period, bool)
        covered[difference_cover(period)] = True
        at = np.flatnonzero(covered[self.place % period] & (self.left >= size))
        keys, number = np.unique(window_hashes(self.hashes, at, size, 1) & LOW48, return_inverse=True)
        return at, keys, number

    def windows(self, at: np.ndarray, shared: np.ndarray, window: int, period: int) -> np.ndarray:
        """Starts of the windows that contain a shared anchor."""
        n = len(self.hashes)
        edge = np.zeros(n + 1, np.int32)
        hit = at[shared]
        first = np.maximum(hit - (period - 1), self.start[self.doc[hit]])
        np.add.at(edge, first, 1)
        np.add.at(edge, hit + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= window))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Of sorted 48-bit keys; sorted as well."""
    return ((keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def gathered(keys: np.ndarray, shards: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers to a block's keys, in the order of the keys."""
    out = np.zeros(len(keys), bool)
    for s, lo, hi in slices(shard_of(keys, shards), shards):
        out[lo:hi] = bits(answers[s], hi - lo)
    return out


class Windows:
    """The windows of a block that contain shared anchors: distinct ones with their smallest id."""

    def __init__(self, words: Words, shared: dict[int, bytes], shards: int, window: int, period: int):
        at, keys, number = words.anchors(window, period)
        self.at = words.windows(at, gathered(keys, shards, shared)[number], window, period)
        high = window_hashes(words.hashes, self.at, window, 2) & LOW48
        low = window_hashes(words.hashes, self.at, window, 3) & LOW48
        order = np.lexsort((words.id_of[words.doc[self.at]], low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = order[new]
        self.high, self.low, self.least = high[first], low[first], words.id_of[words.doc[self.at[first]]]


REQUEST = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("more", pa.binary())]
)
REQUEST_SQL = "shard int, block long, high binary, low binary, more binary"
ANSWER_SQL = "block long, shard int, payload binary"
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)


def remove_repeats(
    df: DataFrame,
    id_col: str,
    text_col: str,
    window: int = 13,
    period: int = 7,
    block_bytes: int = BLOCK_BYTES,
    texts: bool = False,
) -> DataFrame:
    """Per row of df: doc_id, n_words, n_removed, kept_sha256; with texts also kept (the kept words, space-joined)."""
    blocks, shards = text_blocks(df, id_col, text_col, block_bytes)

    def ask_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(row)
                at, keys, number = words.anchors(window, period)
                ids = words.id_of[words.doc[at]]
                least, most = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
                np.minimum.at(least, number, ids)
                np.maximum.at(most, number, ids)
                several = least < most
                rows = [
                    (s, row["block"], packed(keys[lo:hi], 6), b"", np.packbits(several[lo:hi]).tobytes())
                    for s, lo, hi in slices(shard_of(keys, shards), shards)
                ]
                yield from batched(rows, REQUEST)

    def tell_anchors(requests: pa.Table) -> pa.Table:
        """Which keys are held by several documents."""
        rows = requests.to_pylist()
        keys = [unpacked(r["high"], 6) for r in rows]
        sizes = [len(k) for k in keys]
        flat = np.concatenate(keys)
        several = np.concatenate([bits(r["more"], n) for r, n in zip(rows, sizes, strict=True)])
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        same = np.zeros(len(flat), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        group = np.cumsum(~same) - 1
        hit = np.bincount(group) > 1
        hit |= np.bincount(group, weights=several[order]) > 0
        shared = np.empty(len(flat), bool)
        shared[order] = hit[group]
        return told(rows, sizes, shared)

    def ask_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Windows(Words(row), answer(row["anchors"]), shards, window, period)
                rows = [
                    (s, row["block"], packed(own.high[lo:hi], 6), packed(own.low[lo:hi], 6), planes(own.least[lo:hi], "<i8"))
                    for s, lo, hi in slices(shard_of(own.high, shards), shards)
                ]
                yield from batched(rows, REQUEST)

    def tell_windows(requests: pa.Table) -> pa.Table:
        """Which windows a smaller id holds in another block."""
        rows = requests.to_pylist()
        high, low = [unpacked(r["high"], 6) for r in rows], [unpacked(r["low"], 6) for r in rows]
        least = np.concatenate([unplanes(r["more"], "<i8") for r in rows])
        sizes = [len(k) for k in high]
        high, low = np.concatenate(high), np.concatenate(low)
        order = np.lexsort((least, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        group = np.cumsum(new) - 1
        smaller = np.empty(len(order), bool)
        smaller[order] = least[order] > least[order][new][group]
        return told(rows, sizes, smaller)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(row)
                own = Windows(words, answer(row["anchors"]), shards, window, period)
                elsewhere = gathered(own.high, shards, answer(row["windows"]))
                ids = words.id_of[words.doc[own.at]]
                gone = own.at[elsewhere[own.number] | (own.least[own.number] < ids)]
                edge = np.zeros(len(words.hashes) + 1, np.int32)
                edge[gone] += 1
                np.subtract.at(edge, gone + window, 1)
                removed = np.cumsum(edge[:-1]) > 0
                rows = []
                for i, own_words in enumerate(words.words):
                    out = removed[words.start[i] : words.end[i]]
                    kept = own_words
                    if out.any():
                        kept = [w for w, x in zip(own_words, out.tolist(), strict=True) if not x]
                    body = b" ".join(kept)
                    sha = hashlib.sha256(body).hexdigest()
                    rows.append((words.doc_ids[i], len(out), int(out.sum()), sha, body if texts else None))
                yield from batched(rows, RESULT)

    def exchanged(rows: DataFrame, ask, tell, name: str) -> DataFrame:
        asked = rows.mapInArrow(ask, REQUEST_SQL)
        return durable(asked.groupBy("shard").applyInArrow(tell, ANSWER_SQL), name)

    anchors = exchanged(blocks, ask_anchors, tell_anchors, "anchors")
    windows = exchanged(with_answers(blocks, anchors=anchors), ask_windows, tell_windows, "windows")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    found = with_answers(blocks, anchors=anchors, windows=windows).mapInArrow(clean, schema)
    return found.withColumn("kept", found["kept"].cast("string")) if texts else found.drop("kept")


def told(rows: list[dict], sizes: list[int], verdict: np.ndarray) -> pa.Table:
    """A bit per entry, for every request of the shard."""
    ends = np.cumsum(sizes).tolist()
    payloads = [np.packbits(verdict[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    columns = ([r["block"] for r in rows], [r["shard"] for r in rows], payloads)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ANSWER, strict=True)], schema=ANSWER)
