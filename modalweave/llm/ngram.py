"""Language-model scoring with an Elias-Fano trie of n-grams up to any order, in shards.

Model: p(w | context) = (c(context w) + STRENGTH x p(w | context without its first word)) / (c(context) + STRENGTH), and without
context base(w) = (c(w) + 1) / (N + V + 1); it sums to one over the V known tokens and the unknown one. A text is its words,
lower-cased, and an end token; the first word follows a start token, before which there is nothing, so the contexts of a
text's first words are shorter. Counts come from all training documents.

1. Documents are kept in blocks, as numbers of a block's distinct tokens. Every block sends each distinct token with its
   training count; shards of the token space add the counts and answer with the sums. N and V are sums over the shards.
2. Level by level, pairs first: every block sends its distinct n-grams, grouped by context, a node of the level below. A shard
   adds the counts and builds its part of the level: the sorted contexts, monotone pointers to their ranges, and the successors
   as one monotone sequence of (context, token) numbers, all three Elias-Fano coded, beside the quantised log10 of
   c(context w) / (c(context) + STRENGTH). It maps the level from a file and looks up the n-grams it was asked for: the
   context by successor search, the token by successor search within the context's range. The counts that go back with the
   answers are those of the next level's contexts. Contexts with very many tokens are divided over shards by token, so none
   grows with the most frequent word. From triples on a level is exchanged in turns, each with shards of its own.
3. The answers of all levels go back to the blocks, where texts are scored.

A shard of a level is one buffer; `Trie` reads it from bytes or maps it from a file.
Tokens are known by 64-bit hashes of their bytes, nodes by 64-bit hashes of context and token, the successors of one context
by 40 bits of them.

Defined results: null text is empty and has the end token alone; a null id is held out by the remainder of the empty text;
repeated rows are scored and learnt each; an empty table gives no rows; without training documents base is 1 / 1.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import bucketed, durable
from modalweave.llm.exchange import (
    BLOCK_BYTES,
    BUCKETS,
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
from modalweave.llm.tokens import give_back

#: Weight of the base distribution, in tokens.
STRENGTH = 20.0
#: Steps of the quantised log10 probabilities: 16 bits over ten powers of ten, an error of at most 0.0001.
STEP = 10 / 65534
#: Tokens of a context that one shard takes.
CONTEXT_TOKENS = 4_000_000
#: N-grams that a shard looks up at once.
LOOKED_UP = 1 << 18
#: No word holds a space.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))
LOW40 = np.uint64((1 << 40) - 1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of every given one among them."""
    order = None if np.all(values[1:] >= values[:-1]) else np.argsort(values)
    values = values if order is None else values[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    place = np.cumsum(new, dtype=np.int32) - np.int32(1)
    if order is not None:
        given = np.empty_like(place)
        given[order] = place
        place = given
    return values[new], place


def low_bits(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of every value, packed."""
    if not width or not len(values):
        return b""
    out = []
    for lo in range(0, len(values), 1 << 16):
        part = values[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        raw = np.unpackbits(part, axis=1, bitorder="little")
        out.append(np.packbits(raw[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


class EliasFano:
    """A monotone sequence: the high parts as a bit vector of unary gaps, the low parts packed."""

    HEADER = struct.Struct("<QBQQ")

    def __init__(self, buffer: memoryview):
        self.n, self.width, n_high, n_low = self.HEADER.unpack_from(buffer)
        at = self.HEADER.size
        high = np.frombuffer(buffer, np.uint8, n_high, at)
        self.low = np.frombuffer(buffer, np.uint8, n_low, at + n_high)
        self.size = at + n_high + n_low
        self.words = np.ndarray((max(0, n_low - 7),), "<u8", buffer, at + n_high, (1,))
        # Where the ones are gives the high part of every element.
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[: self.n]
        self.high = (ones - np.arange(self.n)).astype(np.uint64)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64)
        vector = np.zeros(int(high[-1]) + n + 1 if n else 0, np.uint8)
        vector[high + np.arange(n)] = 1
        vector = np.packbits(vector, bitorder="little").tobytes()
        low = low_bits(values, width) + b"\0" * 8 if n else b""
        return cls.HEADER.pack(n, width, len(vector), len(low)) + vector + low

    def get(self, at: np.ndarray) -> np.ndarray:
        """The elements at the given places."""
        value = self.high[at] << np.uint64(self.width)
        if self.width:
            bit = at.astype(np.int64) * self.width
            word = self.words[bit >> 3]  # eight bytes hold up to 57 bits from any place on; a ninth holds the rest
            shift = (bit % 8).astype(np.uint64)
            word = word >> shift
            if self.width > 57:
                ninth = np.minimum(bit // 8 + 8, len(self.low) - 1)
                more = self.low[ninth].astype(np.uint64)
                word |= np.where(shift > 0, more << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            value |= word & np.uint64((1 << self.width) - 1)
        return value

    def successor(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """First place in [lo, hi) whose element is not below the value (hi if there is none), for all values at once."""
        values = np.asarray(values, np.uint64)
        hi = self.n if hi is None else hi
        part = values >> np.uint64(self.width)
        # The high part leaves a few elements, a search over their low parts decides.
        left = np.clip(np.searchsorted(self.high, part, "left"), lo, hi)
        right = np.clip(np.searchsorted(self.high, part, "right"), lo, hi)
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                return left
            middle = (left[open_] + right[open_]) // 2
            below = self.get(middle) < values[open_]
            left[open_[below]] = middle[below] + 1
            right[open_[~below]] = middle[~below]


    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where the sequence doesn't hold it; repeated values are searched once."""
        values, number = distinct(values)
        place = self.successor(values)
        inside = np.minimum(place, self.n - 1)
        return np.where(self.get(inside) == values, inside, -1)[number]


def more_shards(level: int) -> int:
    """How often the shards of the text a level has: n-grams take more room than tokens."""
    return max(2, turns_of(level))


def turns_of(level: int) -> int:
    """Nearly every triple of words is a new one. Longer n-grams are exchanged in turns, each with its own shards, so no more
    requests lie on disk at once than those of the pairs."""
    return min(level - 1, 4)


class Trie:
    """A shard of the trie over one buffer: contexts, pointers, successors, quantised probabilities."""

    def __init__(self, buffer: bytes | memoryview):
        view = memoryview(buffer)
        levels = []
        for _ in range(4):
            level = EliasFano(view)
            levels.append(level)
            view = view[level.size :]
        self.contexts, self.tokens, self.pointers, self.successors = levels
        self.codes = np.frombuffer(view, "<u2", self.successors.n)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Map a file; pages are read as searches touch them."""
        return cls(np.memmap(path, np.uint8, "r").data)

    @classmethod
    def build(cls, contexts: np.ndarray, tokens: np.ndarray, probabilities: np.ndarray) -> bytes:
        """From distinct pairs sorted by context, then token."""
        first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])[: len(contexts)])
        own, (known, number) = contexts[first], distinct(tokens)
        pointers = np.append(first, len(contexts))
        context = np.repeat(np.arange(len(own)), np.diff(pointers))
        monotone = context.astype(np.uint64) * np.uint64(max(1, len(known))) + number.astype(np.uint64)
        parts = [EliasFano.encode(x) for x in (own, known, pointers, monotone)]
        return b"".join(parts) + quantised(probabilities).astype("<u2").tobytes()

    def look_up(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Quantised probability of each pair; 0 where the trie doesn't hold it."""
        out = np.zeros(len(contexts), np.uint16)
        if not self.successors.n:
            return out
        c, t = self.contexts.find(contexts), self.tokens.find(tokens)
        at = np.flatnonzero((c >= 0) & (t >= 0))
        c, t = c[at], t[at]
        wanted = c.astype(np.uint64) * np.uint64(max(1, self.tokens.n)) + t.astype(np.uint64)
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        place = self.successors.successor(wanted, lo, hi)
        inside = place < hi
        at, place, wanted = at[inside], place[inside], wanted[inside]
        found = self.successors.get(place) == wanted
        out[at[found]] = self.codes[place[found]]
        return out


def quantised(probabilities: np.ndarray) -> np.ndarray:
    """1 to 65535 for log10 from -10 to 0; 0 stands for none."""
    logs = np.log10(np.maximum(probabilities, 1e-10))
    return np.rint((logs + 10) / STEP).astype(np.uint16) + np.uint16(1)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) * STEP - 10), 0.0)


TOKENS = pa.schema([("lengths", pa.binary()), ("keys", pa.binary()), ("numbers", pa.binary())])


def hashed(texts: list[str]) -> tuple[bytes, bytes, bytes]:
    """The texts' numbers of tokens, their distinct tokens in order, and the place of every token among these."""
    words: dict[bytes, int] = defaultdict()
    words.default_factory = words.__len__  # a new word gets the next number
    own = [np.array([*map(words.__getitem__, t.encode().lower().split()), -1], np.int32) for t in texts]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    keys, place = distinct(np.append(hashes, END))
    lengths = np.array([len(x) for x in own], np.int64)
    return planes(lengths, "<u4"), keys.astype("<u8").tobytes(), planes(place[np.concatenate(own)], "<u4")


class Tokens:
    """The tokens of a block's documents, numbered by the block's distinct ones."""

    def __init__(self, row: dict, held_out: int, folds: int):
        self.doc_ids = row["doc_ids"]
        self.lengths = unplanes(row["lengths"], "<u4").astype(np.int64)
        self.last = np.cumsum(self.lengths) - 1
        fold = [zlib.crc32(b"" if i is None else str(i).encode()) % folds for i in self.doc_ids]
        self.held_out = np.array(fold) == held_out
        self.learnt = np.repeat(~self.held_out, self.lengths)
        # The start token is the last number, so that it can be a context.
        self.keys, self.number = np.frombuffer(row["keys"], "<u8"), unplanes(row["numbers"], "<u4").view(np.int32)
        self.before = np.empty(len(self.number), np.int32)
        self.before[1:] = self.number[:-1]
        self.before[self.last - self.lengths + 1] = len(self.keys)

    def after(self, number: np.ndarray) -> np.ndarray:
        """At every token what ``number`` says of the one before it in its text; -1 at a text's first token."""
        out = np.empty(len(number), np.int32)
        out[1:] = number[:-1]
        out[self.last - self.lengths + 1] = -1
        return out


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(27))


def token_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Of sorted keys; sorted as well."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Grams:
    """A block's distinct n-grams of one length in the order they are sent: by shard, context, token.

    ``node`` is the number of the context of every token (-1 where the text has none of this length), ``nodes`` and ``sums``
    are the contexts' keys and training counts. ``number`` is the n-gram every token ends, -1 for one whose context was
    never learnt: nothing is below it in the trie. ``learnt`` counts the n-grams in the block's training documents. Where one
    of several turns is wanted, n-grams of other turns' shards may be left out.
    """

    def __init__(
        self, tokens: Tokens, node: np.ndarray, nodes: np.ndarray, sums: np.ndarray, shards: int, turns: int = 1, turn: int = 0
    ):
        self.tokens, self.node, self.nodes, self.sums, self.shards = tokens, node, nodes, sums, shards
        parts = 1 + sums // CONTEXT_TOKENS
        whole = bool(np.all(parts == 1))
        home = self.sharded(nodes)
        # The last place is that of no context.
        asked = np.append((sums > 0) & (home % turns == turn) if whole else sums > 0, False)
        at = np.flatnonzero(asked[np.where(node < 0, len(nodes), node)])
        width = max(1, len(tokens.keys))
        code, number = distinct(node[at].astype(np.int64) * width + tokens.number[at])
        learnt = np.bincount(number[tokens.learnt[at]], minlength=len(code)).astype(np.uint32)
        context = (code // width).astype(np.int32)
        token = (code - context.astype(np.int64) * width).astype(np.int32)
        del code
        if whole:
            shard = home[context]
        else:
            part = (tokens.keys >> np.uint64(40))[token] % parts.astype(np.uint64)[context]
            shard = self.sharded(nodes[context] + part)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.shard, self.context, self.token, self.learnt = shard[order], context[order], token[order], learnt[order]
        self.number = np.full(len(node), -1, np.int32)
        self.number[at] = place[number]

    def sharded(self, keys: np.ndarray) -> np.ndarray:
        """Short numbers are sorted faster."""
        return (mixed(keys) % np.uint64(self.shards)).astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)

    def keys(self) -> np.ndarray:
        """Of the n-grams as nodes of the trie."""
        return mixed(self.nodes[self.context] * np.uint64(0x9E3779B97F4A7C15) + self.tokens.keys[self.token])


COUNTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
PAIRS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("contexts", pa.binary()),
        ("sums", pa.binary()),
        ("lengths", pa.binary()),
        ("followers", pa.binary()),
        ("counts", pa.binary()),
    ]
)
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
SUMS = pa.schema([*ANSWER, ("tokens", pa.int64()), ("known", pa.int64())])
ANSWER_SQL = "block long, shard int, payload binary"
SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def free() -> None:
    """Hand back what a block or shard took: freed arrays would stay with the worker, in every worker at once."""
    pa.default_memory_pool().release_unused()
    give_back()


def told(columns: tuple, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ends(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = 0
    for n in sizes:
        yield at, at + n
        at += n


def score(
    df: DataFrame,
    id_col: str,
    text_col: str,
    folds: int = 7,
    held_out: int = 2,
    strength: float = STRENGTH,
    block_bytes: int = BLOCK_BYTES,
    keep_trie: str | None = None,
    order: int = 2,
) -> DataFrame:
    """Per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    order: length of the longest n-grams, 2 or more; each has an exchange of its own.

    keep_trie: a path for the model, a table with the trie of every level and shard; without it the tries live in their tasks.

    A document is held out if crc32 of its id as text leaves the remainder `held_out` modulo `folds`.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    blocks, shards = text_blocks(df, id_col, text_col, block_bytes, form=hashed, columns=TOKENS)

    def each(of_row: Callable[[dict], Iterable[pa.RecordBatch]], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block at a time; what one took is free before the next is read."""
        for batch in batches:
            for at in range(batch.num_rows):
                yield from of_row(batch.slice(at, 1).to_pylist()[0])
                free()

    def ask_counts(row: dict) -> Iterator[pa.RecordBatch]:
        own = Tokens(row, held_out, folds)
        counts = np.bincount(own.number[own.learnt], minlength=len(own.keys))
        rows = [
            (s, row["block"], own.keys[lo:hi].tobytes(), planes(counts[lo:hi], "<u4"))
            for s, lo, hi in slices(token_shard(own.keys, shards), shards)
        ]
        yield from batched(rows, COUNTS)

    def tell_counts(requests: pa.Table) -> pa.Table:
        """Sums for every block; the first row also has N and V of the shard."""
        rows = requests.to_pylist()
        keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
        known, number = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unplanes(r["counts"], "<u4") for r in rows]).astype(np.int64)
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, number, counts)
        payloads = [planes(sums[number[lo:hi]], "<i8") for lo, hi in ends([len(k) for k in keys])]
        rest = [None] * (len(rows) - 1)
        columns = ([r["block"] for r in rows], [r["shard"] for r in rows], payloads)
        return told((*columns, [int(sums.sum()), *rest], [int((sums > 0).sum()), *rest]), SUMS)

    def counts_of(own: Tokens, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(own.keys), np.int64)
        for s, lo, hi in slices(token_shard(own.keys, shards), shards):
            out[lo:hi] = unplanes(answers[s], "<i8")
        return out

    def replies(grams: Grams, found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Quantised probability and training count of each n-gram; without counts at the last level."""
        codes, seen = np.zeros(len(grams.shard), np.uint16), np.zeros(len(grams.shard), np.int64)
        for s, lo, hi in slices(grams.shard, grams.shards):
            raw, cut = found.pop(s), 2 * (hi - lo)
            codes[lo:hi] = unplanes(raw[:cut], "<u2")
            if len(raw) > cut:
                seen[lo:hi] = unplanes(raw[cut:], "<i8")
        return codes, seen

    def levels(own: Tokens, row: dict, counts: np.ndarray, last: int, turn: int | None = None) -> Iterator[tuple]:
        """The n-grams of 2 to ``last`` tokens, with the probabilities of those already answered; of the last those of a turn."""
        # As many start tokens are learnt as end tokens.
        keys, sums = np.append(own.keys, START), np.append(counts, counts[np.searchsorted(own.keys, END)])
        node = own.before
        for level in range(2, last + 1):
            turns = turns_of(level)
            wanted = (turns, turn) if level == last and turn is not None else ()
            grams, codes, seen = Grams(own, node, keys, sums, shards * more_shards(level), *wanted), None, None
            if f"level_{level}_0" in row:
                found = [answer(row.pop(f"level_{level}_{t}")) for t in range(turns)]
                codes, seen = replies(grams, {s: raw for part in found for s, raw in part.items()})
                del found
            yield grams, codes
            if level < last:
                keys, sums, node = grams.keys(), seen, own.after(grams.number)
                del grams, codes

    def ask_grams(level: int, turn: int, row: dict) -> Iterator[pa.RecordBatch]:
        own = Tokens(row, held_out, folds)
        for grams, _ in levels(own, row, counts_of(own, answer(row.pop("counts"))), level, turn):
            pass
        rows = []
        for s, lo, hi in slices(grams.shard, grams.shards):
            if s % turns_of(level) != turn:
                continue
            context = grams.context[lo:hi]
            first = np.flatnonzero(np.diff(context, prepend=-1))
            rows.append(
                (
                    s,
                    row["block"],
                    grams.nodes[context[first]].astype("<u8").tobytes(),
                    planes(grams.sums[context[first]], "<i8"),
                    planes(np.diff(np.append(first, hi - lo)), "<u4"),
                    packed(own.keys[grams.token[lo:hi]], 5),
                    planes(grams.learnt[lo:hi], "<u4"),
                )
            )
        yield from batched(rows, PAIRS)

    def tell_grams(level: int, requests: pa.Table) -> pa.Table:
        """The shard of the level (the row of a negative block), and for every block quantised probabilities and, but for the
        last level, counts."""
        listed = {c: requests[c].to_pylist() for c in requests.column_names}
        lengths = np.concatenate([unplanes(raw, "<u4") for raw in listed.pop("lengths")])
        contexts = np.concatenate([np.frombuffer(raw, "<u8") for raw in listed.pop("contexts")])
        contexts, number = distinct(contexts)
        sums = np.zeros(len(contexts), np.int64)
        sums[number] = np.concatenate([unplanes(raw, "<i8") for raw in listed.pop("sums")])
        cuts = list(ends([len(raw) // 5 for raw in listed["followers"]]))
        code = np.repeat(number.astype(np.uint64) << np.uint64(40), lengths)
        for (lo, hi), raw in zip(cuts, listed.pop("followers"), strict=True):
            code[lo:hi] |= unpacked(raw, 5)
        del number, lengths
        code, pair = distinct(code)
        counts = np.bincount(pair, np.concatenate([unplanes(raw, "<u4") for raw in listed.pop("counts")]), len(code))
        counts = counts.astype(np.int64)
        context, token, seen = (code >> np.uint64(40)).astype(np.int32), code & LOW40, counts > 0
        del code
        known = context[seen]
        trie = Trie.build(contexts[known], token[seen], counts[seen] / (sums[known] + strength))
        del known, seen
        codes = np.empty(len(token), np.uint16)
        with tempfile.NamedTemporaryFile(prefix="trie-") as file:
            file.write(trie)
            file.flush()
            opened = Trie.open(file.name)
            for lo in range(0, len(token), LOOKED_UP):
                part = slice(lo, lo + LOOKED_UP)
                codes[part] = opened.look_up(contexts[context[part]], token[part])
            del opened, context, token
        payloads = [planes(codes[pair[lo:hi]], "<u2") for lo, hi in cuts]
        if level < order:
            payloads = [raw + planes(counts[pair[lo:hi]], "<i8") for raw, (lo, hi) in zip(payloads, cuts, strict=True)]
        blocks, shard = listed["block"], listed["shard"]
        if keep_trie:
            blocks, shard, payloads = [*blocks, -1 - shard[0]], [*shard, shard[0]], [*payloads, trie]
        return told((blocks, shard, payloads), ANSWER)

    def telling(level: int) -> Callable[[pa.Table], pa.Table]:
        def tell(requests: pa.Table) -> pa.Table:
            try:
                return tell_grams(level, requests)
            finally:
                free()

        return tell

    asked = blocks.mapInArrow(partial(each, ask_counts), "shard int, block long, keys binary, counts binary")
    told_back = asked.groupBy("shard").applyInArrow(tell_counts, ANSWER_SQL + ", tokens long, known long")
    # Answers that several steps read lie in the blocks' buckets.
    buckets = min(shards, BUCKETS)
    counts = bucketed(told_back, "block", buckets, "counts")
    totals = counts.agg(F.sum("tokens"), F.sum("known")).first()
    train_tokens, vocabulary = int(totals[0] or 0), int(totals[1] or 0)
    columns = "shard int, block long, contexts binary, sums binary, lengths binary, followers binary, counts binary"
    known: dict[str, DataFrame] = {"counts": counts}
    for level in range(2, order + 1):
        answers = {}
        for turn in range(turns_of(level)):
            asked = with_answers(blocks, **known).mapInArrow(partial(each, partial(ask_grams, level, turn)), columns)
            told_back = asked.groupBy("shard").applyInArrow(telling(level), ANSWER_SQL)
            name = f"grams_{level}_{turn}"
            found = bucketed(told_back, "block", buckets, name) if level < order else durable(told_back, name)
            if keep_trie:
                tries = found.where("block < 0").select("shard", F.col("payload").alias("trie"))
                tries.write.mode("append" if turn else "error").parquet(f"{keep_trie}/level={level}")
            answers[f"level_{level}_{turn}"] = found.where("block >= 0")
        known.update(answers)

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        own = Tokens(row, held_out, folds)
        counts = counts_of(own, answer(row.pop("counts")))
        base = ((counts + 1) / (train_tokens + vocabulary + 1))[own.number]
        smoothed = base.copy()
        for grams, codes in levels(own, row, counts, order):
            at = np.flatnonzero(grams.number >= 0)
            backoff = strength / (grams.sums[grams.node[at]] + strength)
            smoothed[at] = probability(codes[grams.number[at]]) + backoff * smoothed[at]
            del at, backoff, grams, codes
        known = (counts > 0)[own.number]
        first = own.last - own.lengths + 1
        columns = (
            own.doc_ids,
            own.held_out,
            own.lengths,
            np.add.reduceat(known.astype(np.int64), first),
            np.add.reduceat(np.log10(base), first),
            np.add.reduceat(np.log10(smoothed), first),
        )
        arrays = [pa.array(c, f.type) for c, f in zip(columns, SCORES, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=SCORES)

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = with_answers(blocks, **known).mapInArrow(partial(each, finish), columns)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
