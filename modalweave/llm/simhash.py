"""SimHash near duplicates with BK-trees in shards.

Fingerprints are computed over whole texts in bounded blocks. Equal fingerprints meet in an aggregate. Two different ones
within `radius` bits agree on at least `pieces` - `radius` of `pieces` bit ranges, so every choice of that many ranges is a
table of shards, and linked fingerprints share a shard of at least one table: none is lost. In a shard a BK-tree is built
(children keyed by the Hamming distance to their parent), every fingerprint follows only the edges within the radius, and
a local union-find reduces the links found to a spanning forest. A shard with more than `shard_size` fingerprints is cut
into parts; the tree of each part is sent to the fingerprints of every part (the pairs of parts are separate tasks), so
memory stays bounded and nothing is capped. More `pieces` make smaller shards and more tables: 5 gives 10 tables of about
2^26 shards.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows without id have a
fingerprint and a null component; rows that share an id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import durable, narrow
from modalweave.llm.components import components

SEED = 42


def fingerprint(text: str, shingle: int = 3, block: int = 1 << 15) -> int:
    """64 bits: a bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    words = text.encode().lower().split()  # of bytes: only A-Z are lowered, only ASCII white space parts
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, size = ends - lengths, min(shingle, len(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        spans = zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own)], schema=schema)

    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Codes by integer Hamming distance: a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        """Place a code; its number is the order of adding."""
        new = len(self.codes)
        self.codes.append(code)
        self.children.append({})
        if new:
            at = 0
            while True:
                gap = (self.codes[at] ^ code).bit_count()
                nearer = self.children[at].get(gap)
                if nearer is None:
                    self.children[at][gap] = new
                    break
                at = nearer
        return new

    def near(self, code: int, radius: int) -> list[int]:
        """Numbers of the codes within the radius, following only edges that can lead to them."""
        found, stack = [], [0] if self.codes else []
        while stack:
            at = stack.pop()
            gap = (self.codes[at] ^ code).bit_count()
            if gap <= radius:
                found.append(at)
            stack += [child for key, child in self.children[at].items() if gap - radius <= key <= gap + radius]
        return found


class Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def shard_links(codes: list[int], own: list[int], left: int, right: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the codes of two parts of a shard (or within one part)."""
    tree, forest, links, number = BKTree(), Forest(len(codes)), [], []
    for i, code in enumerate(codes):
        if own[i] == left and left != right:
            tree.add(code)
            number.append(i)
    for i, code in enumerate(codes):
        if own[i] == right:
            links += [(number[j], i) for j in tree.near(code, radius) if forest.join(number[j], i)]
            if left == right:
                tree.add(code)
                number.append(i)
    return links


def piece_masks(pieces: int, radius: int) -> list[int]:
    """A mask for every choice of pieces - radius of the bit ranges."""
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    ranges = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(pieces)]
    return [sum(chosen) for chosen in combinations(ranges, pieces - radius)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_links(codes: DataFrame, radius: int, pieces: int, shard_size: int) -> DataFrame:
    """codes: fp, node (one row per distinct fp). Links a, b between nodes whose codes are within the radius."""
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in piece_masks(pieces, radius)])
    rows = codes.select("fp", "node", F.posexplode(masks).alias("t", "mask"))
    rows = rows.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"), "fp", "node")
    large = rows.groupBy("t", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_size)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / shard_size).cast("int")
    rows = rows.join(large, ["t", "shard"], "left").withColumn("parts", parts)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "t"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "t", "shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp", "node"
    )
    keys = ["t", "shard", "p", "q"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[tuple]:
            """Columns of complete groups; rows are sorted by group, and a group may go on in the next batch."""
            rest = None
            for batch in batches:
                here = pa.Table.from_batches([batch])
                here = here if rest is None else pa.concat_tables([rest, here])
                columns = [here[k].to_numpy() for k in keys]
                change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [here.num_rows]])
                yield from groups(here.slice(0, int(cuts[-2])), cuts[:-1])
                rest = here.slice(int(cuts[-2]))
            if rest is not None:
                yield from groups(rest, np.array([0, rest.num_rows]))

        def groups(part: pa.Table, cuts: np.ndarray) -> Iterator[tuple]:
            fp, node, own, p, q = (part[c].to_numpy() for c in ("fp", "node", "own", "p", "q"))
            for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
                lo, hi = int(cuts[i]), int(cuts[i + 1])
                yield fp[lo:hi].view(np.uint64).tolist(), own[lo:hi].tolist(), int(p[lo]), int(q[lo]), node[lo:hi]

        a, b = [], []
        for code, own, p, q, node in runs():
            for i, j in shard_links(code, own, p, q, radius):
                a.append(int(node[i]))
                b.append(int(node[j]))
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = 3,
    radius: int = 3,
    pieces: int = 5,
    shard_size: int = 2048,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    found = durable(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    codes = durable(found.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "codes")
    links = near_links(codes, radius, pieces, shard_size)
    # An id with several texts is one document: its fingerprints are linked through it.
    several = found.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    shared = found.join(several.select("doc_id"), "doc_id").join(codes, "fp")
    links = links.unionAll(shared.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    classes = components(links)
    classed = codes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.join(classed, "fp", "left").select(
        "doc_id", hexed.alias("fingerprint"), component.alias("component_id")
    )


def drop_near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of df whose document is the smallest of its component, with all their columns; rows without id stay."""
    classes = near_duplicates(df, id_col, text_col, shingle, radius)
    dropped = classes.where("doc_id > component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return df.join(dropped, df[id_col].cast("long") == F.col("__dropped"), "left_anti")
