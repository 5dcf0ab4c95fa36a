"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, kept as a postorder append log.

Rows are ranked within their group by two passes over a range-sorted table (counts of each partition, then offsets). An
aligned builder takes 2^bits consecutive ranks and writes the nodes of their subtree in the order in which they are
completed, that is in postorder; the roots of its segments are the leaves of the next tier, until one segment is left. A
tier holds one row for each segment: the digests of its nodes, 32 bytes each, one after another.

A node's place in a postorder log follows from sizes of subtrees alone (`position`): the leaves before it have completed
2s - popcount(s) nodes, and its own subtree of q leaves has sum(ceil(q / 2^k)) of them, the last of which it is. Proofs are
read off at these places: a segment hands each of its leaves the siblings within the segment and those above it, tier by
tier from the root down, so no row looks for its siblings one by one. `node_log` tells every node with its place in the
whole log of its tree.

H is the lower-case hex SHA-256 of its inputs, one after another, digests as hex text. A leaf is H of the fields of its row,
each `-` if null, else its UTF-8 length, `:`, and the value. Of the nodes of a level every two consecutive ones become their
H; a last one without a neighbour becomes its own H. What is left is the group's root, a lone leaf itself. Groups are
ordered null first, then by the bytes of their names.

Defined results: a null id comes before every id; rows that repeat an id are ordered by their leaves, so whole repeats
have the same leaf and places of their own; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable

#: A segment has 2^BITS leaves.
BITS = 10
#: Sides of a sibling in a path: none (the node was alone), left, right.
ALONE, LEFT, RIGHT = 0, 1, 2
PATH = "tree string, block long, path binary, subroot binary, root binary"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def levels(n: int) -> int:
    """Levels above n leaves."""
    return max(n - 1, 0).bit_length()


def subtree_size(level: int, leaves: int) -> int:
    """Nodes of a subtree whose top lies `level` above its leaves."""
    if leaves == 1 << level:
        return 2 * leaves - 1
    return sum(-(-leaves >> k) for k in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """The place, from 0, of a node in the postorder log of a tree of so many leaves."""
    before = index << level
    return 2 * before - before.bit_count() + subtree_size(level, min(leaves - before, 1 << level)) - 1


def append_nodes(leaves: list[bytes], height: int) -> bytes:
    """The digests of a segment in the order of completion. height: of its root; a short segment ends in lone nodes."""
    log: list[bytes] = []
    waiting: list[bytes] = [b""] * (height + 1)  # of each level, the left node that waits for its neighbour
    last = len(leaves) - 1
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        node, at = leaf.hex().encode(), i
        for k in range(height):
            if at & 1:
                node = waiting[k] + node
            elif i != last:
                waiting[k] = node
                break
            digest = sha256(node).digest()
            log.append(digest)
            node, at = digest.hex().encode(), at >> 1
    return b"".join(log)


def siblings(nodes: bytes, leaf: int, leaves: int, height: int) -> Iterator[tuple[int, bytes]]:
    """Side and digest of the siblings of a leaf's path within a segment, from the leaf up."""
    for k in range(height):
        own = leaf >> k
        other = own ^ 1
        if other << k >= leaves:
            yield ALONE, b""
            continue
        at = 32 * position(k, other, leaves)
        yield (LEFT if own & 1 else RIGHT), nodes[at : at + 32]


def to_path(steps: Iterable[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + digest for side, digest in steps)


def from_path(path: bytes) -> list[tuple[int, bytes]]:
    """Steps with the sibling as hex text."""
    steps, at = [], 0
    while at < len(path):
        side = path[at]
        end = at + 1 + (0 if side == ALONE else 32)
        steps.append((side, path[at + 1 : end].hex().encode()))
        at = end
    return steps


def fold(leaf: bytes, steps: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to; all as hex text."""
    for side, other in steps:
        leaf = sha256(other + leaf if side == LEFT else leaf + other).hexdigest().encode()
    return leaf


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, in binary."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with `tree`) beside rank, from 0 in their tree, and size, the rows of the tree. No tree is gathered in a task.

    rows must be a written table, so that a repeated task meets the same rows.
    """
    keys = ["tree", *order, "tie"]
    ordered = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows need not share a partition
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ordered = durable(ordered.withColumn("seq", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("seq", 33).alias("part")
    runs = ordered.groupBy("tree", part).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    runs = runs.select("tree", "part", before.alias("before"), F.sum("n").over(tree).alias("size"))
    found = ordered.withColumn("part", part).join(runs, ["tree", "part"])
    return found.withColumn("rank", F.col("before") + F.col("seq")).drop("part", "before", "seq")


def blocks(rows: DataFrame, items: list[str], bits: int) -> DataFrame:
    """One row for each 2^bits ranks of a tree: tree, block, n (leaves of the tree in this tier), size, items in order."""
    item = F.struct("rank", *items)
    by_block = rows.groupBy("tree", F.shiftright("rank", bits).alias("block"))
    return by_block.agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(item)).alias("items"))


def height_of(n: int, bits: int) -> int:
    return levels(n) if n <= 1 << bits else bits


def segments(rows: DataFrame, bits: int) -> DataFrame:
    """blocks beside nodes, the digests of the segment's nodes in postorder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            for r, n in enumerate(batch.column("n").to_pylist()):
                leaves = items.slice(r, 1).flatten().field("digest").to_pylist()
                nodes = pa.array([append_nodes(leaves, height_of(n, bits))], pa.binary())
                one = batch.slice(r, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, nodes], [*one.schema.names, "nodes"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, nodes binary")


@dataclass
class Manifest:
    """The trees of a table: tiers of segments, and (tree, tier, digest) of the roots."""

    tiers: list[DataFrame]
    roots: DataFrame
    bits: int


def build(rows: DataFrame, items: list[str], bits: int) -> Manifest:
    """rows: tree, rank, size, digest and further items."""
    tiers: list[DataFrame] = []
    rows, names = rows.withColumn("n", F.col("size")), ["digest", *items]
    while True:
        tiers.append(durable(segments(blocks(rows, names, bits), bits), "segments"))
        more = tiers[-1].where(F.col("n") > 1 << bits)
        if more.isEmpty():
            break
        up = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
        root = F.substring("nodes", -32, 32)
        rows, names = more.select("tree", F.col("block").alias("rank"), "size", up.alias("n"), root.alias("digest")), ["digest"]
    roots = None
    for k, tier in enumerate(tiers):
        ends = tier.where(F.col("n") <= 1 << bits)
        ends = ends.select("tree", F.lit(k).alias("tier"), F.substring("nodes", -32, 32).alias("digest"))
        roots = ends if roots is None else roots.unionByName(ends)
    return Manifest(tiers, roots, bits)


def handed_down(segments_above: DataFrame, bits: int) -> DataFrame:
    """For each leaf of the segments: its path, its own siblings before those of the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["tree", "block", "n", "nodes", "path", "subroot", "root"]).to_pylist():
                first = r["block"] << bits
                m = min(r["n"] - first, 1 << bits)
                own = [to_path(siblings(r["nodes"], i, m, height_of(r["n"], bits))) + r["path"] for i in range(m)]
                columns = {"tree": [r["tree"]] * m, "block": list(range(first, first + m)), "path": own}
                yield pa.RecordBatch.from_pydict(
                    columns | {"subroot": [r["subroot"]] * m, "root": [r["root"]] * m},
                    pa.schema([(n, pa.string() if n == "tree" else pa.int64() if n == "block" else pa.binary()) for n in
                               ("tree", "block", "path", "subroot", "root")]),
                )

    return segments_above.mapInArrow(run, PATH)


def with_paths(manifest: Manifest, seeds: DataFrame) -> DataFrame:
    """The segments of the lowest tier beside path, subroot and root. seeds: tree, tier, path above the tree, subroot, root."""
    above: DataFrame | None = None
    for k in reversed(range(len(manifest.tiers))):
        own = seeds.where(F.col("tier") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        above = own if above is None else above.unionByName(own)
        found = manifest.tiers[k].join(above, ["tree", "block"])
        if k == 0:
            return found
        above = durable(handed_down(found, manifest.bits), "paths")
    raise AssertionError("a manifest has a tier")


def prove(manifest: Manifest, top: Manifest) -> DataFrame:
    """Every row of the table with its proof, folded from the changed leaf where there is one. top: the tree over the roots."""
    empty = F.lit(b"")
    total = top.roots.select("tier", F.lit("").alias("tree"), empty.alias("path"), "digest", F.col("digest").alias("root"))
    over = with_paths(top, total.withColumnRenamed("digest", "subroot"))
    bits, top_bits = manifest.bits, top.bits

    def leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The path above each group's root."""
        for batch in batches:
            for r in batch.select(["block", "n", "items", "nodes", "path", "root"]).to_pylist():
                m = len(r["items"])
                height = height_of(r["n"], top_bits)
                paths = [to_path(siblings(r["nodes"], i, m, height)) + r["path"] for i in range(m)]
                names = ["tree", "tier", "path", "subroot", "root"]
                items = r["items"]
                columns = [[x["key"] for x in items], [x["tier"] for x in items], paths, [x["digest"] for x in items]]
                types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip([*columns, [r["root"]] * m], types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    seeds = durable(over.mapInArrow(leads, "tree string, tier int, path binary, subroot binary, root binary"), "seeds")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, nodes, path, subroot, root = (batch.column(c)[r].as_py() for c in ("n", "nodes", "path", "subroot", "root"))
                items = batch.column("items").slice(r, 1).flatten()
                leaves, changed = items.field("digest").to_pylist(), items.field("changed").to_pylist()
                m, height, upper = len(leaves), height_of(n, bits), from_path(path)
                above, whole = b"".join(s for _, s in upper), root.hex()
                proofs, folded = [], []
                for i, (leaf, other) in enumerate(zip(leaves, changed, strict=True)):
                    own = [(side, digest.hex().encode()) for side, digest in siblings(nodes, i, m, height)]
                    proofs.append(sha256(b"".join(s for _, s in own) + above).hexdigest())
                    start = (leaf if other is None else other).hex().encode()
                    folded.append(fold(fold(start, own), upper).decode())
                arrays = [items.field("id"), [x.hex() for x in leaves], [subroot.hex()] * m, [whole] * m, proofs, folded]
                columns = [*arrays, [f == whole for f in folded]]
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                names = [c.split()[0] for c in PROVEN.split(", ")]
                made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names)

    return with_paths(manifest, seeds).mapInArrow(run, PROVEN)


def manifest_of(
    df: DataFrame, id_col: str, group_col: str, fields: list[Column], changed: Column | None = None, bits: int = BITS
) -> tuple[Manifest, Manifest]:
    """The trees of the groups and the tree over their roots. changed: a leaf to prove in place of a row's own, where not null."""
    group = F.col(group_col).cast("string")
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        leaf_digest(fields).alias("digest"),
        (F.lit(None) if changed is None else changed).cast("binary").alias("changed"),
    )
    trees = build(ranked(durable(rows, "leaves"), ["id", "digest"]), ["id", "changed"], bits)
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "tier", "digest")
    return trees, build(ranked(durable(subroots, "subroots"), ["key"]), ["key", "tier"], bits)


def proofs(
    df: DataFrame, id_col: str, group_col: str, fields: list[Column], changed: Column | None = None, bits: int = BITS
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return prove(*manifest_of(df, id_col, group_col, fields, changed, bits))


def node_log(manifest: Manifest) -> DataFrame:
    """Every node once: tree (`=` and the group, empty for null), position in the tree's log, level, digest as hex text."""
    bits = manifest.bits

    def told(tier: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.select(["tree", "block", "n", "size", "nodes"]).to_pylist():
                    m, height = min(r["n"] - (r["block"] << bits), 1 << bits), height_of(r["n"], bits)
                    out: list[tuple] = []
                    for k in range(1 if tier else 0, height + 1):  # the leaves of a higher tier are told by the one below
                        for i in range(-(-m >> k)):
                            digest = r["nodes"][32 * (at := position(k, i, m)) : 32 * at + 32].hex()
                            level, index = tier * bits + k, (r["block"] << (bits - k)) + i
                            out.append((r["tree"], position(level, index, r["size"]), level, digest))
                    if out:
                        types = (pa.string(), pa.int64(), pa.int32(), pa.string())
                        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, ["tree", "position", "level", "digest"])

        return run

    parts = [t.mapInArrow(told(k), "tree string, position long, level int, digest string") for k, t in enumerate(manifest.tiers)]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log
