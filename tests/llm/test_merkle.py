"""The Merkle manifest against a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from modalweave.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, rank int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def raised(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        pair = level[i & ~1 : (i & ~1) + 2]
        steps.append((i & 1, pair[1 - (i & 1)] if len(pair) == 2 else None))
        i >>= 1
    return steps


def leaf_of(row, more=0):
    values = [row[f] for f in FIELDS]
    if more and values[3] is not None:
        values[3] += more
    texts = [None if v is None else str(v) for v in values]
    return h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def brute_force(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_lang[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = own, raised([leaf_of(r) for r in own])
    top = raised([trees[n][1][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        own, levels = trees[name]
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, k)
            node = leaf_of(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for right, other in steps:
                node = h(node) if other is None else h(other, node) if right else h(node, other)
            proof = h(*[o for _, o in steps if o])
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def proven(df, bits):
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(changed))
    got = merkle.proofs(df, "doc_id", "lang", fields, tampered, bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_proofs_of_awkward_rows(spark, bits):
    rows = [(i, f"text {i}", ["en", "de", "fr"][i % 7 % 3], "s", i, "x", "y", 1) for i in range(45)]
    rows += [
        (1000, None, "en", None, None, "x", "y", 1),
        (1001, "", None, "s", 0, "x", "y", 1),
        (1002, "é" * 40_000, "en", "s", 40_000, "x", "y", 1),
        (3, "text 3", "en", "s", 3, "x", "y", 1),
        (3, "other text", "en", "s", 3, "x", "y", 1),
        (4, "text 4", "zz", "s", 4, "x", "y", 1),
        (4, "text 4", "zz", "s", 4, "x", "y", 1),
        (None, "without id", "en", "s", 1, "x", "y", 1),
        (7, "alone", "é", "s", 1, "x", "y", 1),
        (8, "alone", "", "s", 1, "x", "y", 1),
    ]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    want = brute_force([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r[:5], strict=True)) for r in rows])
    got = proven(df, bits)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_no_rows_and_one_row(spark):
    assert proven(spark.createDataFrame([], COLUMNS), 3) == []
    one = [(1, "a", None, "s", 1, "x", "y", 1)]
    ((_, leaf, subroot, root, proof, folded, verified),) = proven(spark.createDataFrame(one, COLUMNS), 3)
    assert leaf == subroot == root == folded and verified and proof == h()


def postorder(n):
    """Nodes (level, index) of a tree of n leaves as a recursive walk meets them."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    out = []

    def visit(level, index):
        if level:
            for child in (2 * index, 2 * index + 1):
                if child < sizes[level - 1]:
                    visit(level - 1, child)
        out.append((level, index))

    visit(len(sizes) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 21, 64, 100])
def test_positions_are_those_of_a_walk(n):
    assert [merkle.position(level, index, n) for level, index in postorder(n)] == list(range(len(postorder(n))))
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = raised([x.hex() for x in leaves])
    nodes = merkle.append_nodes(leaves, merkle.levels(n))
    for at, (level, index) in enumerate(postorder(n)):
        assert nodes[32 * at : 32 * at + 32].hex() == levels[level][index]


def test_log_of_tiers_is_one_postorder_log(spark):
    rows = [(i, f"t{i}", "en" if i < 37 else None, "s", 1, "x", "y", 1) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    trees, top = merkle.manifest_of(df, "doc_id", "lang", [F.col(c) for c in FIELDS], bits=2)
    assert len(trees.tiers) == 3 and len(top.tiers) == 1
    log = {}
    for r in merkle.node_log(trees).collect():
        assert log.setdefault((r.tree, r.position), (r.level, r.digest)) == (r.level, r.digest)
    for tree, n in (("=en", 37), ("", 3)):
        order = postorder(n)
        own = [log[tree, at] for at in range(len(order))]
        assert [x[0] for x in own] == [level for level, _ in order]
        leaves = [x[1] for x in own if x[0] == 0]
        levels = raised(leaves)
        assert [x[1] for x in own] == [levels[level][index] for level, index in order]
    assert len(log) == len(postorder(37)) + len(postorder(3))
