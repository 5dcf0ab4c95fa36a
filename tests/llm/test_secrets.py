"""The secret scan against plain Python: every pattern by itself, then all pairs of parts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from modalweave.llm import secrets

NAMES = {"assign": secrets.ASSIGN, "id": secrets.IDENTIFIER, "key": secrets.TOKEN, "endpoint": secrets.ENDPOINT}
BASE = {
    "assign": r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def base_spans(text):
    """As the rule has it: all matches, then those that are long enough."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(BASE["assign"], text, re.I | re.A) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(BASE["access"], text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(BASE["hex"], text) if len(m[0]) >= 32]


def weak_spans(text):
    out = [(m.start(), 4, m.end()) for m in re.finditer(BASE["assign"], text, re.I | re.A) if 4 <= len(m[1]) < 8]
    out += [(m.start(), 3, m.end()) for m in re.finditer(secrets.IDENTIFIER[4:], text, re.I | re.A)]
    for m in re.finditer(secrets.TOKEN, text):
        t = m[0]
        mixed = all(re.search(c, t) for c in ("[0-9]", "[a-z]", "[A-Z]")) and 20 <= len(t) <= 100
        short_hex = re.fullmatch("[0-9a-f]+", t) and re.search("[0-9]", t) and re.search("[a-f]", t) and 16 <= len(t) <= 31
        if mixed or short_hex:
            out.append((m.start(), 4, m.end()))
    return out + [(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT.replace("(?i)", ""), text, re.I | re.A)]


def spans(text, reach):
    base = base_spans(text)
    everything = sorted(base + weak_spans(text))
    breaks = [m.start() for m in re.finditer(secrets.BREAK, text)]
    there = list(base)
    for i, (s, k, e) in enumerate(everything):
        earlier = any(x[2] > s for x in everything[:i])
        later = any(x[0] < e and x[1] < 3 for x in everything[i + 1 :])
        if k > 2 and not earlier and not later:
            there.append((s, k, e))

    def scope(p):
        return sum(b <= p[0] for b in breaks)

    def linked(p):
        other = [q for q in there if (q[1] in (0, 2, 4)) != (p[1] in (0, 2, 4)) and scope(p) == scope(q)]
        return any(0 <= max(q[0] - p[2], p[0] - q[2]) <= reach for q in other)

    return sorted(base + [p for p in there if p[1] > 2 and linked(p)])


def text_of(found):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)


def expected(doc_id, text, reach=secrets.REACH):
    own = spans(text or "", reach)
    base = [p for p in own if p[1] < 3]
    counts = [sum(p[1] == k for p in base) for k in range(3)]
    return doc_id, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(own)


HEX = "0123456789abcdef" * 2
MIXED = "Zx9" + "aB3dE5gH7" * 3
TEXTS = [
    None,
    "",
    "nothing to see",
    f"token = \"{HEX}\" and password=hunter2hunter2 é AKIA{'A1' * 8}",
    "secret: token: abcdefgh12 password: short PASSWORD='a.b=c_d-e+f/g' api_key:12345678 apikey = 1234567",
    f"AKIAAKIA{'Z' * 12} AKIA{'B' * 11} AKIA {HEX}z{HEX[:31]}",
    "user: bob password: abc12 host=db.example.com",  # three weak parts that belong together
    "user: bob and nothing else, host=db.example.com",
    "password: abc12 and nothing else",
    f"user_name = alice\n\npassword: abc12 {MIXED}",  # apart by a blank line
    f"user_name = alice\npassword: abc12\n \t\nclient_id: 778 {MIXED} end",
    f"user=alice {'x ' * 200} {MIXED}",  # too far
    f"https://example.com/{MIXED}/a and {MIXED} near https://h.example.org",
    f"😀😀 login: zoë {'0a1b2c3d' * 3} ü https://é.com postgres://u@h/db password=longenough1",
    "user: " * 50 + "password: abc12 " * 50,
    f"{MIXED}" * 3000,
    (f"user: bob{chr(10)}" + "word " * 900) * 30 + f" password: q1w2 AKIA{'C7' * 9}",
]


@pytest.mark.parametrize("reach", [0, 20, 300])
def test_awkward_texts(spark, reach):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], 1, "x", 2), (None, TEXTS[6], 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq int, kind string, start int").repartition(3)
    got = secrets.secrets(df, "doc_id", "text", reach)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(r[0], r[1], reach) for r in rows), key=repr)


def test_weak_parts_need_their_complement():
    assert text_of(spans(TEXTS[6], 300)) == "id:0:9,key:10:25,endpoint:26:45"
    assert [spans(TEXTS[i], 300) for i in (7, 8, 9)] == [[], [], []]
    assert [p[1] for p in spans(TEXTS[10], 300)] == [3, 4, 3, 4]


def test_partners(spark):
    df = spark.createDataFrame([(1, TEXTS[6])], "doc_id long, text string")
    got = secrets.linked(secrets.parts(df, "doc_id", "text")).orderBy("start").collect()
    kinds = [(secrets.KINDS[r.kind], r.reported, secrets.KINDS[r.partner.kind]) for r in got]
    assert kinds == [("id", True, "key"), ("key", True, "id"), ("endpoint", True, "key")]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = secrets.secrets(df, "doc_id", "text")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [expected(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert secrets.secrets(df.where(F.lit(False)), "doc_id", "text").count() == 0
