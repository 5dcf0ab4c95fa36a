"""The whole pipeline against plain Python, stage by stage, on one small table with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_operators import COLUMNS, docs, normal, slow_fingerprint  # noqa: F401

from modalweave.llm.tokens import ChunkEncoder


def slow_trigrams(text):
    kept = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in (text or "").lower().encode())
    raw = b" " + kept + b" "
    return Counter(raw[i : i + 3] for i in range(len(raw) - 2) if raw[i : i + 3] != b"   ")


def slow_bucket(gram):
    return int.from_bytes(gram, "big") * 2654435761 % 2**32 >> 16


def slow_languages(rows):
    """(row, language) of the rows that are accepted."""
    clean = [tuple((v or "").strip().lower() or None for v in (r["lang"], r["source"])) for r in rows]
    grams = [Counter() for _ in rows]
    for own, r in zip(grams, rows, strict=True):
        for g, n in slow_trigrams(r["text"]).items():
            own[slow_bucket(g)] += n
    learnt = {(label, r["text"]): own for (label, _), r, own in zip(clean, rows, grams, strict=True) if label}
    languages = sorted({label for label, _ in learnt})
    logs = []
    for language in languages:
        counts = Counter()
        for (label, _), own in learnt.items():
            counts.update(own if label == language else {})
        total = sum(counts.values()) + 0.1 * 65536
        logs.append(lambda b, c=counts, t=total: math.log((c[b] + 0.1) / t))
    logs.append(lambda b: -math.log(65536))
    scores = [[sum(n * log(b) for b, n in own.items()) / 3 for log in logs] for own in grams]

    def softmax(values):
        raised = [math.exp(v - max(values)) for v in values]
        return [x / sum(raised) for x in raised]

    shares = [softmax(s[:-1]) if own else [0.0] * len(languages) for s, own in zip(scores, grams, strict=True)]
    overall = [1 + sum(column) for column in zip(*shares, strict=True)]

    def rest(me, place, i):
        """Rows of language i that share the declaration (0) or the host (1) of a row, without it."""
        same = [k for k, c in enumerate(clean) if c[place] is not None and c[place] == clean[me][place] and k != me]
        return sum(shares[k][i] for k in same)

    out = []
    for me, (own, score) in enumerate(zip(grams, scores, strict=True)):
        if not own or max(score[:-1]) <= score[-1]:
            continue
        hosts, declared = ([rest(me, place, i) for i in range(len(languages))] for place in (1, 0))
        fused = []
        for i in range(len(languages)):
            prior = overall[i] / sum(overall)
            log = score[i] + math.log((hosts[i] + 5 * prior) / (sum(hosts) + 5))
            if clean[me][0]:
                share = (sum(declared) + 1) / (sum(overall) + 1)
                log += math.log((declared[i] + 5 * share) / (overall[i] + 5))
            fused.append(log)
        out.append({**rows[me], "lang": languages[fused.index(max(fused))]})
    return out


def place(row):
    return math.inf if row["doc_id"] is None else row["doc_id"]


def slow_exact(rows):
    kept = {}
    for r in sorted(rows, key=place):
        kept.setdefault(normal(r["text"] or ""), r)
    return list(kept.values())


def slow_near(rows):
    known = [r for r in rows if r["doc_id"] is not None]
    codes = [slow_fingerprint(r["text"] or "") for r in known]
    label = [r["doc_id"] for r in known]
    for _ in known:
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= 3 or known[i]["doc_id"] == known[j]["doc_id"]:
                    label[i] = label[j] = min(label[i], label[j])
    return [r for r, low in zip(known, label, strict=True) if low == r["doc_id"]] + [r for r in rows if r["doc_id"] is None]


def slow_mix(rows, fraction=0.7):
    def topic(text):
        for pattern, name in ((r"[%#*$&]{3}", "marked"), (r" \| ", "table"), (r"[0-9]{6}", "numeric")):
            if re.search(pattern, text):
                return name
        return "prose"

    keys = [(r["source"] or "(none)", r["lang"] or "(none)", topic(r["text"] or "")) for r in rows]
    cells = Counter()
    for key, r in zip(keys, rows, strict=True):
        cells[key] += len((r["text"] or "").encode().split())
    total = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    targets = []
    for d in range(3):
        present = Counter()
        for key, n in cells.items():
            present[key[d]] += n
        lifted = {k: n**0.7 for k, n in present.items() if n}
        targets.append({k: v / sum(lifted.values()) for k, v in lifted.items()})
    for _ in range(500):
        for d, target in enumerate(targets):
            mass = defaultdict(float)
            for key, n in cells.items():
                mass[key[d]] += n * weight[key] / total
            for key in cells:
                weight[key] *= target[key[d]] / mass[key[d]] if mass[key[d]] else 1.0
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        expected = sum(n * min(1.0, c * weight[key]) for key, n in cells.items())
        low, high = (c, high) if expected < fraction * total else (low, c)
    out = []
    for key, r in zip(keys, rows, strict=True):
        digits = hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest()[:12]
        out += [r] if int(digits, 16) / 16**12 < min(1.0, low * weight[key]) else []
    return out


def test_run(spark, docs, tmp_path):  # noqa: F811
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    sizes = [len(rows)]
    for stage in (slow_languages, slow_exact, slow_near, slow_mix):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > sizes[4]  # every stage had something to do
    encoder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    want = []
    for r in rows:
        ids = np.array([*encoder.plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= math.ceil(sum(w[3] for w in want) / 2048) * 1.02 + 1


def test_stages_keep_the_columns(spark, docs, tmp_path):  # noqa: F811
    """All stages but the last return the columns of documents, clashing ones included, also of an empty table."""
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).dtypes == docs.dtypes
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
