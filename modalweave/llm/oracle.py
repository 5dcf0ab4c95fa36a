"""The registered queries as DuckDB SQL, where SQL can express them."""

from modalweave.llm.merkle_sql import MERKLE
from modalweave.llm.secrets_sql import SECRETS

EXACT = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g USING (content)
"""


NEIGHBOURS = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 10
"""


NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), p AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), best AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN p USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def mixing(documents: str = "documents", fraction: float = 0.7, exponent: float = 0.7, rounds: int = 120) -> str:
    """Raking by recursion, one dimension a step, over as many rounds as converge; then calibration."""
    dimensions = ("source", "lang", "topic")
    parts = [
        rf"""d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '[%#*$&]{{3}}') THEN 'marked'
         WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{{6}}') THEN 'numeric' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM {documents}
)""",
        "s0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
        "total AS (SELECT sum(t) AS n FROM s0)",
    ]
    for d in dimensions:
        parts.append(
            f"""aim_{d} AS MATERIALIZED (
  SELECT {d}, t / sum(t) OVER () AS {d}_target
  FROM (SELECT {d}, pow(sum(t), {exponent}) AS t FROM s0 GROUP BY {d} HAVING sum(t) > 0)
)"""
        )
    masses = " ".join(f"WHEN {i} THEN sum(t * w) OVER (PARTITION BY {d})" for i, d in enumerate(dimensions))
    targets = " ".join(f"WHEN {i} THEN {d}_target" for i, d in enumerate(dimensions))
    parts.append(
        f"""raked AS (
  SELECT 0 AS step, source, lang, topic, t, {", ".join(f"{d}_target" for d in dimensions)}, 1.0::DOUBLE AS w
  FROM s0 {" ".join(f"LEFT JOIN aim_{d} USING ({d})" for d in dimensions)}
  UNION ALL
  SELECT step + 1, source, lang, topic, t, {", ".join(f"{d}_target" for d in dimensions)},
    w * coalesce((CASE step % 3 {targets} END) * (SELECT n FROM total) / (CASE step % 3 {masses} END), 1)
  FROM raked WHERE step < {3 * rounds}
)"""
    )
    parts.append(
        f"""r AS MATERIALIZED (
  SELECT *, coalesce(sum(t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(t * w) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM raked WHERE step = {3 * rounds}
)"""
    )
    # The cells of largest weight are taken whole as long as c x weight exceeds 1; c is set by the first that doesn't.
    parts.append(
        f"""c AS (
  SELECT arg_min(c, before) FILTER (c * w <= 1) AS c
  FROM (SELECT *, ({fraction} * (SELECT n FROM total) - before) / rest AS c FROM r)
)"""
    )
    return (
        "WITH RECURSIVE "
        + ",\n".join(parts)
        + """
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(w, 6) AS weight, round(least(1, w * c), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / pow(16, 12) < least(1, w * c) AS sampled
FROM d JOIN r USING (source, lang, topic), c
"""
    )


ORACLE = {
    "op1_mixing": mixing(),
    "op5_block_neighbours": NEIGHBOURS,
    "op7_exact_dedup": EXACT,
    "op11_merkle_manifest": MERKLE,
    "op12_hard_negatives": NEGATIVES,
    "op13_secret_scan": SECRETS,
}
