"""op11 as DuckDB SQL: levels by recursion, then every row's path by recursion over them."""


def crc32(text: str) -> str:
    """DuckDB has no such function, so it is computed bit by bit. text: ASCII."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def digest(fields: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


LEAF = digest(["doc_id", "source", "lang", "n_chars", "text"])
TAMPERED = digest(["doc_id", "source", "lang", "(n_chars + 1)", "text"])


def walk(name: str, levels: str, start: str) -> str:
    """A path from its leaf to the root of its tree: r, tree, level, idx, n, h (as folded so far), proof."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT p.r, p.tree, p.level + 1, p.idx // 2, (p.n + 1) // 2,
    sha256(CASE WHEN p.idx % 2 = 1 THEN s.h || p.h ELSE p.h || coalesce(s.h, '') END), p.proof || coalesce(s.h, '')
  FROM {name} p LEFT JOIN {levels} s ON s.tree = p.tree AND s.level = p.level AND s.idx = xor(p.idx, 1) WHERE p.n > 1
)"""


def raised(name: str, start: str) -> str:
    """All nodes of trees, level by level: tree, level, idx, n (nodes of the level), h."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 2, n
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY tree) AS size
  FROM (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {LEAF} AS leaf,
      CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {TAMPERED} ELSE {LEAF} END AS given
    FROM documents
  )
), {raised("lv", "SELECT tree, 0 AS level, rank AS idx, size AS n, leaf AS h FROM leaves")},
subroots AS MATERIALIZED (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS size FROM lv WHERE n = 1
), {raised("top", "SELECT 'all' AS tree, 0 AS level, rank AS idx, size AS n, subroot AS h FROM subroots")},
{walk("own", "lv", "SELECT r, tree, 0 AS level, rank AS idx, size AS n, given AS h, '' AS proof FROM leaves")},
{walk("over", "top", "SELECT own.r, 'all' AS tree, 0 AS level, s.rank AS idx, s.size AS n, own.h, own.proof FROM own JOIN subroots s USING (tree) WHERE own.n = 1")}
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN over o USING (r), top t WHERE o.n = 1 AND t.n = 1
"""
