"""op13 as DuckDB SQL: places from the lengths of split pieces, then the same sweep by windows."""

from modalweave.llm import secrets as S


def series(name: str, pattern: str, kind: str) -> str:
    """kind: of a match m with the value g, null if it is no part."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT r, doc_id, {S.K[name]} AS series, n, {kind} AS kind, length(piece) AS before, length(m) AS length
  FROM (
    SELECT r, doc_id, unnest(range(len(ms))) AS n, unnest(ms) AS m, unnest(gs) AS g, unnest(pieces[1:len(ms)]) AS piece
    FROM (
      SELECT r, doc_id, string_split_regex(text, {quoted}) AS pieces, regexp_extract_all(text, {quoted}, 0) AS ms,
        regexp_extract_all(text, {quoted}, {1 if name == "assign" else 0}) AS gs
      FROM d WHERE regexp_matches(text, {quoted})
    )
  )"""


LIMITS = S.Limits()
ASSIGNED = f"CASE WHEN length(g) >= {LIMITS.assigned} THEN {S.K['assign']} WHEN length(g) >= {LIMITS.weakly_assigned} THEN {S.K['key']} END"
TOKEN = f"""CASE WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
      AND length(m) BETWEEN {LIMITS.token[0]} AND {LIMITS.token[1]}
    OR regexp_full_match(m, '[0-9a-f]+') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-f]')
      AND length(m) BETWEEN {LIMITS.hex_token[0]} AND {LIMITS.hex_token[1]} THEN {S.K['key']} END"""
PATTERNS = [
    ("assign", S.ASSIGN, ASSIGNED),
    ("access", S.ACCESS, str(S.K["access"])),
    ("hex", S.HEX, str(S.K["hex"])),
    ("id", S.IDENTIFIER, str(S.K["id"])),
    ("key", S.TOKEN, TOKEN),
    ("endpoint", S.ENDPOINT, str(S.K["endpoint"])),
    ("break", S.BREAK, str(S.K["break"])),
]


def listed(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(str(S.K[n]) for n in names) + ")"


def near(role: str) -> str:
    """Whether a part of the role lies within reach, before or behind."""
    return f"""(coalesce(start - max(CASE WHEN {role} THEN stop END) OVER before BETWEEN 0 AND {S.REACH}, false)
    OR coalesce(min(CASE WHEN {role} THEN start END) OVER behind - stop BETWEEN 0 AND {S.REACH}, false))"""


NAMES = "[" + ", ".join(f"'{n}'" for n in S.KINDS) + "]"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
BEHIND = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(series(*p) for p in PATTERNS)}
), placed AS (
  SELECT r, kind, stop - length AS start, stop
  FROM (SELECT *, sum(before + length) OVER (PARTITION BY r, series ORDER BY n) AS stop FROM m) WHERE kind IS NOT NULL
), scoped AS (
  SELECT *, count(*) FILTER (kind = {S.K["break"]}) OVER (PARTITION BY r ORDER BY start, kind, stop ROWS UNBOUNDED PRECEDING) AS scope,
    kind NOT IN {listed(S.BASE)} AND (coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, kind, stop {BEFORE}) > start, false)
      OR coalesce(min(CASE WHEN kind IN {listed(S.BASE)} THEN start END) OVER (PARTITION BY r ORDER BY start, kind, stop {BEHIND}) < stop, false)) AS hidden
  FROM placed
), roles AS (
  SELECT *, CASE WHEN NOT hidden AND kind <> {S.K["break"]} THEN kind IN {listed(S.SECRET)} END AS secret FROM scoped
), seen AS (
  SELECT r, kind, start, stop, kind IN {listed(S.BASE)} OR secret AND {near("NOT secret")} OR NOT secret AND {near("secret")} AS reported
  FROM roles
  WINDOW before AS (PARTITION BY r, scope ORDER BY start, kind, stop {BEFORE}), behind AS (PARTITION BY r, scope ORDER BY start, kind, stop {BEHIND})
), spans AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({NAMES}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
    string_agg({NAMES}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind, stop) AS spans
  FROM seen WHERE reported GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (r)
"""
