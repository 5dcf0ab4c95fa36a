"""Secrets, and the parts of credentials that belong together, with Spark's own functions only.

Parts are found by pattern: assigned secrets, access identifiers and long hexadecimal values count by themselves. Weak parts
(a user or client name, a short assigned value, a bare token, an address to log in at) are common in harmless text, and count
only together: an identifier or an address needs a secret, a weak secret needs an identifier or an address, in the same
scope (text between blank lines) and at most `reach` characters away.

Where a part stands follows from the lengths of matches and of the text between them, so of a text only these numbers leave
its row. One exchange brings the parts of a row together, sorted by place; scopes are numbered by a running count of the
breaks, and the interval join is a sweep: each part sees the nearest complementary part before and behind it, found by
running maxima and minima of a window. No pairs are made, and a row of many parts takes time in proportion.

Defined results: a null text is empty; every row has a result of its own, repeated rows and rows without id included; a weak
part that overlaps an earlier part or a base one is left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import narrow

# What counts as a part. The first three are the base patterns; of hex and access the lengths are written out,
# which finds the same values as dropping the shorter ones.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENTIFIER = r"""(?i)(?:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = (
    r"(?i)(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
    r"""|(?i)(?:hostname|host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}"""
)
BREAK = r"\n[\x20\t\r]*\n"
#: In the order in which parts at one place are listed; break is none.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint", "break")
K = {name: i for i, name in enumerate(KINDS)}
BASE, SECRET = ("assign", "access", "hex"), ("assign", "hex", "key")
REACH = 300
FOUND = "array<struct<series:int,n:int,kind:int,before:int,length:int>>"


@dataclass
class Limits:
    """Lengths of values."""

    assigned: int = 8
    weakly_assigned: int = 4
    token: tuple[int, int] = (20, 100)
    hex_token: tuple[int, int] = (16, 31)


def looks_random(token: Column, limits: Limits) -> Column:
    """Mixed letters and digits of a token's length, or a short hexadecimal value."""
    n = F.length(token)
    mixed = token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]") & n.between(*limits.token)
    return mixed | (token.rlike("^[0-9a-f]+$") & token.rlike("[0-9]") & token.rlike("[a-f]") & n.between(*limits.hex_token))


def series(text: Column, name: str, limits: Limits) -> Column:
    """The matches of one pattern in order: an array of (series, n, kind, before, length).

    kind is null for a match that is no part; before counts the characters since the match before.
    """
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "id": IDENTIFIER, "key": TOKEN, "endpoint": ENDPOINT, "break": BREAK}
    pieces = F.split(text, pattern[name], -1)
    whole = F.regexp_extract_all(text, F.lit(pattern[name]), F.lit(0))
    pairs = F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("before"), m.alias("match")))
    if name == "assign":
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
        pairs = F.zip_with(pairs, values, lambda x, v: x.withField("value", F.length(v)))

    def kind(x: Column) -> Column:
        if name == "assign":
            weak = F.when(x["value"] >= limits.weakly_assigned, K["key"])
            return F.when(x["value"] >= limits.assigned, K["assign"]).otherwise(weak)
        return F.when(looks_random(x["match"], limits), K["key"]) if name == "key" else F.lit(K[name])

    def told(x: Column, n: Column) -> Column:
        return F.struct(
            F.lit(K[name]).alias("series"),
            n.alias("n"),
            kind(x).alias("kind"),
            x["before"].alias("before"),
            F.length(x["match"]).alias("length"),
        )

    found = F.transform(F.filter(pairs, lambda x: x["match"].isNotNull()), told)
    return F.when(text.rlike(pattern[name]), found).otherwise(F.array().cast(FOUND))


def parts(df: DataFrame, id_col: str, text_col: str, limits: Limits | None = None) -> DataFrame:
    """seq (a number of the row), doc_id, kind, start, end (in code points, end exclusive) of all parts and breaks.

    A row without any has one line whose kind is null. Lines of a row are in one partition.
    """
    limits = limits or Limits()
    text = F.col("text")
    rows = narrow(df, id_col, text_col)
    # Without an identifier or an address there is no weak part to report.
    partner = text.contains("AKIA") | text.rlike(f"{IDENTIFIER}|{ENDPOINT}")
    base, others = (F.concat(*[series(text, n, limits) for n in KINDS if (n in BASE) == b]) for b in (True, False))
    every = F.concat(base, F.when(partner, others).otherwise(F.array().cast(FOUND)))
    rows = rows.select(F.monotonically_increasing_id().alias("seq"), "doc_id", every.alias("found"))
    lines = rows.select("seq", "doc_id", F.explode_outer("found").alias("m")).select("seq", "doc_id", "m.*").repartition("seq")
    so_far = Window.partitionBy("seq", "series").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(so_far)
    placed = lines.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    return placed.select("seq", "doc_id", "kind", "start", "end")


def is_kind(*names: str) -> Column:
    return F.col("kind").isin(*[K[n] for n in names])


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """parts beside scope, partner (kind, start, end of the nearest complementary part within reach) and reported."""
    order = ("start", "kind", "end")
    text = Window.partitionBy("seq").orderBy(*order)
    before, behind = (text.rowsBetween(Window.unboundedPreceding, -1), text.rowsBetween(1, Window.unboundedFollowing))
    base = is_kind(*BASE)
    scope = F.count(F.when(is_kind("break"), 1)).over(text.rowsBetween(Window.unboundedPreceding, 0))
    covered = F.coalesce(F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(before) > F.col("start"), F.lit(False))
    reached = F.coalesce(F.min(F.when(base, F.col("start"))).over(behind) < F.col("end"), F.lit(False))
    rows = found.withColumn("scope", scope).withColumn("hidden", ~base & (covered | reached))
    # A hidden part takes no part in the sweep.
    rows = rows.withColumn("role", F.when(F.col("hidden") | is_kind("break"), None).otherwise(is_kind(*SECRET)))
    sweep = Window.partitionBy("seq", "scope").orderBy(*order)
    before, behind = (sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(1, Window.unboundedFollowing))
    place = {True: F.struct("end", "start", "kind"), False: F.struct("start", "end", "kind")}

    def nearest(secret: bool) -> Column:
        of = F.col("role") if secret else ~F.col("role")
        last = F.max(F.when(of, place[True])).over(before)
        first = F.min(F.when(of, place[False])).over(behind)
        options = []
        for x, gap in ((last, F.col("start") - last["end"]), (first, first["start"] - F.col("end"))):
            option = F.struct(gap.alias("gap"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
            options.append(F.when(x.isNotNull() & gap.between(0, reach), option))
        return F.least(*options)

    rows = rows.withColumn("secret", nearest(True)).withColumn("other", nearest(False))
    partner = F.when(F.col("role"), F.col("other")).when(~F.col("role"), F.col("secret"))
    rows = rows.withColumn("partner", partner)
    reported = F.col("kind").isNotNull() & (base | (F.col("role").isNotNull() & F.col("partner").isNotNull()))
    return rows.withColumn("reported", F.coalesce(reported, F.lit(False))).drop("hidden", "role", "secret", "other")


def secrets(df: DataFrame, id_col: str, text_col: str, reach: int = REACH, limits: Limits | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans; a span is kind:start:end."""
    rows = linked(parts(df, id_col, text_col, limits), reach)
    span = F.when(F.col("reported"), F.struct("start", "kind", "end"))
    counts = [F.count(F.when(is_kind(n), 1)).alias(f"n_{n}") for n in BASE]
    by_row = rows.groupBy("seq").agg(F.first("doc_id").alias("doc_id"), *counts, F.sort_array(F.collect_list(span)).alias("all"))
    name = F.lit(list(KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")

    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    return by_row.select(
        "doc_id", *[f"n_{n}" for n in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans")
    )
