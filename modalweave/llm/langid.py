"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of
  - the text's likelihood under a byte-trigram model of the language, over the whole text,
  - the probability that a text of that language declares the language that its markup declares,
  - the probability that a text of that language has that address suffix,
  - a prior of its host, smoothed towards the prior of its domain, which is smoothed towards that of all rows.
The last three come from grouped sums of the text-only posteriors of all rows (one partial sum per task and key before
the shuffle, so a host with a third of all rows is no hot spot); a row's own share is taken out before they are used on it.

The trigram model is fitted on at most `per_language` labelled rows of each declared language (those with the smallest
hashes of their text, copies once), a bound on rows, not on text. It is sent to the tasks in groups of languages, GROUP x
65,536 numbers each. All declared languages are scored, however many; with more than one group a worker reads the groups
one after another for every batch of rows, so its memory doesn't grow with them, while a row carries a number per language.

Defined results: a text without letters, null and empty texts included, has no language ("und") and is not accepted; so is
a text that a uniform choice of trigrams explains better than every language. A null or blank declaration, host or suffix
is no evidence. Repeated rows are independent rows with equal results. An empty table, or one that declares no language,
gives every row "und".
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalweave.llm.common import durable, let, whole_row

BUCKETS = 1 << 16
#: Languages whose tables are fetched, sent and held at a time.
GROUP = 256
#: Neighbouring trigrams share letters, so their evidence counts for a third.
EVIDENCE = 1 / 3
#: Strength of the smoothing of host towards domain, domain towards all, and of declarations and suffixes, in rows.
STRENGTH = 5.0
#: Texts scored together.
SLICE = 256
# Letters keep their bytes, everything else becomes a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def page_text(markup: str | None) -> str:
    """What a reader sees of a page."""
    return html.unescape(HIDDEN.sub(" ", markup or ""))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every trigram of bytes that holds a letter."""
    raw = np.frombuffer(b" " + (text or "").lower().encode().translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages + 1 rows of log probabilities; the last is the uniform model

    def likelihoods(self, text: str | None, block: int = 1 << 18) -> np.ndarray:
        """Number of trigrams, then the scaled log likelihood of each language and of none."""
        codes = trigrams(text)
        out = np.zeros(len(self.table) + 1)
        out[0] = len(codes)
        for lo in range(0, len(codes), block):
            out[1:] += self.table[:, codes[lo : lo + block]].sum(axis=1, dtype=np.float64)
        out[1:] *= EVIDENCE
        return out


def fit(
    df: DataFrame, text: Column, declared: Column, markup: bool, per_language: int, group: int = GROUP
) -> Iterator[Model]:
    """A model for each `group` languages, in order of their names, at least one.

    Trigram counts of a bounded sample, summed by Spark; the driver gets group x buckets sums at a time.
    """
    rows = df.select(text.alias("text"), declared.alias("label")).where("label IS NOT NULL")
    rows = rows.withColumn("order", F.xxhash64("text"))
    # Only hashes are ranked; a language's are first thinned within salts, so that no task gets all of a language.
    ranked = rows.groupBy("label", "order").agg(F.pmod(F.hash("order"), F.lit(64)).alias("salt"))
    for salts in (64, 8, 1):
        rank = F.row_number().over(Window.partitionBy("label", F.pmod("salt", F.lit(salts))).orderBy("order"))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    last = durable(ranked.groupBy("label").agg(F.max("order").alias("last")), "samples")
    rows = rows.join(last, "label").where("order <= last").dropDuplicates(["label", "order"])
    schema = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, body in zip(batch["label"], batch["text"], strict=True):
                codes = trigrams(page_text(body.as_py()) if markup else body.as_py())
                own = sums.setdefault(label.as_py(), np.zeros(BUCKETS, np.int64))
                own += np.bincount(codes, minlength=BUCKETS)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            columns = [pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = rows.select("label", "text").mapInArrow(count, "label string, bucket int, n long")
    counted = durable(counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    languages = sorted(r["label"] for r in counted.select("label").distinct().collect())
    for lo in range(0, max(1, len(languages)), group):
        part = languages[lo : lo + group]
        place = F.array_position(F.lit(part), F.col("label")) if part else F.lit(0)
        own = counted.select((place - 1).cast("int").alias("at"), "bucket", "n").where("at >= 0").toArrow()
        table = np.full((len(part) + 1, BUCKETS), 0.1)
        table[own["at"].to_numpy(), own["bucket"].to_numpy()] += own["n"].to_numpy()
        yield Model(part, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def scores_of(texts: list[str], sent: list[Broadcast]) -> list[np.ndarray]:
    """For each text the number of trigrams, the likelihood of each language of all models, and that of none."""
    if len(sent) == 1:
        return [sent[0].value.likelihoods(t) for t in texts]
    parts = []
    for one in sent:
        # Read for this batch and not kept, so that a worker holds one model.
        model = one.load_from_path(one._path) if getattr(one, "_path", None) else one.value
        parts.append([model.likelihoods(t) for t in texts])
    return [np.concatenate([own[0][:1], *[x[1:-1] for x in own], own[-1][-1:]]) for own in zip(*parts, strict=True)]


def _softmax(logs: Column) -> Column:
    """Of an array of logs."""
    raised = let(logs, lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return let(raised, lambda own: let(_sum(own), lambda total: F.transform(own, lambda x: x / total)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(
    df: DataFrame,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    suffix: Column | None = None,
    markup: bool = False,
    per_language: int = 1000,
    keep: list[str] | None = None,
    group: int = GROUP,
) -> DataFrame:
    """The rows of df as `row`, beside `found`: lang, confidence, text_lang, trigrams, accepted.

    keep: the columns to carry in `row`, all by default. If they are few (without the text), they are written beside the
    likelihoods and each text is read once; otherwise the likelihoods are computed anew rather than the texts moved.
    """
    spark = df.sparkSession
    named = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    clean = {
        k: F.lit(None).cast("string") if c is None else F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
        for k, c in named.items()
    }
    languages, sent = [], []
    for model in fit(df, text.cast("string"), clean["declared"], markup, per_language, group):
        languages += model.languages
        sent.append(spark.sparkContext.broadcast(model))
    k = len(languages)

    @F.arrow_udf("array<double>")
    def likelihoods(bodies: pa.Array) -> pa.Array:
        found = []
        for lo in range(0, len(bodies), SLICE):  # few texts at a time are held as Python strings
            part = bodies.slice(lo, SLICE).to_pylist()
            found += scores_of([page_text(b) if markup else b for b in part], sent)
        return pa.array(found, pa.list_(pa.float64()))

    row = whole_row(df.select(keep)) if keep else whole_row(df)
    rows = df.select(row.alias("row"), text.cast("string").alias("text"), *[c.alias(n) for n, c in clean.items()])
    rows = rows.withColumn("scores", likelihoods("text")).drop("text")
    if keep:
        rows = durable(rows, "likelihoods")
    if not k:
        nothing = F.struct(
            F.lit("und").alias("lang"),
            F.lit(1.0).alias("confidence"),
            F.lit("und").alias("text_lang"),
            F.col("scores")[0].cast("long").alias("trigrams"),
            F.lit(False).alias("accepted"),
        )
        return rows.select("row", nothing.alias("found"))
    rows = rows.withColumn("share", _softmax(F.slice("scores", 2, k)))
    seen = rows.where(F.col("scores")[0] > 0).select("share", *clean)
    seen = seen if keep else durable(seen, "shares")
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(k)]

    def grouped(key: str) -> DataFrame:
        own = seen.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)
        # Written, so that its size is known when the join is planned.
        return durable(own.select(key, F.array(*[f"s{i}" for i in range(k)]).alias(f"{key}_sums")), "sums")

    total = seen.agg(*sums).first()
    overall = [float(x or 0.0) + 1.0 for x in total]  # one row of each language beside what was seen
    prior = [x / sum(overall) for x in overall]
    for key in ("host", "domain", "declared", "suffix"):
        if named[key] is not None:
            rows = rows.join(grouped(key), key, "left")
        else:
            rows = rows.withColumn(f"{key}_sums", F.lit(None).cast("array<double>"))

    def others(key: str) -> Column:
        """Rows of each language with this key, this row left out."""
        nothing = F.array_repeat(F.lit(0.0), k)
        own = F.when(F.col("scores")[0] > 0, F.col("share")).otherwise(nothing)
        sums = F.coalesce(F.col(f"{key}_sums"), nothing)
        return F.zip_with(sums, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(key: str, towards: Column) -> Column:
        def of(seen: Column) -> Column:
            return let(
                _sum(seen), lambda n: F.zip_with(seen, towards, lambda x, p: (x + STRENGTH * p) / (n + STRENGTH))
            )

        return let(others(key), of)

    def told(key: str) -> Column:
        """P(key | language), smoothed towards the key's share of all rows; 1 without a key."""

        def fitted(seen: Column, share: Column) -> Column:
            return F.zip_with(seen, F.lit(overall), lambda x, n: (x + STRENGTH * share) / (n + STRENGTH))

        own = let(others(key), lambda seen: let((_sum(seen) + 1.0) / (sum(overall) + 1.0), lambda s: fitted(seen, s)))
        return F.when(F.col(key).isNull(), F.array_repeat(F.lit(1.0), k)).otherwise(own)

    logs = smoothed("host", smoothed("domain", F.lit(prior)))
    logs = F.zip_with(logs, F.slice("scores", 2, k), lambda p, score: F.log(p) + score)
    for key in ("declared", "suffix"):
        logs = F.zip_with(logs, told(key), lambda log, p: log + F.log(p))
    rows = rows.withColumn("fused", _softmax(logs))
    names = F.lit(languages)
    best = F.array_position("fused", F.array_max("fused")).cast("int")
    by_text = F.array_position("share", F.array_max("share")).cast("int")
    explained = F.array_max(F.slice("scores", 2, k)) > F.col("scores")[k + 1]
    accepted = (F.col("scores")[0] > 0) & explained
    found = F.struct(
        F.when(accepted, F.element_at(names, best)).otherwise("und").alias("lang"),
        F.when(accepted, F.array_max("fused")).otherwise(1.0).alias("confidence"),
        F.when(accepted, F.element_at(names, by_text)).otherwise("und").alias("text_lang"),
        F.col("scores")[0].cast("long").alias("trigrams"),
        accepted.alias("accepted"),
    )
    return rows.select("row", found.alias("found"))


def page_languages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, declared, text_lang, lang, confidence, trigrams, accepted of every page."""
    markup, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    declared = F.regexp_extract(markup, DECLARED, 1)
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    domain, suffix = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.lower(declared).alias("declared"),
        markup.alias("markup"),
        host.alias("host"),
        domain.alias("domain"),
        suffix.alias("suffix"),
    )
    keys = [F.col(c) for c in ("markup", "declared", "host", "domain", "suffix")]
    found = identify(rows, *keys, markup=True, keep=["page_id", "declared"])
    return found.select("row.page_id", "row.declared", "found.*")


def keep_identified(df: DataFrame, text_col: str, lang_col: str, host_col: str) -> DataFrame:
    """The rows whose language is identified, with all their columns; the language column holds the identified one."""
    found = identify(df, F.col(text_col), F.col(lang_col), F.col(host_col))
    value = {c: F.col("found.lang") if c == lang_col else F.col("row").getField(c) for c in df.columns}
    return found.where("found.accepted").select(*[v.alias(c) for c, v in value.items()])
