"""Personal data replaced by format-preserving Feistel pseudonyms, with Spark's own functions only.

Candidates are found by pattern and replaced only if they are valid: cards by the Luhn check, account numbers (IBAN) by
their remainder of 97, dates by the calendar, internet addresses and social security numbers by their ranges, phone numbers
by their layouts. A value is a number in a x b; a keyed Feistel network of eight rounds permutes that domain exactly, so
equal values get equal pseudonyms in all documents, different values different ones, and the key takes them back.
Layout, length, country codes and mail domains stay; check digits are computed anew. Dates move within the 400 years from
1800 on, the span after which the calendar repeats (146,097 = 189 x 773 days). The letters and digits of a mail name are
shifted in their alphabets by a Feistel network over its two halves.

A date whose day or month is one digit moves among those with as many digits in either place.

A month-first date is one that can't be read day first; its pseudonym keeps the layout but may read either way, so of all
kinds it alone isn't always taken back by the key.

A candidate that fails its check takes no text with it: the search goes on one character after its beginning. Values are taken
from left to right, and a taken value hides those that begin within it. Where a value lies within a rejected candidate or
overlaps one, the candidate may become valid by the pseudonym (1 in 97 for account numbers, 1 in 10 for cards); then the
key doesn't take that value back.

Everything is an expression on one row: no shuffle, and nothing depends on how often a value occurs.

Defined results: a null text stays null, an empty one empty; texts without candidates come back unchanged; repeated rows
have equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalweave.llm.common import let, whole_row

ROUNDS = 8
# Patterns of the kinds, in the order in which they are tried at a place.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
YEAR, MONTH, DAY = r"(?:1[89]|2[01])[0-9]{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD TG",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def account_pattern() -> str:
    """By the country's length; other countries, or other lengths, as far as groups go on."""
    own = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        own.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    other = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*own, other])})(?![A-Za-z0-9])"


# Groups of a card: 4-4-4-4-3, 4-4-4-4, 4-6-5 and 4-6-4 digits, with spaces or hyphens.
CARD = "|".join(
    m.join(f"[0-9]{{{n}}}" for n in groups)
    for groups in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
    for m in (" ", "-")
)
#: A further group of a phone number, where no card begins; 7 to 15 digits before the end; no more digits behind it.
GROUP = rf"(?:[ .-](?!(?:{CARD})(?![0-9]|[ -][0-9]{{4}}))[0-9]{{1,12}})"
DIGIT = "[ .()-]{0,2}[0-9]"  # written out, as Java wants to see how far it looks behind
PHONE_DIGITS = rf"(?<=\+{DIGIT * 7}{f'(?:{DIGIT}' * 8}{')?' * 8})"
AFTER = r"(?![0-9]|[.-][0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "iban": account_pattern(),
    "iso": rf"(?<![0-9./-]){YEAR}(?:-{MONTH}-{DAY}|/{MONTH}/{DAY}|\.{MONTH}\.{DAY})(?![0-9/-]|\.[0-9])",
    "dmy": rf"(?<![0-9./-]){DAY}(?:-{MONTH}-|/{MONTH}/|\.{MONTH}\.){YEAR}(?![0-9/-]|\.[0-9])",
    "mdy": rf"(?<![0-9./-]){MONTH}(?:-{DAY}-|/{DAY}/){YEAR}(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{3,4}}[ .-][0-9]{{3,4}}{AFTER}"
    rf"|\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{1,12}}{GROUP}{{0,5}}{PHONE_DIGITS}"
    rf"|\+[0-9]{{1,3}}{GROUP}{{1,6}}{PHONE_DIGITS}|\+[0-9]{{8,15}}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
    rf"|[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}|[0-9]{{3}} [0-9]{{3}} [0-9]{{4}}){AFTER}",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}|{CARD})(?![0-9])",
}
DATES = {"iso": "yyyy{0}MM{0}dd", "dmy": "dd{0}MM{0}yyyy", "mdy": "MM{0}dd{0}yyyy"}
ORDERS = {"iso": "ymd", "dmy": "dmy", "mdy": "mdy"}
CANDIDATE = "|".join(PATTERNS.values())


def hashed(key: str, *parts: Column, hexits: int | Column = 12) -> Column:
    """48 keyed bits, or four times as many as `hexits`, at most 60."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    hexits = F.lit(hexits) if isinstance(hexits, int) else hexits
    return F.conv(F.substring(F.sha2(text, 256), F.lit(1), hexits), 16, 10).cast("long")


def feistel(key: str, tweak: Column, u: Column, v: Column, a: Column, b: Column, inverse: bool) -> Column:
    """A permutation of the pairs u < a, v < b, as a struct (u, v)."""
    rounds = F.sequence(F.lit(ROUNDS if inverse else 1), F.lit(1 if inverse else ROUNDS))
    sign = -1 if inverse else 1
    hexits = F.when(b > 10**11, 15).otherwise(12)  # 48 bits don't reach all of a larger domain

    def step(state: Column, r: Column) -> Column:
        u, v = state["u"], state["v"]
        odd = r % 2 == 1
        new_u = F.when(odd, F.pmod(u + sign * F.pmod(hashed(key, tweak, r, v, hexits=hexits), a), a)).otherwise(u)
        new_v = F.when(odd, v).otherwise(F.pmod(v + sign * F.pmod(hashed(key, tweak, r, u, hexits=hexits), b), b))
        return F.struct(new_u.alias("u"), new_v.alias("v"))

    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))
    return F.aggregate(rounds, start, step)


def power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(18)]), (n + 1).cast("int"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(key: str, tweak: Column, number: Column, inverse: bool) -> Column:
    """A string of 2 to 34 digits to another of the same length."""
    n = F.length(number)
    half = (n / 2).cast("int")
    u, v = F.substring(number, F.lit(1), half).cast("long"), F.substring(number, half + 1, n - half).cast("long")
    new = feistel(key, F.concat_ws("|", tweak, n), u, v, power(half), power(n - half), inverse)
    return let(new, lambda x: F.concat(F.lpad(x["u"].cast("string"), half, "0"), F.lpad(x["v"].cast("string"), n - half, "0")))


def laid_out(layout: Column, number: Column) -> Column:
    """The digits of a number in the places of the layout's digits."""
    places = F.sequence(F.lit(1), F.length(layout))

    def character(i: Column) -> Column:
        c = F.substring(layout, i, F.lit(1))
        nth = F.length(digits(F.substring(layout, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(number, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(places, character), "")


def moved_day(key: str, year: Column, month: Column, day: Column, inverse: bool) -> tuple[Column, Column]:
    """Dates whose day or month is one digit: whether there is such a day, and another with as many digits in both places.

    The result is a struct of strings (y, m, d). February 29 moves among the 97 leap years.
    """
    width = F.concat(F.length(month).cast("string"), F.length(day).cast("string"))
    last = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    sizes = {"11": (9, 9), "21": (12, 9), "12": (9, 31)}
    every = {
        w: F.lit([f"{m}-{d}" for m in range(1, months + 1) for d in range(1, min(days, last[m - 1]) + 1)])
        for w, (months, days) in sizes.items()
    }
    places = F.when(width == "11", every["11"]).when(width == "21", every["21"]).otherwise(every["12"])
    leap = F.lit([str(y) for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)])
    place = F.concat_ws("-", month.cast("int").cast("string"), day.cast("int").cast("string"))
    extra = (place == "2-29") & (width == "12")
    at = F.when(extra, F.array_position(leap, year)).otherwise(F.array_position(places, place))
    own = F.when(extra, 0).otherwise(year.cast("long") - 1800)
    size = F.when(extra, F.size(leap)).otherwise(F.size(places)).cast("long")
    years = F.when(extra, 1).otherwise(400).cast("long")
    tweak = F.concat_ws("|", F.lit("date"), width, extra.cast("string"))

    def written(new: Column) -> Column:
        y = F.when(extra, F.element_at(leap, (new["v"] + 1).cast("int"))).otherwise((new["u"] + 1800).cast("string"))
        parts = F.split(F.when(extra, place).otherwise(F.get(places, new["v"].cast("int"))), "-")
        m, d = F.lpad(parts[0], F.length(month), "0"), F.lpad(parts[1], F.length(day), "0")
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    return at > 0, let(feistel(key, tweak, own, at - 1, years, size, inverse), written)


def luhn_sum(number: Column, doubled: int) -> Column:
    """Sum of the digits, from the right, every second one doubled, beginning with the digit `doubled` (0 or 1)."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(i, F.lit(2)) == doubled, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda s, x: s + x)


def remainder97(account: Column) -> Column:
    """Of letters and digits, letters counting as 10 to 35."""
    characters = F.transform(F.sequence(F.lit(1), F.length(account)), lambda i: F.substring(account, i, F.lit(1)))

    def step(sum_: Column, c: Column) -> Column:
        letter = F.ascii(c) - 64
        return F.when(c.rlike("[0-9]"), F.pmod(sum_ * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(
            F.pmod(sum_ * 100 + letter + 9, F.lit(97))
        )

    return F.aggregate(characters, F.lit(0), step)


def shifted_name(key: str, name: Column, inverse: bool) -> Column:
    """Letters and digits of a mail name, each half shifted by a keyed hash of the other, in turn."""
    n = F.length(name)
    half = (n / 2).cast("int")
    sign = -1 if inverse else 1

    def moved(part: Column, other: Column, r: Column) -> Column:
        def character(i: Column) -> Column:
            c, by = F.substring(part, i, F.lit(1)), sign * hashed(key, F.lit("email"), n, r, other, i)
            code = F.ascii(c)

            def turn(first: int, size: int) -> Column:
                return F.char(F.pmod(code - first + by, F.lit(size)) + first)

            return (
                F.when(c.rlike("[0-9]"), turn(48, 10))
                .when(c.rlike("[a-z]"), turn(97, 26))
                .when(c.rlike("[A-Z]"), turn(65, 26))
                .otherwise(c)
            )

        places = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, character), "")

    def step(state: Column, r: Column) -> Column:
        u, v = state["u"], state["v"]
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, moved(u, v, r)).otherwise(u).alias("u"), F.when(odd, v).otherwise(moved(v, u, r)).alias("v")
        )

    rounds = F.sequence(F.lit(4 if inverse else 1), F.lit(1 if inverse else 4))
    start = F.struct(F.substring(name, F.lit(1), half).alias("u"), F.substring(name, half + 1, n - half).alias("v"))
    done = F.aggregate(rounds, start, step)
    return F.concat(done["u"], done["v"])


def pseudonym(key: str, value: Column, inverse: bool) -> dict[str, tuple[Column, Column]]:
    """For each kind: whether a match is a valid value of it, and its pseudonym."""

    def mail() -> tuple[Column, Column]:
        name = F.substring_index(value, "@", 1)
        domain = F.substring(value, F.length(name) + 1, F.length(value))
        return F.lit(True), F.concat(shifted_name(key, name, inverse), domain)

    def address() -> tuple[Column, Column]:
        octet = [F.element_at(F.split(value, "\\."), i).cast("long") for i in (1, 2, 3, 4)]
        size = F.lit(65536).cast("long")
        new = feistel(key, F.lit("ip"), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size, inverse)
        parts = [(new[c] / 256).cast("long") if high else F.pmod(new[c], F.lit(256)) for c in "uv" for high in (1, 0)]
        return F.lit(True), F.concat_ws(".", *[p.cast("string") for p in parts])

    def account() -> tuple[Column, Column]:
        plain = F.regexp_replace(value, " ", "")
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = (remainder97(F.concat(body, F.substring(plain, 1, 4))) == 1) & (F.length(digits(body)).between(2, 34))

        def numbered(number: Column) -> Column:
            new = laid_out(body, number)
            check = F.lpad((F.lit(98) - remainder97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return let(F.concat(check, number), lambda x: laid_out(value, x))

        return valid, let(permuted_digits(key, F.concat_ws("|", F.lit("iban"), country), digits(body), inverse), numbered)

    def date(kind: str) -> tuple[Column, Column]:
        mark = F.regexp_extract(value, "[./-]", 0)
        form = DATES[kind].format("-")
        day = F.try_to_timestamp(F.regexp_replace(value, "[./]", "-"), F.lit(form)).cast("date")
        n = F.datediff(day, F.lit("1800-01-01").cast("date"))
        a, b = F.lit(189).cast("long"), F.lit(773).cast("long")
        new = feistel(key, F.lit("date"), (n / 773).cast("long"), F.pmod(n, F.lit(773)), a, b, inverse)
        moved = F.date_add(F.lit("1800-01-01").cast("date"), (new["u"] * 773 + new["v"]).cast("int"))
        parts = {c: F.element_at(F.split(value, "[./-]"), i + 1) for i, c in enumerate(ORDERS[kind])}
        short = (F.length(parts["m"]) == 1) | (F.length(parts["d"]) == 1)
        known, other = moved_day(key, parts["y"], parts["m"], parts["d"], inverse)
        told = let(other, lambda x: F.concat_ws("-", *[x[c] for c in ORDERS[kind]]))
        valid = F.when(short, known).otherwise(day.isNotNull())
        moved = F.when(short, told).otherwise(F.date_format(moved, form))
        return valid, F.regexp_replace(moved, F.lit("-"), mark)

    def security() -> tuple[Column, Column]:
        area, group, serial = [F.element_at(F.split(value, "-"), i).cast("long") for i in (1, 2, 3)]
        area = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas: not 000, 666 or from 900 on
        a, b = F.lit(898 * 99).cast("long"), F.lit(9999).cast("long")
        new = feistel(key, F.lit("ssn"), area * 99 + group - 1, serial - 1, a, b, inverse)
        area = (new["u"] / 99).cast("long") + 1
        parts = (F.when(area >= 666, area + 1).otherwise(area), F.pmod(new["u"], F.lit(99)) + 1, new["v"] + 1)
        padded = [F.lpad(p.cast("string"), w, "0") for p, w in zip(parts, (3, 2, 4), strict=True)]
        return F.lit(True), F.concat_ws("-", *padded)

    def phone() -> tuple[Column, Column]:
        all_digits = digits(value)
        separated = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})(?![0-9])", 1))
        code = F.when(~value.startswith("+"), 0).when(separated > 0, separated).otherwise(2)
        fixed, rest = F.substring(all_digits, F.lit(1), code), F.substring(all_digits, code + 1, F.length(all_digits))
        new = permuted_digits(key, F.concat_ws("|", F.lit("phone"), fixed), rest, inverse)
        return F.length(all_digits).between(7, 15), let(F.concat(fixed, new), lambda x: laid_out(value, x))

    def card() -> tuple[Column, Column]:
        all_digits = digits(value)
        body = F.substring(all_digits, F.lit(1), F.length(all_digits) - 1)

        def numbered(new: Column) -> Column:
            check = F.pmod(F.lit(10) - F.pmod(luhn_sum(new, 0), F.lit(10)), F.lit(10)).cast("string")
            return let(F.concat(new, check), lambda x: laid_out(value, x))

        valid = F.pmod(let(all_digits, lambda x: luhn_sum(x, 1)), F.lit(10)) == 0
        return valid, let(permuted_digits(key, F.lit("card"), body, inverse), numbered)

    kinds: dict[str, Callable[[], tuple[Column, Column]]] = {
        "email": mail,
        "ip": address,
        "iban": account,
        "ssn": security,
        "phone": phone,
        "card": card,
    }
    return {k: kinds[k]() if k in kinds else date(k) for k in PATTERNS}


def checked(key: str, value: Column, inverse: bool) -> Column:
    """A candidate and its kind, null if it is no valid value."""
    options, kind = pseudonym(key, value, inverse), F.lit(None).cast("string")
    for k in reversed(PATTERNS):
        kind = F.when(value.rlike("^(?:" + PATTERNS[k] + ")$") & options[k][0], k).otherwise(kind)
    return F.struct(kind.alias("kind"), value.alias("original"))


def recognised(key: str, value: Column, inverse: bool) -> Column:
    """A candidate and its kind. Of 19 digits in groups that are no card, the first 16 may be one."""

    def shorter(found: Column) -> Column:
        head = F.substring(found["original"], 1, 19)
        grouped = found["kind"].isNull() & found["original"].rlike("^[0-9]{4}([ -])(?:[0-9]{4}\\1){3}[0-9]{3}$")
        card = grouped & (F.pmod(let(digits(head), lambda x: luhn_sum(x, 1)), F.lit(10)) == 0)
        return F.when(card, F.struct(F.lit("card").alias("kind"), head.alias("original"))).otherwise(found)

    return let(checked(key, value, inverse), shorter)


def chosen(candidates: Column, pieces: Column) -> Column:
    """For each piece of the text, which begins with a candidate: whether that is replaced, and how many of the piece's
    first characters belong to a value replaced before. From left to right a valid candidate is taken, and what it covers
    is not tried again; an invalid one takes nothing with it.
    """
    start = F.struct(F.lit(0).alias("covered"), F.lit("").alias("out"))

    def step(state: Column, i: Column) -> Column:
        candidate, length = F.get(candidates, i), F.length(F.get(pieces, i))
        take = (state["covered"] == 0) & candidate["kind"].isNotNull()
        reach = F.when(take, F.length(candidate["original"])).otherwise(state["covered"])
        told = F.concat(F.when(take, "+").otherwise("-"), state["covered"].cast("string"), F.lit(" "))
        return F.struct(F.greatest(reach - length, F.lit(0)).alias("covered"), F.concat(state["out"], told).alias("out"))

    # One short text instead of an array, which every step would copy.
    return F.split(F.aggregate(F.sequence(F.lit(0), F.size(candidates) - 1), start, step)["out"], " ")


def replace_personal(df: DataFrame, text_col: str, key: str, inverse: bool = False) -> DataFrame:
    """The rows of df as `row`, beside text (with pseudonyms) and found: an array of (kind, original, value)."""
    rows = df.select(whole_row(df).alias("row"), F.col(text_col).cast("string").alias("text"))
    # A candidate at every place where one begins, also within others; the text is cut at these places.
    values = F.regexp_extract_all("text", F.lit(f"(?=({CANDIDATE}))"), F.lit(1))
    values = F.when(F.col("text").rlike("[0-9@]"), values).otherwise(F.array().cast("array<string>"))
    candidates = F.transform(values, lambda v: recognised(key, v, inverse))
    rows = rows.withColumn("candidates", candidates)
    some = F.size("candidates") > 0
    rows = rows.withColumn("pieces", F.when(some, F.split("text", f"(?={CANDIDATE})", -1)))
    # What lies before the first candidate; there is no such piece if the text begins with one.
    before = F.size("pieces") - F.size("candidates")
    rows = rows.withColumn("head", F.when(before == 1, F.get("pieces", F.lit(0))).otherwise(""))
    rows = rows.withColumn("pieces", F.slice("pieces", before + 1, F.size("candidates")))
    rows = rows.withColumn("chosen", F.when(some, chosen(F.col("candidates"), F.col("pieces"))))

    def new(i: Column) -> Column:
        candidate, told = F.get("candidates", i), F.get("chosen", i)
        piece, kind = F.get("pieces", i), F.when(told.startswith("+"), candidate["kind"])
        covered = F.when(kind.isNotNull(), F.length(candidate["original"])).otherwise(F.substring(told, 2, 9).cast("int"))
        rest = F.substring(piece, covered + 1, F.length(piece))
        return F.struct(kind.alias("kind"), candidate["original"].alias("original"), rest.alias("rest"))

    def replaced(found: Column) -> Column:
        options, value = pseudonym(key, found["original"], inverse), F.lit("")
        for k in reversed(PATTERNS):
            value = F.when(found["kind"] == k, options[k][1]).otherwise(value)
        return found.withField("value", value)

    places = F.sequence(F.lit(0), F.size("candidates") - 1)
    rows = rows.withColumn("found", F.when(some, F.transform(F.transform(places, new), replaced)))
    joined = F.array_join(F.transform("found", lambda f: F.concat(f["value"], f["rest"])), "")
    rows = rows.withColumn("new", F.when(some, F.concat("head", joined)).otherwise(F.col("text")))
    taken = F.transform(
        F.filter("found", lambda f: f["kind"].isNotNull()),
        lambda f: F.struct(f["kind"].alias("kind"), f["original"].alias("original"), f["value"].alias("value")),
    )
    nothing = F.array().cast("array<struct<kind:string,original:string,value:string>>")
    return rows.select("row", F.col("new").alias("text"), F.coalesce(taken, nothing).alias("found"))


def pseudonyms(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and how many values of each kind were replaced."""
    found = replace_personal(df, text_col, key)
    kinds = F.transform("found", lambda f: f["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).alias(f"n_{k}") for k in PATTERNS]
    return found.select(F.col("row").getField(id_col).alias("doc_id"), "text", *counts)
