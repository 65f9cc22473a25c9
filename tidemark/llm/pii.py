"""Personal data (operator 1), with DataFrame functions only.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for account numbers, parts
up to 255 for addresses, digit counts for phones) and words near a span, on both sides, adjust its score.
The base kinds keep every span that their rule confirms, whatever its score; the added kinds
(account numbers, social security numbers, short cards, phones without a country code) need a
score of LEAST.

A text is cut at a pattern's matches (extract_all gives the matches, split the gaps between them),
so that positions are running sums of lengths: time is linear in the text. Repetitions are
possessive and starts are bounded by look-behind where that can't change a match, so that no text
makes the matcher backtrack or recurse. An account number may be followed by upper-case words or
numbers that look like more of it, so every end at a word's end is tried and the longest that
passes mod-97 is taken; after one that passes none, the search goes on at the next word.

Defined cases: a null text is empty and has no span; repeated rows are treated alike; texts of any
length are read whole; extra columns stay as they are; spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the kinds. \G lets a match start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Matches an account number's first four characters only; group 1 is the longest text it can be.
IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "short_card")
#: Score of a confirmed span by itself, and what a context word near it adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3, "short_card": 0.4}
NEAR, CONTEXT_ADDS, LEAST = 48, 0.4, 0.6
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": r"phone|\btel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": r"ssn|social|security",
    "local_phone": r"phone|\btel|call|mobile|fax",
    "short_card": "card|visa|master|amex|credit|debit|pay",
}
_PATTERNS = {
    "email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "local_phone": LOCAL,
    "short_card": CARD
}
#: A cheap test that a text can have the kind at all.
_MAY = {
    "email": r"@[A-Za-z0-9-]++\.",
    "ip": r"[0-9]\.[0-9]",
    "card": r"(?:[0-9][ -]?){14}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"-[0-9]{2}-",
    "local_phone": r"[0-9]{3}[ .-][0-9]{4}",
    "short_card": r"(?:[0-9][ -]?){12}"
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether a number passes the check of ISO 13616."""
    plain = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(
            c.between("0", "9"), (a * 10 + value(c)) % 97
        ).otherwise((a * 100 + value(c)) % 97)
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def confirmed(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    if kind == "ip":
        return m.rlike(
            r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
        )
    if kind in ("card", "short_card"):
        n = F.length(_digits(m))
        return (n.between(14, 19) if kind == "card" else n.between(12, 13)) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _cuts(text: Column, kind: str) -> Column:
    """The text in pieces: array<struct<m, g>> of a match and the gap before it; the last m is null."""
    p = _PATTERNS[kind]
    if kind != "iban":
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"), F.split(text, p, -1).alias("g"))
    raw = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("m"), F.split(text, p, -1).alias("g"))

    def longest(m: Column) -> Column:
        words = F.split(F.coalesce(m, F.lit("")), " ")
        ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, 1, i), " "))
        return F.get(F.filter(ends, _mod97), F.lit(0))

    starts = F.transform(
        raw,
        lambda z: F.struct(z["g"].alias("g"), F.left(z["m"], F.lit(4)).alias("head"), longest(z["m"]).alias("best"))
    )
    own = "array<struct<m:string,g:string>>"

    def step(a: Column, x: Column) -> Column:
        # skip: what a confirmed match took of the text after its first four characters
        over = F.greatest(a["skip"] - F.length(x["g"]), F.lit(0))
        m = F.when(over > 0, F.lit("")).otherwise(F.coalesce(x["best"], x["head"]))
        new = F.array(
            F.struct(
                m.alias("m"), F.when(a["skip"] > 0, F.substr(x["g"], a["skip"] + 1)).otherwise(x["g"]).alias("g")
            )
        )
        full = F.size(a["now"]) >= 256
        return F.struct(
            F.when(over > 0, over - 4).otherwise(F.coalesce(F.length(x["best"]) - 4, F.lit(0))).alias("skip"),
            F.when(full, new).otherwise(F.concat(a["now"], new)).alias("now"),
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
        )

    zero = F.struct(
        F.lit(0).alias("skip"),
        F.expr(f"cast(array() as {own})").alias("now"),
        F.expr(f"cast(array() as array<{own}>)").alias("done")
    )
    return F.aggregate(starts, zero, step, lambda a: F.concat(F.flatten(a["done"]), a["now"]))


def _judged(text: Column, kind: str) -> Column:
    """The text in pieces with a verdict: array<struct<m, g, good, score>>. Context words count within NEAR
    characters before a match and after it, as far as the next match of the kind."""
    cuts, context = _cuts(text, kind), "(?i)" + CONTEXT[kind]
    after = F.slice(F.transform(cuts, lambda z: F.left(z["g"], F.lit(NEAR)).rlike(context)), F.lit(2), F.size(cuts))

    def verdict(z: Column) -> Column:
        m, g = z["x"]["m"], z["x"]["g"]
        near = F.right(g, F.lit(NEAR)).rlike(context) | F.coalesce(z["after"], F.lit(False))
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT_ADDS).otherwise(0.0))
        ok = confirmed(kind, m)
        good = ok if kind in BASE else ok & (score >= LEAST)
        return F.struct(m.alias("m"), g.alias("g"), F.coalesce(good, F.lit(False)).alias("good"), score.alias("score"))

    return F.transform(F.arrays_zip(cuts.alias("x"), after.alias("after")), verdict)


def find(text: Column, kind: str) -> Column:
    """Spans of one kind by start: array<struct<kind, start, end, score>>."""
    items = F.transform(
        F.filter(_judged(text, kind), lambda z: z["m"].isNotNull()),
        lambda z: F.struct(
            F.length(z["g"]).cast("long").alias("gap"),
            F.length(z["m"]).cast("long").alias("size"),
            z["good"].alias("good"),
            z["score"].alias("score")
        ),
    )
    own = f"cast(array() as {_SPAN})"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        new = F.array(
            F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"),
                x["score"].alias("score")
            )
        )
        full = F.size(a["now"]) >= 256  # blocks, so that appending stays cheap in texts with many spans
        return F.struct(
            (start + x["size"]).alias("at"),
            F.when(~x["good"], a["now"]).when(full, new).otherwise(F.concat(a["now"], new)).alias("now"),
            F.when(x["good"] & full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
        )

    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.expr(own).alias("now"),
        F.expr(f"cast(array() as array<{_SPAN}>)").alias("done")
    )
    spans = F.aggregate(items, zero, step, lambda a: F.concat(F.flatten(a["done"]), a["now"]))
    return F.when(text.rlike(_MAY[kind]), spans).otherwise(F.expr(own))


def scan(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column of all spans by start, then kind: array<struct<kind, start, end, score>>."""
    whole = F.coalesce(F.col(text), F.lit(""))
    both = F.concat(*(find(whole, k) for k in KINDS))
    order = F.transform(
        both,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            s["score"].alias("score")
        )
    )
    return docs.withColumn(
        out,
        F.transform(
            F.array_sort(order),
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")
            )
        )
    )


def _masked(text: Column, kind: str) -> Column:
    def piece(z: Column) -> Column:
        return F.concat(z["g"], F.when(z["m"].isNull(), "").when(z["good"], f"[{kind.upper()}]").otherwise(z["m"]))

    return F.array_join(F.transform(_judged(text, kind), piece), "")


def redacted(
    text: Column,
    kinds: tuple[str, ...] = ("email", "iban", "card", "short_card", "phone", "ssn", "local_phone", "ip")
) -> Column:
    """The text with every confirmed span replaced by its kind in square brackets, kind by kind."""
    for kind in kinds:
        text = F.when(text.rlike(_MAY[kind]), _masked(text, kind)).otherwise(text)
    return text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced; n_chars, where there is one, follows. A null text stays null."""
    columns = docs.columns
    for kinds in (("email",), ("iban",), ("card",), ("short_card",), ("phone",), ("ssn",), ("local_phone",), ("ip",)):
        docs = docs.withColumn(text, redacted(F.col(text), kinds))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)
