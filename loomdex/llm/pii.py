"""Personal data in texts, by DataFrame functions alone.

Per kind, one regular expression proposes spans; a validator (octets of an
address, Luhn for cards, digit counts for phones, mod-97 for bank accounts, number
ranges for social security numbers) confirms them; words within 40
characters before or after a span adjust its score, and in a list, whose spans of
the kind stand at most 40 characters apart, they count for all of its spans.  Spans of the four base kinds that pass their validator always stay; the
added kinds need a score of `least`.

Offsets come from splitting the text by the same expression: the pieces and the
matches alternate, so running sums of their lengths are the spans, in one pass and
in code points.  The expressions use possessive repeats and never scan one run of
characters from more than one start, so very long runs take linear time; they
match what the plain forms in `PLAIN` match.

Defined results: null and empty texts have no spans; repeated rows are judged each
for itself; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

_LOCAL = "A-Za-z0-9._%+-"


#: Characters of an account number by country, from the register.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHERS = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str
    context: str
    score: float
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write|reach", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", r"\bip\b|addr|host|server|log", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", r"card|visa|master|pay|credit", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|call|tel|mobile|fax", 0.6),
    Kind("iban", rf"(?<![A-Za-z0-9])(?>{_BY_COUNTRY}|(?!{_OTHERS})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])", "[0-9]", r"iban|account|bank|konto|compte", 0.7, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]", r"ssn|social|security", 0.4, False),
)
#: The plain forms of the base kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
REACH = 40
LEAST = 0.5
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def _mod97(match: Column) -> Column:
    """Whether an account number, its first four moved to the end, is 1 modulo 97."""
    flat = F.replace(match, F.lit(" "))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "))).between(15, 34) & _mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _cut(df: DataFrame, text: str, kind: Kind, m: str, p: str) -> DataFrame:
    """Add the matches of a kind and the pieces of text around them."""
    maybe = F.col(text).contains(kind.maybe) if len(kind.maybe) == 1 else F.col(text).rlike(kind.maybe)
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(maybe, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    return df.withColumn(p, F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(none))


def _near(kind: Kind, m: str, p: str) -> Column:
    """Per match, whether a context word is near it or near the list that it belongs to."""

    def hit(piece: Column) -> Column:
        return F.lower(piece).rlike(kind.context)

    def carried(pieces: Column, side) -> Column:
        look = F.transform(pieces, lambda g: F.struct(hit(side(g, F.lit(REACH))).alias("hit"), (F.length(g) <= REACH).alias("short")))
        zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("out"))

        def step(acc: Column, z: Column) -> Column:
            on = z["hit"] | (z["short"] & acc["on"])
            return F.struct(on.alias("on"), F.concat(acc["out"], F.array(on)).alias("out"))

        return F.aggregate(look, zero, step, lambda acc: acc["out"])

    before = carried(F.slice(p, 1, F.size(m)), F.right)
    after = F.reverse(carried(F.reverse(F.slice(p, 2, F.size(m))), F.left))
    return F.zip_with(before, after, lambda a, b: a | b)


def _matches(kind: Kind, m: str, p: str) -> Column:
    """Array of (x, near): each match, and whether its context speaks for it."""
    return F.zip_with(m, _near(kind, m, p), lambda x, near: F.struct(x.alias("x"), near.alias("near")))


def _spans(kind: Kind, k: int, m: str, p: str) -> Column:
    """Array of (s, k, e, score) of the valid matches."""
    look = F.zip_with(
        _matches(kind, m, p),
        F.slice(p, 1, F.size(m)),
        lambda z, gap: F.struct(
            F.length(gap).alias("gap"),
            F.length(z["x"]).alias("len"),
            valid(kind.name, z["x"]).alias("ok"),
            (F.lit(kind.score) + F.when(z["near"], 0.2).otherwise(0.0)).alias("score"),
        ),
    )
    empty = F.array().cast("array<struct<s:int,k:int,e:int,score:double>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + z["gap"]
        one = F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), (s + z["len"]).alias("e"), z["score"].alias("score")))
        keep = z["ok"] if kind.base else z["ok"] & (z["score"] >= LEAST)
        return F.struct((s + z["len"]).alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(m) > 0, F.aggregate(look, zero, step, lambda acc: acc["out"])).otherwise(empty)


def _names() -> Column:
    return F.array(*(F.lit(k.name) for k in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(_names(), x["k"]), x["s"], x["e"])), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all spans of each text as (s, k, e, score), by start, then kind."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        out = _cut(out, "text", kind, f"m_{kind.name}", f"p_{kind.name}")
    out = out.select("id", *(_spans(kind, k, f"m_{kind.name}", f"p_{kind.name}").alias(kind.name) for k, kind in enumerate(KINDS)))
    return out.select(F.col("id").alias(id_col), F.array_sort(F.concat(*(F.col(k.name) for k in KINDS))).alias("spans"))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, all spans and their scores."""
    found = find(df, id_col, text_col)
    base = F.filter("spans", lambda x: x["k"] < 4)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS) if kind.base]
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",")
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def _put(kind: Kind):
    """What takes the place of a piece and the match after it."""

    def put(z: Column, gap: Column) -> Column:
        x = z["x"] if kind.score < LEAST else z
        keep = valid(kind.name, x)
        if kind.score < LEAST:
            keep &= z["near"]
        return F.concat(gap, F.when(keep, f"<{kind.name.upper()}>").otherwise(x))

    return put


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`df` with each valid span of its text replaced by <KIND>; other columns stay.

    Null texts stay null.  `length_col`, if given, is set to the new length in
    code points.  Kinds are replaced one after the other, base kinds first.
    """
    columns = df.columns
    m, p = free_name(df, "_m"), free_name(df, "_p")
    for kind in KINDS:
        df = _cut(df, text_col, kind, m, p)

        found = _matches(kind, m, p) if kind.score < LEAST else F.col(m)
        rebuilt = F.concat(F.array_join(F.zip_with(found, F.slice(p, 1, F.size(m)), _put(kind)), ""), F.get(p, F.size(m)))
        df = df.withColumn(text_col, F.when(F.size(m) > 0, rebuilt).otherwise(F.col(text_col))).drop(m, p)
    if length_col:
        df = df.withColumn(length_col, F.length(text_col).cast("long"))
    return df.select(columns)
