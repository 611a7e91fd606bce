"""Tokens, chunk windows and text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CJK_RANGES = ((0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x30FF), (0xF900, 0xFAFF))
_CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
PIECES = _CJK + "+|[a-z0-9]{2,}"
LONG_TERM_BYTES = 2000
MAX_TERM_BYTES = 2_500_000
LONG_TERM_PREFIX = "␟long:"
#: White space as Unicode has it, with the four separators that Python adds.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """ASCII words of two characters or more, and bigrams of CJK runs (a run of one stays).

    Only ASCII is lower-cased; every other character separates.  Null gives null.
    """
    low = ascii_lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
    bigrams = F.flatten(
        F.transform(
            F.regexp_extract_all(low, F.lit(PIECES), F.lit(0)),
            lambda x: F.when(x.rlike("^[a-z0-9]") | (F.length(x) == 1), F.array(x)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
            ),
        )
    )
    return F.when(text.rlike(_CJK), bigrams).otherwise(words)


def token_count(text: Column) -> Column:
    """Number of tokens of a text, counted without making them."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    ascii_words = count("[A-Za-z0-9]{2,}")
    pairs, lone = count(f"(?<={_CJK}){_CJK}"), count(f"(?<!{_CJK}){_CJK}(?!{_CJK})")
    return F.when(text.rlike(_CJK), ascii_words + pairs + lone).otherwise(ascii_words)


def term_count(text: Column, term: str) -> Column:
    """How often a token occurs in a text: a whole ASCII word, a CJK pair, or a lone CJK character."""
    if term.isascii():
        pattern = f"(?i)(?<![a-z0-9]){term}(?![a-z0-9])"
    elif len(term) == 1:
        pattern = f"(?<!{_CJK}){term}(?!{_CJK})"
    else:
        pattern = f"{term[0]}(?={term[1]})"
    return F.regexp_count(text, F.lit(pattern))


def term_key(term: Column) -> Column:
    """The stored key of a term: itself, or a digest of a term over 2000 bytes."""
    return F.when(F.octet_length(term) > LONG_TERM_BYTES, F.concat(F.lit(LONG_TERM_PREFIX), F.sha2(term, 256))).otherwise(term)


def normalised(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_index, char_start, char_end) windows in code points.

    A window begins every size - overlap characters; the first whose end reaches
    the end of the text is the last.  A null or empty text has none.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise InvalidArgument("size must be positive and overlap in [0, size)")
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("char_start"), F.least(i * step + size, n).alias("char_end")))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<struct<chunk_index:int,char_start:int,char_end:int>>"))


def utc_timestamp(at: Column) -> Column:
    """A timestamp as text in UTC, to the second, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def label_matches(label: str, *columns: Column) -> Column:
    """Whether a label occurs in any of the texts, whatever the case; columns end at a line."""
    return F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(label.lower()))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dots; null if there is none."""
    host = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"\.+$", "")), F.lit(""))


def languages(header: Column) -> Column:
    """Language tags of a header, trimmed and in lower case, joined by commas; null if none."""
    tags = F.filter(F.transform(F.split(header, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.nullif(F.array_join(tags, ","), F.lit(""))


def has_language(tags: Column, tag: str) -> Column:
    return F.array_contains(F.split(tags, ","), tag.lower())
