"""Excerpts around the first matching token, with the matches marked for HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, LimitExceeded
from ..functions.text import CJK_RANGES, LOWER, UPPER

MAX_SOURCE, MAX_EXCERPT, MAX_TERMS = 1_000_000, 2000, 256
_FOLD = str.maketrans(UPPER, LOWER)
_RUN = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]+)|([A-Za-z0-9]{2,})")


def spans(text: str):
    """(token, start, end) as the index tokeniser cuts them, in code points."""
    for m in _RUN.finditer(text):
        if m[2]:
            yield m[2].translate(_FOLD), m.start(), m.end()
        elif m.end() - m.start() == 1:
            yield m[1], m.start(), m.end()
        else:
            yield from ((text[i : i + 2], i, i + 2) for i in range(m.start(), m.end() - 1))


def snippet(text: str, terms: frozenset[str], limit: int = 240) -> dict:
    """The excerpt, where it lies, and its HTML; a text over the scan limit raises."""
    if len(text) > MAX_SOURCE:
        raise LimitExceeded(f"a source has {MAX_SOURCE} characters at most")
    hits = [(s, e) for t, s, e in spans(text) if t in terms]
    start = 0
    if hits and len(text) > limit:
        if hits[0][1] - hits[0][0] > limit:
            raise InvalidArgument("the excerpt is shorter than the first match")
        start = min(max(0, hits[0][0] - limit // 3), len(text) - limit)
    end = min(len(text), start + limit)
    merged: list[list[int]] = []
    for s, e in hits:
        if start <= s and e <= end:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
    out, at = [], start
    for s, e in merged:
        out += [html.escape(text[at:s]), "<mark>", html.escape(text[s:e]), "</mark>"]
        at = e
    return {"excerpt": text[start:end], "char_start": start, "char_end": end, "html": "".join(out) + html.escape(text[at:end])}


def with_snippets(hits: DataFrame, terms: list[str], limit: int = 240, text_col: str = "text") -> DataFrame:
    """Hits with a struct `snippet`; null texts have none."""
    if not 1 <= limit <= MAX_EXCERPT:
        raise InvalidArgument(f"an excerpt has 1 to {MAX_EXCERPT} characters")
    wanted = frozenset(t.translate(_FOLD) for t in terms if t)
    if len(wanted) > MAX_TERMS:
        raise LimitExceeded(f"{MAX_TERMS} terms at most")

    def make(texts: pd.Series) -> pd.DataFrame:
        none = {"excerpt": None, "char_start": None, "char_end": None, "html": None}
        return pd.DataFrame([none if t is None else snippet(t, wanted, limit) for t in texts], columns=list(none))

    udf = F.pandas_udf(make, "excerpt string, char_start int, char_end int, html string")
    return hits.withColumn("snippet", udf(F.col(text_col)))
