"""Metadata filters: validation on the driver, predicates that reach the scan."""

from __future__ import annotations

import ipaddress
import json
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, LimitExceeded
from ..functions.text import has_language

MAX_ELIGIBLE = 10_000
MAX_BYTES = 2048
_ZONE = re.compile(r"(Z|[+-]\d{2}:\d{2})$", re.I)
_LABEL = re.compile(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")


def _host(value: str) -> str:
    host = "".join(c.lower() if c.isascii() else c for c in value)
    if host.startswith("["):
        ipaddress.IPv6Address(host.strip("[]"))
    elif len(host) > 253 or not all(_LABEL.match(x) for x in host.split(".")):
        raise ValueError("not a host name")
    return host


def _time(value: str) -> datetime:
    if not _ZONE.search(value):
        raise ValueError("a time needs an explicit zone")
    return datetime.fromisoformat(value)


@dataclass(frozen=True)
class SearchFilter:
    domain: str | None = None
    from_: datetime | None = None
    to: datetime | None = None
    language: str | None = None
    format: str | None = None
    collection_id: str | None = None

    @classmethod
    def parse(cls, given: dict | str) -> SearchFilter:
        """Filter of one to six known keys, all strings; errors name the key."""
        spec = json.loads(given) if isinstance(given, str) else given
        known = {"domain", "from", "to", "language", "format", "collection_id"}
        if not isinstance(spec, dict) or not spec or set(spec) - known:
            raise InvalidArgument(f"a filter has one or more of {sorted(known)}")
        if len(json.dumps(spec, ensure_ascii=False).encode()) > MAX_BYTES:
            raise LimitExceeded(f"a filter has {MAX_BYTES} bytes at most")
        out = {}
        for key, value in spec.items():
            if not isinstance(value, str) or not value:
                raise InvalidArgument(f"{key} must be a string")
            if len(value.encode()) > MAX_BYTES:
                raise LimitExceeded(f"{key} has {MAX_BYTES} bytes at most")
            try:
                if key == "domain":
                    value = _host(value)
                elif key in ("from", "to"):
                    value = _time(value)
                elif key in ("language", "format"):
                    value = value.lower()
            except ValueError as e:
                raise InvalidArgument(f"{key}: {e}") from e
            out["from_" if key == "from" else key] = value
        got = cls(**out)
        if got.from_ and got.to and got.from_ > got.to:
            raise InvalidArgument("from lies after to")
        return got


def predicate(df: DataFrame, f: SearchFilter) -> DataFrame:
    """Rows that meet all conditions; dates are inclusive at both ends."""
    if f.domain is not None:
        df = df.filter(F.col("domain") == f.domain)
    if f.from_ is not None:
        df = df.filter(F.col("warc_date") >= F.lit(f.from_))
    if f.to is not None:
        df = df.filter(F.col("warc_date") <= F.lit(f.to))
    if f.language is not None:
        df = df.filter(has_language(F.col("content_language"), f.language))
    if f.format is not None:
        df = df.filter(F.col("media_type") == f.format)
    if f.collection_id is not None:
        df = df.filter(F.col("collection_id") == f.collection_id)
    return df


def admitted(metadata: DataFrame, f: SearchFilter) -> DataFrame:
    """(doc_id) admitted by the filter, however many: a frame that searches join where it lies."""
    return predicate(metadata, f).select("doc_id")


def eligible_ids(metadata: DataFrame, f: SearchFilter, most: int = MAX_ELIGIBLE) -> DataFrame:
    """(doc_id) admitted by the filter, for lists that one machine holds; more than `most` is an error, never a cut."""
    ids = admitted(metadata, f).distinct()
    if ids.limit(most + 1).count() > most:
        raise LimitExceeded(f"the filter admits more than {most} documents")
    return ids
