"""Byte-level BPE encoding with content-defined chunk reuse.

A polynomial rolling hash over 16 bytes cuts texts where its top bits are zero,
so passages shared by documents fall into the same chunks.  Each task keeps the
ids of the chunks it has met (a bounded cache) and encodes a chunk once.  At each
join of two chunks the tokens around it are encoded anew between the nearest
places where every encoding has a token boundary (a letter, then a blank, then a
letter); if the tokens of a chunk don't agree with such a place, the window grows,
and at last both chunks are encoded as one.  So the ids equal those of the whole
text.

The chunk dictionary belongs to a task, not to the corpus: shuffling all chunk
texts to encode each exactly once would move more bytes than it saves.

Characters outside a tested range, where two regex engines might class a letter
or a blank differently, make the whole text go through the `tokenizers` library.
Special tokens in a text are recognised as that library does by default.

Defined results: null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import groups, utf8

GROUP = 1 << 20
WINDOW = 16
MEAN = 2048
LONGEST = 1 << 14
CACHE_BYTES = 48 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNTESTED = re.compile("[^\x00-ɏ‐-‧€]")
_SAFE = re.compile(rb"(?<=[a-zA-Z]) (?=[a-zA-Z])")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, GROUP + 1), _powers(_INVERSE, GROUP + 1)


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Places in a UTF-8 text where a chunk begins, by content alone."""
    found = []
    for lo in range(0, max(len(raw) - WINDOW, 0), GROUP - WINDOW):
        part = raw[lo : lo + GROUP]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SEED[part] * _UP[: len(part)], dtype=np.uint64)])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _DOWN[: len(part) + 1 - WINDOW]
        at = np.flatnonzero(rolled < np.uint64((1 << 64) // MEAN)) + WINDOW + lo
        found.append(at[at < len(raw)])
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return at[(raw[at] & 0xC0) != 0x80]


class Encoder:
    """Encodes and decodes whole texts; one for each Python worker."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.load(open(path))
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        back = {c: b for b, c in _byte_letters().items()}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in added}
        ranks = {b: i for i, b in self.bytes.items()}
        self.bytes.update({i: t.encode() for t, i in added.items()})
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        top = max(self.bytes) + 1
        self.size = [0] * top
        self.decimal = [b""] * top
        for i, b in self.bytes.items():
            self.size[i] = len(b)
            self.decimal[i] = b"%d" % i
        self.cache: dict[bytes, list[int]] = {}
        self.held = 0
        self.hits = self.misses = 0

    def _chunk(self, chunk: bytes) -> list[int]:
        ids = self.cache.get(chunk)
        if ids is not None:
            self.hits += 1
            return ids
        self.misses += 1
        ids = self.plain.encode_ordinary(chunk.decode())
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.cache[chunk] = ids
        self.held += 10 * len(chunk)
        return ids

    def _joined(self, text: bytes, raw: np.ndarray) -> list[int]:
        """Ids of a text without special tokens."""
        cuts = [0, *boundaries(raw).tolist(), len(text)]
        pieces: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            pieces.append(a)
            while b - a > LONGEST:
                a += LONGEST
                while a < b and text[a] & 0xC0 == 0x80:
                    a += 1
                if a < b:
                    pieces.append(a)
        pieces.append(len(text))
        ids: list[int] = []
        begin, left = 0, self._chunk(text[: pieces[1]])
        for a, b in zip(pieces[1:], pieces[2:]):
            right = self._chunk(text[a:b])
            fixed = self._repair(text, begin, a, b, left, right)
            if fixed is None:
                left = self._chunk(text[begin:b]) if b - begin <= LONGEST else self.plain.encode_ordinary(text[begin:b].decode())
            else:
                done, middle, keep, begin = fixed
                ids += left[:done]
                ids += middle
                left = right[keep:]
        return ids + left

    def _repair(self, text: bytes, lo: int, at: int, hi: int, left: list[int], right: list[int]):
        """Tokens of left kept, tokens of the window, tokens of right skipped, where these end.

        `left` are the ids of text[lo:at], a range that begins at a token boundary.
        """
        for reach in (64, 512, LONGEST):
            back = max(lo, at - reach)
            s = max((m.start() for m in _SAFE.finditer(text, max(back - 1, 0), at)), default=-1)
            stop = _SAFE.search(text, at + 1, min(hi, at + reach))
            if lo < s < at and s >= back and stop:
                e = stop.start()
                k = self._count(reversed(left), at - s)
                j = self._count(right, e - at)
                if k and j:
                    return len(left) - k, self.plain.encode_ordinary(text[s:e].decode()), j, e
            if back == lo and at + reach >= hi:
                break
        return None

    def _count(self, ids, n: int) -> int:
        """How many of `ids` take exactly n bytes; 0 if a token crosses that place."""
        for k, i in enumerate(ids, 1):
            n -= self.size[i]
            if n <= 0:
                return 0 if n else k
        return 0

    def encode(self, text: bytes, raw: np.ndarray) -> list[int]:
        if not text:
            return []
        if not text.isascii() and _UNTESTED.search(text.decode()):
            return self.library.encode(text.decode(), add_special_tokens=False).ids
        if self.special is None or not any(t.encode() in text for t in self.added):
            return self._joined(text, raw)
        ids = []
        for part in self.special.split(text.decode()):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                body = part.encode()
                ids += self._joined(body, np.frombuffer(body, np.uint8))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of each text and the text they decode to."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            for i, j in groups(ends, GROUP):
                ids = [enc.encode(raw[a:b].tobytes(), raw[a:b]) for a, b in zip(ends[i:j], ends[i + 1 : j + 1])]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    src = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) t")
    return src.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of ids, SHA-256 of the ids and of the decoded text."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            for i, j in groups(ends, 4 * GROUP):
                n, a_sha, b_sha = [], [], []
                for a, b in zip(ends[i:j], ends[i + 1 : j + 1]):
                    ids = enc.encode(raw[a:b].tobytes(), raw[a:b])
                    n.append(len(ids))
                    a_sha.append(hashlib.sha256(b",".join(map(enc.decimal.__getitem__, ids))).hexdigest())
                    b_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a_sha, pa.string()), pa.array(b_sha, pa.string())], names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    src = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) t")
    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
