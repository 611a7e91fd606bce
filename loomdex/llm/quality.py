"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each text.  A document's votes
form a pattern, and patterns are few, so expectation-maximisation runs on the
counts of patterns over the whole corpus: it estimates how each labeller votes
given the hidden class, and the share of good texts.  The posteriors of a bounded
sample of texts train a logistic scorer over hashed features, which then scores
every whole text.

Defined results: null and empty texts get all votes that an empty text earns
(too short, so bad); ties of the posterior keep the text; repeated rows get equal
scores; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .arrow import groups, utf8
from .tables import cut, drop

GROUP = 1 << 20
#: Texts at most that train the scorer, by the order of a hash of their id.
SAMPLE = 12_000
BITS = 14
LABELLERS = ("length", "symbols", "capitals", "variety", "echo", "columns", "word_size", "sentences", "tails", "shouts")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, ".,;:'-?\"()")]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def measures(raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """Per row: what the labellers look at; and the rows' tokens (row, hash)."""
    n = len(off) - 1
    starts, size, row = words.spans(raw, off, words.VISIBLE)
    count = np.bincount(row, minlength=n)
    low = words.lowered(raw)
    head, tail = words.packed(low, starts, size, 6), low[np.maximum(starts + size - 1, 0)] if len(starts) else np.zeros(0, np.uint8)
    token = words.hashed(low, starts, size)
    order = np.lexsort((token, row))
    r, t = row[order], token[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(r[new], minlength=n)
    same = (token[1:] == token[:-1]) & (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    echo = np.bincount(row[1:][same], minlength=n) if len(row) else np.zeros(n)
    at = np.searchsorted(off, np.arange(len(raw)), side="right") - 1 if len(raw) else np.zeros(0, np.int64)
    total = np.maximum(np.bincount(at, minlength=n), 1)
    letters = np.maximum(np.bincount(at[_LETTER[raw]], minlength=n), 1)
    some = np.maximum(count, 1)
    lone = (size == 1) & _SYMBOL[raw[starts]] if len(starts) else np.zeros(0, bool)
    stop = (tail == ord(".")) | (tail == ord("?")) | (tail == ord("!")) if len(starts) else np.zeros(0, bool)
    return {
        "length": count,
        "symbols": np.bincount(at[_SYMBOL[raw]], minlength=n) / total,
        "capitals": np.bincount(at[_UPPER[raw]], minlength=n) / letters,
        "variety": distinct / some**0.75,
        "echo": echo / some,
        "columns": np.bincount(row[lone], minlength=n) / some,
        "word_size": np.bincount(row, size, n) / some,
        "shouts": np.bincount(row[(size > 1) & _UPPER[raw[starts]] & _UPPER[raw[np.minimum(starts + 1, len(raw) - 1)]]], minlength=n) / some,
        "tails": np.bincount(row[_SYMBOL[tail] | (tail == ord("!"))], minlength=n) / some,
        "sentences": np.bincount(row[stop], minlength=n) / some,
    }, (row, token, np.where(size > 6, head, -1), tail)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, labellers) of 0 abstain, 1 bad, 2 good."""
    def vote(bad, good):
        return np.where(bad, 1, np.where(good, 2, 0)).astype(np.int8)

    return np.stack(
        [
            vote(m["length"] < 5, (m["length"] >= 40) & (m["length"] < 50_000)),
            vote(m["symbols"] > 0.03, m["symbols"] < 0.005),
            vote(m["capitals"] > 0.5, m["capitals"] > 1),
            vote(m["variety"] < 0.4, m["variety"] > 1.2),
            vote(m["echo"] > 0.15, m["echo"] > 1),
            vote(m["columns"] > 0.05, m["columns"] > 1),
            vote((m["word_size"] < 2.2) | (m["word_size"] > 16), m["word_size"] > 99),
            vote(m["sentences"] == 0, (m["sentences"] > 0.02) & (m["sentences"] < 0.5)),
            vote(m["tails"] > 0.1, m["tails"] == 0),
            vote(m["shouts"] > 0.3, m["shouts"] > 1),
        ],
        axis=1,
    )


def encode_votes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def decode_votes(code: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(n) % 3


@dataclass
class Weak:
    """prior: share of good texts; table[l, class, vote]: how labeller l votes, class 1 good."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good, per row of votes."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(v), 0)
        for k in range(v.shape[1]):
            log += np.log(self.table[k][:, v[:, k]]).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Probability that a labeller that doesn't abstain is right."""
        share = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, 1] * share[0] + self.table[:, 1, 2] * share[1]
        return right / ((self.table[:, :, 1:].sum(axis=2)) @ share)


def fit_weak(v: np.ndarray, n: np.ndarray, steps: int = 200, belief: float = 0.5) -> Weak:
    """Expectation-maximisation over patterns v that occur n times.

    The belief that labellers seldom call a good text bad is the start, and counts
    as `belief` times the corpus in each step; so kinds of bad texts that share no
    labeller stay in one class.
    """
    start = np.array([[0.45, 0.4, 0.15], [0.45, 0.004, 0.546]])
    model = Weak(0.8, np.repeat(start[None], v.shape[1], 0))
    trust = belief * n.sum() * np.array([0.02, 0.8])[:, None] * start
    if not len(v):
        return model
    before = -1.0
    for _ in range(steps):
        good = model.posterior(v) * n
        mass = np.stack([n - good, good])
        table = np.stack([np.stack([np.bincount(v[:, k], mass[c], 3) for c in (0, 1)]) for k in range(v.shape[1])]) + trust + 1e-3
        model = Weak(float((good.sum() + 1) / (n.sum() + 2)), table / table.sum(axis=2, keepdims=True))
        if abs(model.prior - before) < 1e-10:
            break
        before = model.prior
    return model


def hashed(m: dict[str, np.ndarray], tokens: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of the rows: row, slot, value.

    Shares of whole words, heads of longer words and word tails, and the binned measures.
    """
    row, token, head, tail = tokens
    long = np.flatnonzero(head >= 0)
    some = np.maximum(np.bincount(row, minlength=n), 1)
    slots = [(_mix(token) >> np.uint64(64 - BITS)).astype(np.int64), (_mix(head[long] + 11) >> np.uint64(64 - BITS)).astype(np.int64), (_mix(tail.astype(np.int64) + (1 << 50)) >> np.uint64(64 - BITS)).astype(np.int64)]
    rows, values = [row, row[long], row], [1 / np.sqrt(some)[row], 1 / np.sqrt(some)[row[long]], 2 / some[row]]
    for k, name in enumerate(LABELLERS):
        x = np.log2(1 + m[name]) if name in ("length", "word_size") else np.sqrt(np.minimum(m[name], 4)) * 10
        slots.append((_mix(np.floor(x).astype(np.int64) + ((k + 2) << 50)) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(np.arange(n))
        values.append(np.full(n, 0.5))
    key = np.concatenate(rows) << BITS | np.concatenate(slots)
    uniq, back = np.unique(key, return_inverse=True)
    return uniq >> BITS, uniq & ((1 << BITS) - 1), np.bincount(back, np.concatenate(values), len(uniq))


def fit_linear(row: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 3e-4) -> np.ndarray:
    """Weights, the constant last, of logistic regression on soft labels, by adaptive gradient steps."""
    w = np.zeros((1 << BITS) + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[slot], len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(slot, value * e[row], 1 << BITS), e.sum()) + ridge * w / len(w)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


def _rows(batches):
    for batch in batches:
        raw, ends = utf8(batch.column(1))
        for i, j in groups(ends, GROUP):
            yield batch.column(0).slice(i, j - i), raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, Weak]:
    """(id, weak, score, keep) of every row, and the weak-label model."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def vote_rows(batches):
        for key, raw, off in _rows(batches):
            yield pa.record_batch([key, pa.array(encode_votes(votes(measures(raw, off)[0])), pa.int64())], ["id", "pattern"])

    voted = cut(src.mapInArrow(vote_rows, "id long, pattern long"))
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # 3 ** labellers rows at most
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(float)
    weak = fit_weak(decode_votes(patterns), counts)
    total = int(counts.sum())
    drop(voted)

    # A hash of the id picks about `sample` texts; the exact bound is set by the order of that hash.
    hash_ = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    picked = src.filter(hash_ <= int((1 << 40) * min(1.0, 1.2 * sample / max(total, 1))))

    def feature_rows(batches):
        for key, raw, off in _rows(batches):
            m, tokens = measures(raw, off)
            row, slot, value = hashed(m, tokens, len(off) - 1)
            at = np.searchsorted(row, np.arange(len(off)))
            cells = [np.stack([slot[a:b].astype(np.float32), value[a:b].astype(np.float32)]).tobytes() for a, b in zip(at, at[1:])]
            yield pa.record_batch([key, pa.array(encode_votes(votes(m)), pa.int64()), pa.array(cells, pa.binary())], ["id", "pattern", "cells"])

    got = picked.mapInArrow(feature_rows, "id long, pattern long, cells binary").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    w = np.zeros((1 << BITS) + 1)
    if got.num_rows:
        parts = [np.frombuffer(c, np.float32).reshape(2, -1) for c in got.column("cells").to_pylist()]
        row = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        both = np.concatenate(parts, axis=1)
        y = weak.posterior(decode_votes(got.column("pattern").to_numpy()))
        w = fit_linear(row, both[0].astype(np.int64), both[1].astype(float), y)

    def score_rows(batches):
        for key, raw, off in _rows(batches):
            n = len(off) - 1
            m, tokens = measures(raw, off)
            row, slot, value = hashed(m, tokens, n)
            z = np.bincount(row, value * w[slot], n) + w[-1]
            p = weak.posterior(votes(m).astype(np.int64))
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([key, pa.array(p), pa.array(s), pa.array(s >= 0.5)], ["id", "weak", "score", "keep"])

    return src.mapInArrow(score_rows, "id long, weak double, score double, keep boolean").withColumnRenamed("id", id_col), weak
