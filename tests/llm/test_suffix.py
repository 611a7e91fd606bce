"""Repeated strings against counting every start."""

import hashlib
import random
from collections import Counter

import pytest

from loomdex.llm import suffix


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rnd.randrange(40)) for _ in range(3)]
        for s in shared:
            if rnd.random() < 0.4:
                a, b = sorted(rnd.randrange(len(s)) for _ in range(2))
                parts.insert(rnd.randrange(len(parts) + 1), s[a:b] if rnd.random() < 0.7 else s)
        rows.append((k, "".join(parts)))
    copy = rows[3][1] + prose(50)
    rows += [(200 + k, copy) for k in range(5)]
    rows += [(300 + k, copy[:k * 9] + "#" + copy[k * 9 + 1:]) for k in range(1, 20)]
    rows += [(400, "ab" * 400), (401, "x" * 333), (402, ""), (403, None), (404, "same same " * 30), (404, "same same " * 30), (None, shared[0]), (405, "🙂é" * 90)]
    return rows


@pytest.mark.parametrize(("length", "gathered"), [(100, 1 << 14), (100, 2), (33, 1 << 14)])
def test_equals_brute_force(spark, docs_of, length, gathered, monkeypatch):
    monkeypatch.setattr(suffix, "GATHERED", gathered)
    monkeypatch.setattr(suffix.covered, "__defaults__", (suffix.LENGTH, gathered))
    rows = corpus(length)
    got = sorted(map(tuple, suffix.digest(docs_of(rows), length=length).collect()), key=str)
    assert got == brute(rows, length)


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    import numpy as np

    rnd = random.Random(3)
    raw = np.array([rnd.randrange(256) for _ in range(9000)], np.uint8)
    whole = suffix.runs(raw, np.array([0, len(raw)]), 60)
    monkeypatch.setattr(suffix, "GROUP", 1000)
    starts = []
    for _, part, off, place in suffix.segments(raw, np.array([0, len(raw)]), 60):
        _, p, n, _, _ = suffix.runs(part, off, 60)
        starts += [place + a + k for a, c in zip(p, n) for k in range(c)]
    assert starts == list(range(9000 - 59)) == [a + k for a, c in zip(whole[1], whole[2]) for k in range(c)]


def test_removal_keeps_columns_and_characters(spark, docs_of):
    rows = corpus(7)
    docs = docs_of(rows)
    out = suffix.remove(docs, length=100, length_col="n_chars")
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[403] is None and text[402] == "" and text[200] == "" and text[400] == ""
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert suffix.digest(docs_of([])).count() == 0 and suffix.remove(docs_of([])).count() == 0


@pytest.mark.parametrize(("length", "passage"), [(100, 40), (100, 100), (33, 20)])
def test_passages_are_counted_on_the_way(spark, docs_of, length, passage):
    rows = corpus(length + 1) + [(500 + k, "y" * 50 + "passage " * 6 + str(k) * 30) for k in range(3)]
    got = [(tuple(r)[:5], r.n_repeated) for r in suffix.digest(docs_of(rows), length=length, passage=passage).collect()]
    assert sorted((r for r, _ in got), key=str) == brute(rows, length)
    assert sorted(((r[0], r[1], n) for r, n in got), key=str) == sorted(((d, n, gone) for d, n, gone, *_ in brute(rows, passage)), key=str)
    assert suffix.digest(docs_of([]), passage=240).count() == 0
