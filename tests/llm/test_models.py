"""Toxicity and quality on planted corpora."""

import random

import numpy as np
import pytest

from loomdex.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int, id string"


def toxic_rows():
    rnd = random.Random(4)
    prose = lambda n: ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8))) for _ in range(n)]
    rows, truth = [], {}
    for k in range(700):
        words = prose(rnd.randrange(30, 80))
        truth[k] = int(k % 6 == 0)
        for _ in range(6 * truth[k]):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Zounds!", "VILEST", "knavery", "knavish", "wretch,"]))
        rows.append((k, " ".join(words)))
    return rows + [(None, "zounds vilest wretch knavery"), (9000, ""), (9001, None), (9000, "")], truth


def test_toxicity_learns_the_lexicon(spark, docs_of):
    rows, truth = toxic_rows()
    labels = spark.createDataFrame([(k, 1, y, "x") for k, y in truth.items()] + [(3, 1, None, "x"), (None, 1, 1, "x"), (0, 1, 1, "x")], LABELS)
    out, model = toxicity.score(docs_of(rows), labels)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {t for t, _ in model.lexicon()[:8]} >= {"zounds", "vilest", "wretch"}
    assert [r.predicted for r in got if r.doc_id in (9000, 9001)] == [0, 0, 0]
    kept = toxicity.reject(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_ignores_held_out_labels(spark, docs_of):
    rows, truth = toxic_rows()
    import zlib

    flip = {k: 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y for k, y in truth.items()}
    a, b = (toxicity.score(docs_of(rows), spark.createDataFrame([(k, 1, y, "x") for k, y in t.items()], LABELS))[0] for t in (truth, flip))
    key = lambda df: sorted((r.doc_id or -1, r.score) for r in df.collect())
    assert key(a) == key(b)


def test_toxicity_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.score(docs_of([(1, "a b")]), none)[0].collect()] == [pytest.approx(0, abs=1e-9)]
    one = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, 0, "x")], LABELS)
    assert toxicity.score(docs_of([]), one)[0].count() == 0


def test_quality_finds_junk(spark, docs_of):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n)) + "."
    rows, bad = [], set()
    for k in range(500):
        text = prose(rnd.randrange(40, 120))
        if k % 7 == 0:
            bad.add(k)
            text = [text.upper() + "!!", " | ".join(text.split()), " ".join(w + "%%%" for w in text.split()), "Was. " * 60][k // 7 % 4]
        rows.append((k, text))
    rows += [(900, None), (901, ""), (902, "x"), (1, rows[1][1])]
    out, model = quality.classify(docs_of(rows))
    got = out.collect()
    assert len(got) == len(rows)
    right = [r.keep == (r.doc_id not in bad) for r in got if r.doc_id < 500]
    assert np.mean(right) > 0.97
    assert model.accuracies().min() > 0.5 and abs(model.prior - 6 / 7) < 0.06
    assert len({(r.weak, r.score) for r in got if r.doc_id == 1}) == 1
    assert quality.classify(docs_of([]))[0].count() == 0


def test_weak_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    votes = np.zeros((20000, 5), np.int64)
    true = [0.95, 0.9, 0.85, 0.8, 0.7]
    for k, a in enumerate(true):
        right = rng.random(20000) < a
        votes[:, k] = np.where(rng.random(20000) < 0.3, 0, 1 + (y == right))
    code, n = np.unique(quality.encode_votes(votes), return_counts=True)
    model = quality.fit_weak(quality.decode_votes(code, 5), n.astype(float), belief=0.0)
    assert np.abs(model.accuracies() - true).max() < 0.03 and abs(model.prior - 0.8) < 0.03


def test_toxicity_tells_words_with_one_head_apart(spark, docs_of):
    rnd = random.Random(5)
    rows, truth = [], {}
    for k in range(600):
        text = ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8))) for _ in range(40)]
        truth[k] = int(k % 6 == 0)
        for _ in range(4):
            text.insert(rnd.randrange(len(text)), "interwretched" if truth[k] else "interwoven")
        rows.append((k, " ".join(text)))
    out, model = toxicity.score(docs_of(rows), spark.createDataFrame([(k, 1, y, "x") for k, y in truth.items()], LABELS))
    assert np.mean([r.predicted == truth[r.doc_id] for r in out.collect()]) > 0.97
    polarity = dict(model.lexicon())
    assert polarity["interwretched"] > 0.5 > 0 > polarity["interwoven"]


def test_words_are_hashed_whole():
    raw, off = np.frombuffer("Interwoven interwretched interwoven 中文句 中文 é".encode(), np.uint8), np.array([0, 52])
    off[1] = len(raw)
    row, node, (low, starts, size) = toxicity.nodes(raw, off)
    text = [bytes(low[s : s + n]).decode() for s, n in zip(starts, size)]
    assert text == ["interwoven", "interwretched", "interwoven", "中文", "文句", "中文", "é"]
    assert [node[k] == node[j] for k, j in ((0, 2), (3, 5), (0, 1), (3, 4))] == [True, True, False, False]
    raw = np.frombuffer(b"abcdefghij abcdefgxij", np.uint8)
    _, (_, token, head, _) = quality.measures(raw, np.array([0, len(raw)]))
    assert token[0] != token[1] and head[0] == head[1]


def test_cooccurrences_equal_brute_force(spark):
    from collections import Counter

    rnd = random.Random(12)
    rows = [(k, " ".join(rnd.choice("alpha beta gamma delta omega psi chi".split()) for _ in range(rnd.randrange(60)))) for k in range(40)] + [(99, None), (98, "")]
    name = lambda w: int(words_hash(w))
    vocab = np.sort([name(w) for w in ("alpha", "beta", "gamma")])
    index = {w: int(np.searchsorted(vocab, name(w))) for w in ("alpha", "beta", "gamma")}
    seeds = np.sort([index["alpha"], index["beta"]])
    want, window = Counter(), 3
    for _, t in rows:
        seen = (t or "").split()
        near = set()
        for p, w in enumerate(seen):
            for q in range(max(0, p - window), min(len(seen), p + window + 1)):
                v = seen[q]
                if p < q and w in index and v in index:
                    want[(toxicity.PAIRS, *sorted((index[w], index[v])))] += 1
                if w in ("alpha", "beta") and v not in index:
                    near.add(name(v))
        want.update((toxicity.NEAR, -1, x) for x in near)
        want[(toxicity.ROWS, -1, -1)] += 1
        want[(toxicity.SEEDED, -1, -1)] += bool({"alpha", "beta"} & set(seen))
    src = spark.createDataFrame(rows, "id long, t string").repartition(3)
    got = {(r.kind, r.i, r.j): r.n for r in toxicity.cooccurrences(src, vocab, seeds, window).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


def words_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return toxicity.nodes(raw, np.array([0, len(raw)]))[1][0]


def test_lexicon_grows_beyond_the_labelled_words(spark, docs_of, monkeypatch):
    rows, truth = toxic_rows()
    rnd = random.Random(9)
    for k in range(10_000, 10_400):
        words = ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8))) for _ in range(50)]
        if k % 4 == 0:
            at = rnd.randrange(40)
            words[at:at] = ["vilest", rnd.choice(["grawlix", "jarns"]), "wretch", "quimps", "zounds"]
        rows.append((k, " ".join(words)))
    labels = spark.createDataFrame([(k, 1, y, "x") for k, y in truth.items()], LABELS)
    out, model = toxicity.score(docs_of(rows), labels)
    wide = {bytes(r.word).decode(): r.polarity for r in model.wide.collect()}
    assert wide.keys() >= {"grawlix", "jarns", "quimps"} and min(wide[w] for w in ("grawlix", "jarns", "quimps")) > 0
    assert not {bytes(w).decode() for w in model.words} & {"grawlix", "jarns", "quimps"}
    key = lambda df: sorted((r.doc_id or -1, round(r.score, 12)) for r in df.collect())
    whole = key(out)
    kept = toxicity.reject(docs_of(rows), labels).count()
    monkeypatch.setattr(toxicity, "SLICE", 1)
    assert len(model.slices()) == len(wide) > 2
    assert key(toxicity.score(docs_of(rows), labels)[0]) == whole
    assert toxicity.reject(docs_of(rows), labels).count() == kept


def test_toxicity_of_long_texts_and_empty_tables(spark, docs_of):
    rows, truth = toxic_rows()
    long = "abc def " * 200_000
    labels = spark.createDataFrame([(k, 1, y, "x") for k, y in truth.items()], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs_of([*rows, (7000, long), (7001, long + "vilest wretch zounds knavery " * 50)]), labels)[0].collect()}
    assert got[7000].predicted == 0 and got[7001].score > got[7000].score
    assert toxicity.score(docs_of([]), labels)[0].count() == 0 and toxicity.reject(docs_of([]), labels).count() == 0
