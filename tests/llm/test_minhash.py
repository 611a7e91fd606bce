"""Near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from loomdex.llm import minhash
from loomdex.llm.components import components


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent):
    sets = [brute_sets(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 120, 300]))]
        for _ in range(6):
            mine = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                mine[rnd.randrange(len(mine))] = rnd.choice(vocab)
            rows.append(" ".join(mine).title() if rnd.random() < 0.3 else "\n".join(mine))
    # A chain of drifting copies, and documents that share a template but little else.
    words = [rnd.choice(vocab) for _ in range(200)]
    for _ in range(12):
        words[rnd.randrange(200)] = rnd.choice(vocab)
        words[rnd.randrange(200)] = rnd.choice(vocab)
        rows.append(" ".join(words))
    template = " ".join(rnd.choice(vocab) for _ in range(80))
    rows += [template + " " + " ".join(rnd.choice(vocab) for _ in range(25)) for _ in range(12)]
    rows += ["", None, " \t\n", "one", "One", "a b c d", "a b c d e", "É é x", "é é x"]
    rnd.shuffle(rows)
    return [(100 + k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, docs_of, percent):
    rows = corpus()
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in minhash.digest(docs_of(rows), percent=percent).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, percent)


def test_repeated_and_null_ids(spark, docs_of):
    text = "some words that make up one text of a few shingles here"
    rows = [(7, text), (7, text), (None, text), (3, text), (5, None), (5, "other text"), (None, "lonely words in a row, six")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.digest(docs_of(rows)).collect()), key=str)
    want = sorted([(7, 8, 3, False), (7, 8, 3, False), (None, 8, 3, False), (3, 8, 3, True), (5, 0, 5, True), (5, 1, 5, True), (None, 2, None, False)], key=str)
    assert got == want
    kept = minhash.keep_first(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and kept.count() == 4
    assert minhash.digest(docs_of([])).count() == 0


def test_full_sets_meet_outside_of_arrow_batches(spark):
    # A hub of many pairs: with their sets in Arrow batches, an executor took over 3000 MB.
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) - (1 << 62) for _ in range(400)]
    sets = [(0, base)] + [(k, base[k:] + [rnd.getrandbits(63) - (1 << 62) for _ in range(k)]) for k in range(1, 60)]
    pairs = spark.createDataFrame([(0, k) for k in range(1, 60)], "u long, v long")
    found = minhash._confirmed(pairs, spark.createDataFrame(sets, "r long, h array<long>"), 85)
    want = [k for k in range(1, 60) if 100 * (400 - k) >= 85 * (400 + k)]
    assert sorted(r.v for r in found.collect()) == want and 0 < len(want) < 59
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 1.0):
        both = rng.integers(0, 1 << 63, int(900 * share), dtype=np.uint64)
        a = np.concatenate([both, rng.integers(0, 1 << 63, 900 - len(both), dtype=np.uint64)])
        b = np.concatenate([both, rng.integers(0, 1 << 63, 900 - len(both), dtype=np.uint64)])
        k = minhash.registers(np.concatenate([a, b, a, b]), np.array([0, 900, 1800]))
        assert (np.maximum(k[0], k[1]) == k[2]).all()
        true = len(both) / (1800 - len(both))
        assert abs(minhash.joint(k[:1], k[1:2], np.array([900.0]), np.array([900.0]))[0] - true) < 0.17
    assert minhash.miss_probability(0.8) < 1e-7


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 4), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
