"""Embedding links against all pairs."""

import math

import numpy as np
import pytest

from loomdex.llm import embedding

SCHEMA = "vec_id long, embedding array<float>, label int, r long, u string, m int"


def brute(rows, cosine):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.float32(v).astype(float) if ok else None
        unit.append(None if x is None else x / np.sqrt(x @ x))
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, links[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def vectors(seed):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.normal(size=(6, 8)):
        for scale in (0, 0.01, 0.05, 0.1, 0.2):
            out += [base + scale * rng.normal(size=8) for _ in range(8)]
    out += list(rng.normal(size=(80, 8)))
    walk = rng.normal(size=8)
    for _ in range(30):  # a chain whose ends are far apart
        walk = walk / np.linalg.norm(walk) + 0.12 * rng.normal(size=8)
        out.append(walk)
    rows = [[float(x) for x in v] for v in out]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[1]], None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1.0, 0.0], [1.0, 0.1]]
    order = rng.permutation(len(rows))
    return [(1000 + k, rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("chunk", "cosine"), [(4096, 0.95), (32, 0.95), (50, 0.8)])
def test_links_equal_all_pairs(spark, chunk, cosine):
    rows = vectors(chunk)
    df = spark.createDataFrame([(i, v, 1, 5, "x", 9) for i, v in rows], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding.link(df, cosine=cosine, chunk=chunk).collect()), key=str)
    assert got == brute(rows, cosine)


def test_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(4, v), (4, v), (None, v), (2, v), (7, w), (None, None)]
    df = spark.createDataFrame([(i, x, 1, 5, "x", 9) for i, x in rows], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.link(df).collect()), key=str)
    want = [(4, 3, 2, False), (4, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (7, 0, 7, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert embedding.link(df.limit(0)).count() == 0


def test_tree_invariants():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(700, 5))
    u /= np.linalg.norm(u, axis=1)[:, None]
    tree = embedding.CoverTree(u)
    for level, (centre, parent, cover) in enumerate(tree.levels):
        assert (cover <= embedding.RADII[level] + 1e-9).all()
        seen = np.concatenate([tree.members(level, k) for k in range(len(centre))])
        assert sorted(seen) == list(range(700))
        for k in (0, len(centre) // 2, len(centre) - 1):
            mine = tree.members(level, k)
            assert np.linalg.norm(u[mine] - u[centre[k]], axis=1).max() <= cover[k] + 1e-9
            brothers = centre[parent == parent[k]]
            gaps = np.linalg.norm(u[brothers] - u[centre[k]], axis=1)
            assert (gaps[brothers != centre[k]] > embedding.RADII[level] - 1e-9).all()


def test_any_number_of_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim in range(1, 1201):
        base = rng.normal(size=dim)
        rows += [(10 * dim + k, [float(x) for x in (base if k < 2 else rng.normal(size=dim))]) for k in range(2)]
    rows += [(50_000 + k, [float(x) for x in rng.normal(size=4)]) for k in range(60)]
    df = spark.createDataFrame([(i, v, 1, 5, "x", 9) for i, v in rows], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding.link(df, chunk=20).collect()), key=str)
    assert got == brute(rows, 0.95)


def test_chunks_are_read_and_not_copied_for_each_pair(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x[1200:] = x[:300] + 0.03 * rng.normal(size=(300, 64))
    df = spark.createDataFrame([(k, [float(a) for a in v], 1, 5, "x", 9) for k, v in enumerate(x)], SCHEMA)
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.link(df, chunk=50).collect())
    took = shuffled() - before
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    assert got == [(k, int(linked[k].sum()) - 1, int(linked[k].argmax())) for k in range(1500)]
    assert took < 5 * u.nbytes, took / u.nbytes  # 9.0 times with a copy for each pair of chunks


@pytest.mark.parametrize("noise", [0.0, 0.05, 0.3, 3.0])
def test_filter_loses_no_pair(noise):
    rng = np.random.default_rng(3)
    x = np.concatenate([b + noise * rng.normal(size=(100, 40)) for b in rng.normal(size=(6, 40))] + [rng.normal(size=(300, 40))])
    x *= np.linspace(3, 0.2, 40)  # some directions carry most
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    for cosine in (0.5, 0.95):
        frame = embedding._frame(u, cosine)
        exact = u @ u.T
        want, sure = np.triu(exact >= cosine, 1), np.abs(exact - cosine) > 1e-12
        for f in (frame, None):
            rows, got = embedding._filtered(u, f), np.zeros((900, 900), bool)
            for i, j in embedding._close(u, u, rows, rows, True, cosine):
                got[i, j] = True
            assert (got == want)[sure].all()
        one = np.arange(900), np.ones(900, np.int64), u, embedding._filtered(u, frame)
        r, links, _ = embedding.meet(one, one, True, cosine)
        assert links.sum() == 2 * want.sum() and len(r) <= 900
