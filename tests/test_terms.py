"""Counting terms within rows, against plain Python, and searches built on it."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from loomdex import catalog
from loomdex.functions import terms
from loomdex.operators import bm25

ROWS = [
    (1, "The cat, the CAT and a dog2"),
    (2, ""),
    (3, None),
    (4, "x" * 5000 + " end"),
    (5, "中文检索 and 日本 字 한국어 cat"),
    (6, "é cat— caté 1 22"),
    (7, "a b c"),
    (8, "cat\n\tdog  cat"),
]


def plain(t):
    out = []
    for w in re.findall("[가-힣ᄀ-ᇿ㄰-㆏一-鿿㐀-䶿぀-ヿ豈-﫿]+|[a-z0-9]{2,}", "".join(c.lower() if c.isascii() else c for c in t or "")):
        out += [w] if w[0].isascii() or len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)]
    return Counter(out)


def test_counts_equal_plain_python(monkeypatch):
    rnd = random.Random(3)
    bits = ["ab", "Ab", "c", " ", ".", "é", "中", "文", "12", "x9", "—", "\n"]
    rows = [t for _, t in ROWS] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(80))) for _ in range(200)]
    for group in (1 << 20, 64):
        monkeypatch.setattr(terms, "GROUP", group)
        for column in (pa.array(rows, pa.string()), pa.array(["skip", *rows], pa.string()).slice(1)):
            got = {}
            for i, j, c in terms.counted(column):
                words = c.strings().to_pylist()
                for k in range(i, j):
                    got[k] = Counter(c.wide.get(k - i, {}))
                for r, w, n, h in zip(c.row, words, c.tf, c.hash):
                    got[i + r][w] += int(n)
                    assert terms.hash_of(w) == h
                assert [got[k].total() for k in range(i, j)] == c.lengths.tolist()
            assert [got[k] for k in range(len(rows))] == [plain(t) for t in rows]


def test_postings_and_lengths(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.term): r.tf for r in bm25.postings(docs).collect()}
    assert got == {(i, w): n for i, t in ROWS for w, n in plain(t).items()}
    assert {r.doc_id: r.doc_len for r in bm25.doc_lengths(docs).collect()} == {i: plain(t).total() for i, t in ROWS}
    plan = bm25.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, "only the repartition of this test"


@pytest.mark.parametrize("most", [1024, 2])
def test_scan_of_many_queries_equals_the_join(spark, monkeypatch, most):
    rnd = random.Random(1)
    words = ["cat", "dog", "owl", "中文", "ant", "bee"]
    rows = ROWS + [(100 + k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for k in range(300)]
    rows += [(900, "cat dog"), (901, "cat dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([("a", "cat owl cat"), ("b", "中文 dog"), ("c", "nothing here"), ("d", None), ("e", "bee ant dog cat")], "query_id string, text string")
    monkeypatch.setattr(bm25, "QUERIES", most)
    key = lambda df: [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    got = key(bm25.search_texts(docs, queries, 7))
    assert got and got == key(bm25.search_batch(bm25.postings(docs), bm25.doc_lengths(docs), queries, 7))
    one = bm25.search(docs, "bee ant dog cat", 7).collect()
    assert [r.doc_id for r in one] == [d for q, _, d, _ in got if q == "e"]
    assert bm25.search_texts(docs, queries.limit(0)).count() == 0 and bm25.search_texts(docs, queries, 0).count() == 0


def test_hidden_vectors_leave_the_equivalent_sql(spark):
    assert "v0 AS" in catalog.ORACLE_SQL["hybrid_visible"] and "FROM v0 WHERE" in catalog.ORACLE_SQL["hybrid_visible"]


def test_counting_holds_little_beyond_the_text():
    text = " ".join(f"word{k}" for k in range(100))
    for column, most in ((pa.array([text] * 5000), 16e6), (pa.array([" ".join([text] * 5000)]), 80e6)):
        tracemalloc.start()
        n = sum(int(c.lengths.sum()) for _, _, c in terms.counted(column))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 500_000 and peak < most
