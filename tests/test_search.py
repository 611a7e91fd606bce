import math
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomdex import catalog
from loomdex.errors import InvalidArgument, LimitExceeded
from loomdex.operators import bm25, filters, hybrid, vector


def brute(rows, query):
    toks = {i: re.findall("[a-z0-9]{2,}", (t or "").lower()) for i, t in rows}
    n, avg = len(rows), sum(map(len, toks.values())) / len(rows)
    out = {}
    for i, w in toks.items():
        tf = Counter(w)
        s = 0.0
        for q in sorted(set(re.findall("[a-z0-9]{2,}", query.lower()))):
            df = sum(q in x for x in toks.values())
            if tf[q]:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[q] * 2.2 / (tf[q] + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(0)
    return [(k, " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rnd.randrange(12)))) for k in range(60)] + [(90, ""), (91, None), (92, "x" * 2001 + " aa aa"), (93, "aa bb"), (94, "aa bb")]


def test_bm25_equals_the_formula(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for query in ("aa", "bb aa BB", "zz", "x" * 2001, "cc dd ee zz", "?"):
        want = brute(rows, query)[:10]
        got = [(r.doc_id, r.score) for r in bm25.search(docs, query, 10).collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want))
    queries = spark.createDataFrame([(1, "aa"), (2, "bb aa BB"), (3, "zz")], "query_id long, text string")
    batch = bm25.search_batch(bm25.postings(docs), bm25.doc_lengths(docs), queries, 10).collect()
    for q, text in ((1, "aa"), (2, "bb aa BB")):
        assert [r.doc_id for r in sorted(batch, key=lambda r: r.rank) if r.query_id == q] == [i for i, _ in brute(rows, text)[:10]]
    some = spark.createDataFrame([(93,), (94,)], "doc_id long")
    only = bm25.search(docs, "aa", 1, some).collect()
    assert [r.doc_id for r in only] == [93] and abs(only[0].score - dict(brute(rows, "aa"))[93]) < 1e-12


def test_empty_corpora(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.search(none, "aa").count() == 0 and bm25.corpus_stats(bm25.doc_lengths(none)).first() == (0, 0.0)
    assert bm25.search(spark.createDataFrame([(1, "")], "doc_id long, text string"), "aa").count() == 0
    assert bm25.search(none, "aa", 0).count() == 0
    with pytest.raises(InvalidArgument):
        bm25.search(none, "aa", 10_001)


def test_vectors(spark):
    rows = [(i, [x, 0.0, 0.0, 0.0]) for i, x in ((1, 0.0), (2, 10.0), (3, 1.0), (20, 2.0), (19, 2.0))] + [(4, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector.search(v, [0, 0, 0, 0], 4).collect()] == [(1, 0.0), (3, 1.0), (19, 4.0), (20, 4.0)]
    hidden = F.col("id") != 1
    assert [r.id for r in vector.search(v, [0, 0, 0, 0], 2, visible=hidden).collect()] == [3]
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert [r.id for r in vector.search(v, [0, 0, 0, 0], 2, ids, hidden).collect()] == [3, 2]
    with pytest.raises(InvalidArgument):
        vector.search(v, [math.nan])


def test_fusion(spark):
    docs = spark.createDataFrame([(30, "same text"), (31, "same text"), (32, "same text")], "doc_id long, text string")
    v = spark.createDataFrame([(30, [2.0]), (31, [1.0]), (32, [0.0])], "vec_id long, embedding array<float>")
    top = lambda **o: hybrid.explain(docs, v, "same text", [0.0], **o).first()
    assert top(k=1, candidate_k=1).doc_id == 30
    best = top(k=1, candidate_k=2)
    assert best.doc_id == 31 and abs(best.score - 2 / 62) < 1e-12 and best.source == "bm25+vector"
    best = top(k=1, candidate_k=2, bm25_weight=2.0, rrf_k=10)
    assert best.doc_id == 31 and abs(best.score - 0.25) < 1e-12
    assert top(bm25_weight=0.0).doc_id == 32 and top(vector_weight=0.0).source == "bm25"
    for bad in ({"bm25_weight": 0.0, "vector_weight": 0.0}, {"rrf_k": 0}, {"bm25_weight": math.inf}):
        with pytest.raises(InvalidArgument):
            top(**bad)
    twice = spark.createDataFrame([(5, 0.0), (6, 1.0), (5, 2.0)], "id long, distance double")
    assert {r.doc_id: r.vector_rank for r in hybrid.fuse(None, twice, 10).collect()} == {5: 3, 6: 2}
    meta = spark.createDataFrame([(30, "u", 9)], "doc_id long, target_uri string, text_len int")
    hits = hybrid.with_metadata(hybrid.search(docs, v, "same text", [0.0]), meta, ("target_uri", "text_len")).collect()
    assert {r.doc_id: (r.target_uri, r.text_len) for r in hits} == {30: ("u", 9), 31: (None, 0), 32: (None, 0)}


def test_filters(spark):
    f = filters.SearchFilter.parse('{"domain": "Ex.Test", "from": "2026-01-01T00:00:00Z", "to": "2026-01-02T00:00:00+00:00"}')
    rows = [(10, "ex.test", "2026-01-01 00:00:00"), (11, "ex.test", "2026-01-02 00:00:00"), (12, "ex.test", "2026-01-02 00:00:01"), (13, "other", "2026-01-01 00:00:00")]
    meta = spark.createDataFrame(rows, "doc_id long, domain string, d string").withColumn("warc_date", F.col("d").cast("timestamp"))
    assert {r.doc_id for r in filters.eligible_ids(meta, f).collect()} == {10, 11}
    many = spark.range(10_001).select(F.col("id").alias("doc_id"), F.lit("many.test").alias("domain"))
    with pytest.raises(LimitExceeded):
        filters.eligible_ids(many, filters.SearchFilter.parse({"domain": "many.test"}))
    for bad in ({}, {"x": "y"}, {"domain": 1}, {"domain": "a b"}, {"from": "2026-01-01T00:00:00"}, {"from": "2026-01-02T00:00:00Z", "to": "2026-01-01T00:00:00Z"}):
        with pytest.raises(InvalidArgument):
            filters.SearchFilter.parse(bad)


@pytest.fixture(scope="module")
def many(spark):
    """A corpus whose filter admits more documents than `eligible_ids` lists, as folder for the queries."""
    root = tempfile.mkdtemp(prefix="loomdex-many-")
    n = F.col("id")
    docs = spark.range(50_000).select(n.alias("doc_id"), F.when(n % 7 == 0, "the word with ing").otherwise("the word of text").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.range(200).select(n.alias("vec_id"), F.array_repeat(n.cast("float"), 64).alias("embedding")).write.parquet(f"{root}/embeddings.parquet")
    assert filters.predicate(catalog.metadata(spark, root), filters.SearchFilter.parse(catalog._EN_FILTER)).count() > filters.MAX_ELIGIBLE
    return root


def test_a_filter_of_many_documents_is_searched_whole(spark, many):
    got = catalog.QUERIES["hybrid_filtered"](spark, many).collect()
    assert [(r.doc_id, r.bm25_rank, r.vector_rank) for r in got] == [(28 + 7 * j, 1 + j, 5 + 7 * j) for j in range(10)]


def test_filtered_explain_with_metadata_is_searched_whole(spark, many):
    got = catalog.QUERIES["hybrid_filtered_explain_metadata"](spark, many).collect()
    assert sorted((r.doc_id, r.bm25_rank, r.vector_rank, r.domain) for r in got) == [(28 + 7 * j, 1 + j, 5 + 7 * j, "src1.example") for j in range(10)]


def test_filtered_search_with_metadata_is_searched_whole(spark, many):
    got = catalog.QUERIES["hybrid_metadata"](spark, many).collect()
    assert sorted(r.doc_id for r in got) == [24, 25, 26, 27, 28, 29, 35, 42, 49, 56] and {r.domain for r in got} == {"src1.example"}
