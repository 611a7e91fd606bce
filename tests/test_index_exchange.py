import json

import pytest

from loomdex.errors import InvalidArgument, StateConflict
from loomdex.operators import bm25, quality
from loomdex.plans.index import StoredIndex, keyed_postings
from loomdex.sources import exchange


def test_stored_index_searches_like_a_scan(spark, tmp_path):
    rows = [(k, " ".join(["aa"] * (k % 4) + ["bb"] * (k % 3) + ["cc"] * (k % 5))) for k in range(40)] + [(99, ""), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = StoredIndex(spark, str(tmp_path))
    with pytest.raises(StateConflict):
        index.search("aa")
    index.build(docs)
    for query in ("aa", "cc bb", "zz"):
        assert [tuple(r) for r in index.search(query).collect()] == [tuple(r) for r in bm25.search(docs, query).collect()]
    change = spark.createDataFrame([(0, "aa aa zz"), (200, "zz")], "doc_id long, text string")
    index.update(change)
    now = spark.createDataFrame([r for r in rows if r[0] != 0] + [(0, "aa aa zz"), (200, "zz")], "doc_id long, text string")
    for query in ("aa", "zz"):
        assert [r.doc_id for r in index.search(query).collect()] == [r.doc_id for r in bm25.search(now, query).collect()]
    plan = index.search("aa bb")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [Or" in plan or "In(term, [aa,bb])" in plan


def test_index_build_counts_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, "aa " * (k % 4) + "bb " * (k % 3) + "x" * 3000 * (k % 2)) for k in range(40)] + [(98, None), (99, ""), (97, "日本 aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = StoredIndex(spark, str(tmp_path))
    name = index.build(docs.mapInArrow(read, docs.schema))
    assert seen.value == len(rows) and not (tmp_path / name / "counted").exists()
    assert index.table("lengths").count() == len(rows) and index.table("postings").select("doc_id", "doc_len").distinct().count() == 37
    assert sorted(index.table("terms").collect()) == sorted(bm25.doc_frequency(keyed_postings(docs)).collect())


def test_embeddings_are_checked_whole(spark, tmp_path):
    def file(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    wanted = spark.createDataFrame([(1,), (2,)], "doc_id long")
    good = file("a", [{"doc_id": 1, "vector": [1, 0]}, {"id": 2, "vector": [0.6, 0.8]}])
    assert exchange.read_embeddings(spark, good, 2, wanted, True).count() == 2
    for k, rows in enumerate([[{"id": 1, "vector": [1, 0]}], [{"id": 1, "vector": [1]}, {"id": 2, "vector": [0, 1]}], [{"id": 1, "vector": [1, 0]}] * 2, [{"vector": [1, 0]}], [{"id": 1, "vector": [1e39, 0]}, {"id": 2, "vector": [0, 1]}]]):
        with pytest.raises(InvalidArgument):
            exchange.read_embeddings(spark, file(f"b{k}", rows), 2, wanted)
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: list(r.vector) for r in exchange.embed(docs, lambda ts: [[float(len(t))] for t in ts], 1).collect()}
    assert out == {1: [2.0], 2: [0.0]}
    exchange.write_records(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_quality_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 11, 3), (1, 12, 4), (2, 5, 1)], "query_id long, doc_id long, rank int")
    labels = spark.createDataFrame([(1, 11), (1, 12), (2, 9), (3, 1)], "query_id long, doc_id long")
    got = {r.query_id: r for r in quality.metrics(hits, labels, 4).collect()}
    import math

    ideal = 1 + 1 / math.log2(3)
    assert got[1].hit and got[1].reciprocal_rank == 0.5 and got[1].recall == 1.0
    assert abs(got[1].ndcg - (1 / math.log2(3) + 1 / math.log2(5)) / ideal) < 1e-12
    assert not got[2].hit and got[3].ndcg == 0.0
    mean = quality.summary(quality.metrics(hits, labels, 4)).first()
    assert mean.queries == 3 and abs(mean.mrr - 0.5 / 3) < 1e-12
    with pytest.raises(InvalidArgument):
        quality.metrics(hits, labels, 0)
