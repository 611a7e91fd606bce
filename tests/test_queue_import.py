"""Concurrent queues, guards, deletes through all places; importer policies and balances."""

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from loomdex.errors import InvalidArgument, NotPermitted, StateConflict
from loomdex.functions import text
from loomdex.operators import audit, hybrid, quality, vector
from loomdex.plans.collections import Manifest
from loomdex.plans.index import StoredIndex
from loomdex.sources import exchange, formats, warc
from loomdex.sources.store import Policy, VectorStore, leased
from loomdex.streaming import queue

R1, R2 = "a" * 64, "b" * 64


@pytest.fixture
def box(spark, tmp_path):
    s = VectorStore(spark, Policy(str(tmp_path), allow_destructive=True))
    uri = f"{tmp_path}/set"
    s.create(uri, 2)
    return s, uri, queue.Outbox(s, f"{tmp_path}/outbox.json", guard=True), tmp_path


def test_jobs_queued_while_one_is_applied_stay(spark, box):
    s, uri, q, _ = box
    q.enqueue(uri, [1], [[0, 0]], None, [R1], now=0)

    def slow(job):
        q.enqueue(uri, [2], [[1, 1]], None, [R1], now=0)
        assert q.process_next(10) is None, "the data set's first job is under lease"
        return 7

    assert q.process_next(10, slow)["applied_version"] == 7
    assert [r.job_id for r in q.jobs().orderBy("job_id").collect()] == [1, 2]
    assert q.process_next(10)["job_id"] == 2 and [r.id for r in s.read(uri).collect()] == [2]


def test_a_lost_lease_is_taken_over(box):
    s, uri, q, root = box
    q.enqueue(uri, [1], [[0, 0]], now=0)

    def dies(job):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        q.process_next(10, dies, lease_s=-1)
    assert q.process_next(10)["state"] == "completed"
    at = root / "x.lock"
    at.write_text(json.dumps({"owner": "killed", "until": time.time() - 1}))
    with leased(at, wait_s=1) as check:
        check()
        with pytest.raises(StateConflict), leased(at, wait_s=0.1):
            pass
        at.write_text(json.dumps({"owner": "other", "until": time.time() + 9}))
        with pytest.raises(StateConflict):
            check()


def test_guards_and_deletes(spark, box):
    s, uri, q, root = box
    rows = spark.createDataFrame([(5, [0.0, 0.0], "a")], "id long, vector array<float>, label string")
    s.append(uri, rows)
    q.enqueue(uri, [1, 2], [[0, 0], [1, 1]], ["x", "y"], [R1, R1], now=0)
    for write in (lambda: s.append(uri, rows), lambda: s.upsert(uri, rows), lambda: s.delete(uri, rows), lambda: s.restore(uri, 1)):
        with pytest.raises(StateConflict):
            write()
    q.process_next(1)
    s.upsert(uri, rows)
    with pytest.raises(StateConflict):
        s.delete(uri, spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(StateConflict):
        q.enqueue(uri, [1], [[3, 3]])
    docs = spark.createDataFrame([(1, "cat one"), (2, "cat two")], "doc_id long, text string")
    index = StoredIndex(spark, str(root / "index"))
    index.build(docs)
    job, left = q.delete_documents(uri, [1], [R1], index, docs)
    assert job == 2 and [r.doc_id for r in left.collect()] == [2]
    assert [r.doc_id for r in index.search("cat").collect()] == [2] and index.search("one").count() == 0
    assert [r.id for r in s.search(uri, [0.0, 0.0], 5, state=q.state()).collect()] == [5, 2]
    assert [r.label for r in s.search(uri, [0.0, 0.0], 5).collect()][0] in ("a", "x")
    with pytest.raises(InvalidArgument):
        s.search(uri, [0.0], 5)
    hits = hybrid.search(docs, s.read(uri).withColumnsRenamed({"id": "vec_id", "vector": "embedding"}), "zz", [0.0, 0.0], 5, state=q.state())
    assert {r.doc_id for r in hits.collect()} == {5, 2}
    some = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [r.id for r in vector.search(s.read(uri), [0.0, 0.0], 1, some, id_col="id", vec_col="vector", state=q.state()).collect()] == [2]


def test_stale_chunks_become_jobs(spark, box):
    s, uri, q, _ = box
    q.enqueue(uri, [1, 2, 3], [[0, 0]] * 3, None, [R1, R2, R1], now=0)
    stored = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "doc_id long, parent_doc_id long")
    fresh = spark.createDataFrame([(2, 9)], "doc_id long, parent_doc_id long")
    assert q.reconcile_chunks(uri, stored, fresh, now=0) == [2] and q.reconcile_chunks(uri, stored, fresh) == []
    assert {r.doc_id for r in q.state().filter("is_deleted").collect()} == {1, 3}
    assert json.loads(audit.inventory(q.jobs()).first().jobs) == [{"job_id": 1, "state": "pending", "attempts": 0}, {"job_id": 2, "state": "pending", "attempts": 0}]
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (4, "b")], "doc_id long, label string")
    v = spark.createDataFrame([(1, R1, "z")], "id long, revision string, label string")
    row = audit.findings(docs, docs, v, q.state(), q.jobs(), 5.0).first()
    assert (row.duplicate_document, row.stale_label, row.row_count_mismatch, row.deleted_but_present, row.deleted_metadata) == (1, 2, 1, 1, 2)
    assert (row.unfinished_jobs, row.pending_jobs, row.ready_jobs, row.failed_jobs) == (2, 2, 1, 0)


def record(kind, uri, block, extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n{extra}\r\n".encode() + block + b"\r\n\r\n"


def http(kind, body, extra=""):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n{extra}\r\n".encode() + body


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


WORD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'


def test_reader_goes_on_after_a_bad_record(spark, tmp_path):
    good = record("response", "http://a.test/", http("text/plain", b"one"))
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nbroken\r\n\r\n"
    tags = record("response", "http://l.test/", http("text/plain", b"t", "Content-Language: " + ",".join("abcdefghi") + "\r\n"))
    word = record("response", "http://w.test/", http("application/octet-stream", docx(WORD)))
    bomb = record("response", "http://b.test/", http(formats.DOCX, docx("<w>" + "x" * 3_000_000 + "</w>")))
    evil = record("response", "http://e.test/", http(formats.DOCX, docx("<!DOCTYPE x><w/>")))
    page = record("response", "http://p.test/", http("", b"<html><p>hi</p>"))
    (tmp_path / "a.warc").write_bytes(good + bad + good + tags + word + bomb + evil + page)
    rows = warc.read(spark, f"{tmp_path}/a.warc")
    got = rows.orderBy("ordinal").collect()
    assert [r.status for r in got] == ["imported", "failed", "imported", "failed", "imported", "failed", "failed", "imported"]
    assert got[4].text == "First line two" and got[4].media_type == formats.DOCX and got[7].media_type == "text/html"
    assert warc.balance(rows).first().balanced and warc.read(spark, f"{tmp_path}/a.warc", most=2).count() == 2
    first = warc.archive_fingerprint(rows).first().digest
    assert first == warc.archive_fingerprint(rows.repartition(5)).first().digest
    assert not warc.balance(rows.filter("ordinal <> 3")).first().balanced


def test_charset_policy():
    policy = formats.Charsets({"X-Mac": "cp1252"}, {"<urn:1>": "utf-8"})
    assert policy.decode("naïve".encode("cp1252"), "x-mac") == ("naïve", "cp1252", 0)
    assert policy.decode(b"\xff a", "latin-1", "<urn:1>") == ("� a", "utf-8", 1)
    assert policy.decode("ก".encode("cp874"), "Windows-874")[0] == "ก"
    with pytest.raises(UnicodeDecodeError):
        formats.Charsets({"x": "ascii"}).decode(b"\xff", "x")
    with pytest.raises(ValueError):
        formats.Charsets({"x": "zip"})
    assert formats.sniffed(b"%PDF-1.7") == "application/pdf" and formats.sniffed(b"plain") is None


def test_resumed_import_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(record("response", "http://a.test/", http("text/plain", b"one two three four")))
    done = str(tmp_path / "done")
    assert warc.resume(spark, f"{tmp_path}/in", done).count() == 1
    (tmp_path / "in/b.warc").write_bytes(record("response", "http://b.test/", http("text/plain", b"five")))
    again = warc.resume(spark, f"{tmp_path}/in", done)
    assert {r.target_uri for r in again.collect()} == {"http://a.test/", "http://b.test/"}
    assert warc.resume(spark, f"{tmp_path}/in", done).count() == 2 and warc.resume(spark, f"{tmp_path}/in", done, min_chars=9).count() == 2
    parts = warc.chunked(again, 10, 2).orderBy("target_uri", "chunk_index").collect()
    whole = {r.target_uri: r for r in again.collect()}
    a = [r for r in parts if r.target_uri == "http://a.test/"]
    assert len(a) > 1 and len({r.revision for r in a}) == len(a) and len({r.doc_id for r in a}) == len(a)
    b = parts[-1]
    assert (b.doc_id, b.revision) == (whole["http://b.test/"].doc_id, whole["http://b.test/"].revision)
    with pytest.raises(Exception, match="more than"):
        warc.chunked(spark.createDataFrame([("x" * 30_000,)], "text string").select("text", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in warc.SCHEMA.split(", ")) if n != "text")), 2, 0).count()


def test_manifest_paths_and_locks(tmp_path):
    (tmp_path / "gen").mkdir()
    m = Manifest(str(tmp_path / "m.json"), root=str(tmp_path / "gen"))
    m.create("c", {"a": 1})
    for bad in ("/etc/x", f"{tmp_path}/gen/../x"):
        with pytest.raises(NotPermitted):
            m.stage(bad, 1, {"a": 1})
    m.stage(f"{tmp_path}/gen/1", 1, {"a": 1})
    m.prepare(1)
    m.activate()
    assert m.resolve() == f"{tmp_path}/gen/1" and not list(tmp_path.glob("*.lock"))


def test_methods_fixtures_and_clients(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_id long, rank int")
    labels = spark.createDataFrame([(1, 11), (2, 12)], "query_id long, doc_id long")
    got = {r.method: r.mrr for r in quality.compare_methods({"bm25": hits, "vector": hits.filter("query_id = 2")}, labels, 5).collect()}
    assert got == {"bm25": 0.75, "vector": 0.5}
    with pytest.raises(InvalidArgument):
        quality.compare_methods({"other": hits}, labels, 5)
    model = exchange.remote(lambda texts: [{"index": k, "embedding": [float(len(t))]} for k, t in reversed(list(enumerate(texts)))])
    assert model(["a", "bbb"]) == [[1.0], [3.0]]
    with pytest.raises(ValueError):
        exchange.remote(lambda texts: [])(["a"])
    docs, v = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<float>")
    q, qv = spark.createDataFrame([(5, "q")], "query_id long, text string"), spark.createDataFrame([(5, [2.0])], "query_id long, vector array<float>")
    assert [x.count() for x in exchange.quality_fixture(docs, v, q, qv)] == [1, 1]
    with pytest.raises(InvalidArgument):
        exchange.quality_fixture(docs, v.limit(0), q, qv)
    row = spark.range(1).select(text.utc_timestamp(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("t"), text.label_matches("CAT", F.lit("a"), F.lit("Cats")).alias("m")).first()
    assert row == ("2026-01-02T03:04:05Z", True)
