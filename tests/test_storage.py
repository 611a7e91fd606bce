import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from loomdex.errors import InvalidArgument, LimitExceeded, NotPermitted, NullArgument, StateConflict
from loomdex.operators import audit
from loomdex.plans.collections import Manifest, pending_records
from loomdex.sources import warc
from loomdex.sources.store import Policy, VectorStore
from loomdex.streaming import queue

ROWS = "id long, vector array<float>, label string"


@pytest.fixture
def store(spark, tmp_path):
    s = VectorStore(spark, Policy(str(tmp_path), allow_destructive=True))
    s.create(f"{tmp_path}/set", 2)
    return s, f"{tmp_path}/set", tmp_path


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions(spark, store):
    s, uri, root = store
    assert s.insert_flat(uri, [1, 2], [0, 1, 2, 3], 2, ["a", None]) == 2
    s.append(uri, spark.createDataFrame([(3, [4.0, 5.0], "c")], ROWS))
    v = s.upsert(uri, spark.createDataFrame([(2, [9.0, 9.0], "new"), (4, [0.0, 0.0], None)], ROWS))
    assert ids(s.read(uri)) == [1, 2, 3, 4] and s.read(uri).filter("id = 2").first().label == "new"
    s.delete(uri, spark.createDataFrame([(1,)], "id long"))
    assert ids(s.read(uri)) == [2, 3, 4] and ids(s.read(uri, v)) == [1, 2, 3, 4] and ids(s.read(uri, 2)) == [1, 2]
    assert s.restore(uri, 2) == 2 and ids(s.read(uri)) == [1, 2]
    assert [r.event for r in s.write_log(uri).collect()] == ["create", "append", "append", "upsert", "delete", "restore"]
    assert s.versions(uri).count() == 6 and s.count(uri) == 2 and s.dim(uri) == 2
    assert s.scan_state(uri).columns == ["doc_id", "label", "revision"]
    s.append(uri, spark.createDataFrame([(1, [0.0, 0.0], "again")], ROWS))
    with pytest.raises(StateConflict):
        s.upsert(uri, spark.createDataFrame([(1, [0.0, 0.0], "x")], ROWS))
    for bad in ([(None, [0.0, 0.0], "x")], [(7, [0.0], "x")], [(7, [float("nan"), 0.0], "x")]):
        with pytest.raises((InvalidArgument, NullArgument)):
            s.append(uri, spark.createDataFrame(bad, ROWS))
    for bad in ("rel/path", f"{root}/../x", f"{root}/a%2f", "/etc/x"):
        with pytest.raises(NotPermitted):
            s.policy.resolve(bad)


def test_queue(spark, store):
    s, uri, root = store
    box = queue.Outbox(s, f"{root}/outbox.json")
    r1, r2 = "a" * 64, "b" * 64
    box.enqueue(uri, [1, 2], [[0, 0], [1, 1]], None, [r1, r1], now=0)
    box.enqueue(uri, [1], [[5, 5]], None, [r2], now=0)
    with pytest.raises(StateConflict):
        box.guard_direct_write(uri)

    def broken(job):
        raise RuntimeError("x" * 5000)

    assert box.process_next(10, broken)["state"] == "pending"
    assert box.process_next(10) is None, "the failed job waits and blocks the later one"
    assert box.process_next(12)["job_id"] == 1 and box.process_next(12)["job_id"] == 2
    assert s.read(uri).filter("id = 1").first().revision == r2
    for bad in (([3], [r1]), ([1], [r1])):
        with pytest.raises(StateConflict):
            box.delete(uri, *bad)
    job = box.delete(uri, [1], [r2], now=12)
    assert job == 3 and box.delete(uri, [1], [r2]) == 0
    rows = s.read(uri).select(F.col("id").alias("doc_id"), "revision")
    assert [r.doc_id for r in queue.visible_rows(rows, box.state()).collect()] == [2]
    docs = spark.createDataFrame([(2,)], "doc_id long")
    found = {(r.doc_id, r.finding) for r in audit.reconcile(docs, docs, s.read(uri), box.state()).collect()}
    assert found == {(1, "deleted_but_present")}
    assert box.process_next(12)["state"] == "completed" and ids(s.read(uri)) == [2]
    assert queue.status(box.jobs()).first().completed == 3 and queue.failures(box.jobs()).count() == 0
    box.enqueue(uri, [9], [[0, 0]], now=0)
    at = 100.0
    for _ in range(8):
        at += 10_000
        last = box.process_next(at, broken)
    assert last["state"] == "failed" and box.process_next(at + 10_000) is None


def test_stream_drains_in_order_and_replays(spark, store):
    s, uri, root = store
    changes = [(1, "upsert", 1, [0.0, 0.0], "old", None), (2, "upsert", 2, [1.0, 1.0], "b", None), (3, "upsert", 1, [2.0, 2.0], "new", None), (4, "delete", 2, None, None, None)]
    spark.createDataFrame(changes, queue.CHANGE).coalesce(1).write.json(f"{root}/changes")
    for checkpoint in ("c1", "c2"):  # the second one applies the same changes again
        q = queue.drain_stream(s, uri, spark.readStream.schema(queue.CHANGE).json(f"{root}/changes"), f"{root}/{checkpoint}")
        assert q.awaitTermination(120)
    assert [(r.id, r.label) for r in s.read(uri).collect()] == [(1, "new")]


def archive():
    def rec(kind, uri, body, head=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n{head}\r\n".encode() + body + b"\r\n\r\n"

    page = "<p>Café &amp; bar</p><script>x()</script><style>y</style> end".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Language: EN , fr\r\n"
    good = http + b"\r\n" + page
    chunked = http + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    packed = gzip.compress(page)
    chunked += f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n"
    return b"".join([rec("warcinfo", "x:", b"info"), b"junk line\r\n", rec("response", "http://Ex.COM./a", good), rec("response", "http://b.test/", chunked), rec("response", "http://c.test/", http + b"Transfer-Encoding: chunked\r\n\r\nzz\r\n"), rec("resource", "http://d.test/i.png", b"\x89PNG")])


def test_archives(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(archive())
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(archive()))
    (tmp_path / "c.warc").write_bytes(archive()[:-30])
    rows = warc.read(spark, f"{tmp_path}/*.warc*").collect()
    mine = [r for r in rows if r.source_file.endswith("a.warc")]
    assert [r.status for r in mine] == ["policy_skipped", "imported", "imported", "failed", "metadata_only"]
    assert mine[1].text == mine[2].text == "Café & bar end" and mine[1].domain == "ex.com" and mine[1].content_language == "en,fr"
    assert [tuple(r)[:13] for r in rows if r.source_file.endswith("gz")] == [tuple(r)[:13] for r in mine]
    assert [r.status for r in rows if r.source_file.endswith("c.warc")][-1] == "failed"
    got = warc.accounting(warc.read(spark, f"{tmp_path}/a.warc"))
    assert sum(r.n for r in got.collect()) == 5
    parts = warc.chunked(warc.read(spark, f"{tmp_path}/a.warc").filter("status = 'imported'"), 8, 2).collect()
    assert len({r.doc_id for r in parts}) == len(parts) == 4 and parts[0].text == "Café & b"


@pytest.mark.parametrize("body", [b"5\r\nabc", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n", b"3\r\nabc\r\n0\r\nbad\r\n\r\n"])
def test_bad_chunked_bodies(body):
    with pytest.raises(ValueError):
        warc.unchunk(body)


@pytest.mark.parametrize("head", [b"", b"Content-Length: -1\r\n", b"Content-Length: 1\r\nContent-Length: 1\r\n", b"Content-Length: 9999999999\r\n", b"Content-Length: 50\r\n"])
def test_bad_records(head):
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.0\r\n" + head + b"\r\nabc"))


def test_identities():
    assert warc.doc_id("u", "d", "x") != warc.doc_id("u", "d", "y") and warc.parent_id("u", "d", "x") == warc.parent_id("u", "d", "y")
    assert warc.unchunk(b"3;e=1\r\nabc\r\n0\r\nt: 1\r\n\r\n") == b"abc"
    meta = {"doc_id": 1, "target_uri": None}
    assert warc.revision(meta, "a") != warc.revision(meta, "b") and len(warc.revision(meta, "a")) == 64
    v = warc.hash_embedding("t", 10)
    assert len(v) == 10 and abs(sum(x * x for x in v) - 1) < 1e-12


def test_collections(spark, tmp_path):
    m = Manifest(str(tmp_path / "m.json"))
    m.create("c", {"dim": 2})
    with pytest.raises(StateConflict):
        m.resolve()
    m.stage("g1", 5, {"dim": 2})
    for wrong in (m.activate, lambda: m.prepare(4)):
        with pytest.raises(StateConflict):
            wrong()
    m.prepare(5)
    m.activate()
    m.stage("g2", 1, {"dim": 2})
    m.prepare(1)
    m.activate()
    assert m.resolve() == "g2" and m.rollback()["active"]["uri"] == "g1"
    with pytest.raises(InvalidArgument):
        m.stage("g3", 1, {"dim": 3})
    from loomdex.plans.collections import digest

    found = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "archive string, ordinal long")
    done = spark.createDataFrame([("a", 0, digest({"v": 1}), "done"), ("a", 1, digest({"v": 1}), "failed"), ("b", 0, digest({"v": 2}), "done")], "archive string, ordinal long, config string, status string")
    assert {(r.archive, r.ordinal) for r in pending_records(found, done, {"v": 1}).collect()} == {("a", 1), ("b", 0)}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    b = a.orderBy(F.desc("i"))
    assert audit.fingerprint(a, ["i", "t"]).first() == audit.fingerprint(b, ["i", "t"]).first()
    assert audit.fingerprint(a, ["i"]).first() != audit.fingerprint(a, ["i", "t"]).first()
    assert hashlib.sha256(b"").hexdigest() != audit.fingerprint(a.limit(0), ["i"]).first().digest


def test_stream_drains_batches_over_the_interactive_limit(spark, store):
    s, uri, _ = store
    many = spark.range(10_001).selectExpr("id seq", "'upsert' op", "id", "array(float(id), float(0)) vector", "'x' label", "string(null) revision")
    with pytest.raises(LimitExceeded):
        s.upsert(uri, many.select("id", "vector", "label"))
    queue.apply_changes(s, uri, many)
    assert s.read(uri).select("id").distinct().count() == s.read(uri).count() == 10_001
