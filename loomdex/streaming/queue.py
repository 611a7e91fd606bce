"""The change queue: jobs in order per data set, retries, revisions, tombstones, draining.

Job and state tables are frames; the decisions over them (which job is next, who is
visible, when to retry) are plain DataFrame plans.  `Outbox` keeps both tables as
snapshots beside a store, and `drain_stream` applies a stream of changes by id,
which makes a replayed batch harmless.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, LimitExceeded, StateConflict
from ..functions.scalars import saturating_backoff
from ..sources.store import LEASE_S, MAX_BATCH, VectorStore, leased
from ..sources.warc import stale_chunks

MAX_ATTEMPTS = 8
MAX_ERROR = 2048
REVISION = re.compile(r"[0-9a-f]{64}")


def latest(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last change of each key, by an ordering column that is unique in a key."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, "last.*")


def ready(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs that are due and have no older unfinished job of their data set."""
    first = jobs.filter("state <> 'completed'").groupBy("uri").agg(F.min_by(F.struct(*jobs.columns), "job_id").alias("j")).select("j.*")
    return first.filter((F.col("state") == "pending") & (F.col("next_attempt") <= now))


def status(jobs: DataFrame) -> DataFrame:
    """Per data set: jobs by state, the oldest unfinished and the newest finished one."""
    unfinished = F.when(F.col("state") != "completed", F.col("job_id"))
    return jobs.groupBy("uri").agg(
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "completed").alias("completed"),
        F.min(unfinished).alias("oldest_unfinished"),
        F.max(F.when(F.col("state") == "completed", F.col("job_id"))).alias("newest_completed"),
        F.coalesce(F.max(F.when(F.col("state") != "completed", F.col("attempts"))), F.lit(0)).alias("most_attempts"),
    )


def failures(jobs: DataFrame) -> DataFrame:
    return jobs.filter("attempts > 0 and state <> 'completed'").select("job_id", "uri", "state", "attempts", "next_attempt", "error")


def after_failure(attempts: Column) -> tuple[Column, Column]:
    """State and seconds to wait after the given number of failed attempts."""
    return F.when(attempts >= MAX_ATTEMPTS, "failed").otherwise("pending"), saturating_backoff(attempts)


def visible_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (doc_id, revision, ...) that are untracked, or not deleted and at their tracked revision."""
    s = state.select("doc_id", F.col("revision").alias("_expected"), F.col("is_deleted").alias("_gone"))
    joined = rows.join(s, "doc_id", "left")
    keep = F.col("_gone").isNull() | (~F.col("_gone") & F.col("_expected").eqNullSafe(F.col("revision")))
    return joined.filter(keep).select(rows.columns)


class Outbox:
    """Jobs and revisions of the data sets of one store; a control table, kept on the driver's side.

    Each change reads the table, alters it and replaces it under one lock, so changes
    of several clients don't undo each other.  A job is applied without the lock, under
    a lease that keeps other workers away from its data set; its outcome is merged into
    the table as it is then.
    """

    def __init__(self, store: VectorStore, path: str, guard: bool = False):
        self.store, self.at = store, Path(path)
        self.spark: SparkSession = store.spark
        with leased(self.at.with_name(f"{self.at.name}.lock")):
            if not self.at.exists():
                self._save({"next": 1, "jobs": [], "state": {}})
        if guard:
            store.guard = self.refuse

    def _load(self) -> dict:
        return json.loads(self.at.read_text())

    def _save(self, data: dict) -> None:
        part = self.at.with_name(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(data))
        os.replace(part, self.at)

    @contextlib.contextmanager
    def _changed(self):
        """The table, saved at the end unless an error is raised."""
        with leased(self.at.with_name(f"{self.at.name}.lock")) as check:
            data = self._load()
            yield data
            check()
            self._save(data)

    def enqueue(self, uri: str, ids: list[int], vectors: list[list[float]], labels: list[str | None] | None = None, revisions: list[str] | None = None, now: float | None = None) -> int:
        """Queue an upsert of 1 to 10,000 rows with different ids; returns the job's id."""
        if not 1 <= len(ids) <= MAX_BATCH:
            raise LimitExceeded(f"a job has 1 to {MAX_BATCH} rows")
        if len(set(ids)) != len(ids) or len(vectors) != len(ids) or (labels is not None and len(labels) != len(ids)):
            raise InvalidArgument("ids must differ, each with one vector and one label")
        if revisions is not None and (len(revisions) != len(ids) or not all(map(REVISION.fullmatch, revisions))):
            raise InvalidArgument("a revision is 64 hexadecimal digits in lower case")
        rows = [[i, [float(x) for x in v], (labels or [None] * len(ids))[k], (revisions or [None] * len(ids))[k]] for k, (i, v) in enumerate(zip(ids, vectors))]
        with self._changed() as data:
            if revisions is None and any(str(i) in data["state"] for i in ids):
                raise StateConflict("an id is tracked by revision")
            for i, r in zip(ids, revisions or []):
                owner = data["state"].get(str(i))
                if owner and owner["uri"] != uri:
                    raise StateConflict("an id is tracked under another data set")
                data["state"][str(i)] = {"uri": uri, "revision": r, "is_deleted": False}
            return self._push(data, uri, "upsert", rows, now)

    def delete(self, uri: str, ids: list[int], revisions: list[str], now: float | None = None) -> int:
        """Queue a delete and hide the rows at once; 0 if all were deleted before."""
        with self._changed() as data:
            todo = []
            for i, r in zip(ids, revisions, strict=True):
                s = data["state"].get(str(i))
                if s is None or s["uri"] != uri or s["revision"] != r:
                    raise StateConflict("an id is not tracked here at this revision")
                if not s["is_deleted"]:
                    s["is_deleted"] = True
                    todo.append([i, None, None, r])
            return self._push(data, uri, "delete", todo, now) if todo else 0

    def delete_documents(self, uri: str, ids: list[int], revisions: list[str], index=None, metadata: DataFrame | None = None, now: float | None = None) -> tuple[int, DataFrame | None]:
        """Delete documents from all places: job id, and the metadata without them.

        Vectors are hidden at once and go with the job; postings go in a new version of
        the stored index; `metadata` (doc_id, ...) comes back without the documents.
        """
        job = self.delete(uri, ids, revisions, now)
        gone = self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        if index is not None:
            index.remove(gone)
        return job, None if metadata is None else metadata.join(F.broadcast(gone), "doc_id", "left_anti")  # at most MAX_BATCH ids

    def reconcile_chunks(self, uri: str, stored: DataFrame, imported: DataFrame, now: float | None = None) -> list[int]:
        """Queue deletes, in batches of 10,000 in the order of the ids, of stored chunks that a new import of their parents no longer has."""
        stale = [r.doc_id for r in stale_chunks(stored, imported).select("doc_id").distinct().orderBy("doc_id").toLocalIterator()]
        known = self._load()["state"]
        mine = [i for i in stale if str(i) in known and known[str(i)]["uri"] == uri]
        found = []
        for lo in range(0, len(mine), MAX_BATCH):
            part = mine[lo : lo + MAX_BATCH]
            job = self.delete(uri, part, [known[str(i)]["revision"] for i in part], now)
            found += [job] if job else []
        return found

    def _push(self, data: dict, uri: str, op: str, rows: list, now: float | None) -> int:
        job = data["next"]
        data["next"] += 1
        data["jobs"].append({"job_id": job, "uri": uri, "op": op, "rows": rows, "state": "pending", "attempts": 0, "next_attempt": now if now is not None else time.time(), "error": None, "applied_version": None})
        return job

    def jobs(self) -> DataFrame:
        rows = [(j["job_id"], j["uri"], j["op"], j["state"], j["attempts"], float(j["next_attempt"]), j["error"], j["applied_version"]) for j in self._load()["jobs"]]
        return self.spark.createDataFrame(rows, "job_id long, uri string, op string, state string, attempts int, next_attempt double, error string, applied_version long")

    def state(self) -> DataFrame:
        rows = [(int(i), s["uri"], s["revision"], s["is_deleted"]) for i, s in self._load()["state"].items()]
        return self.spark.createDataFrame(rows, "doc_id long, uri string, revision string, is_deleted boolean")

    def guard_direct_write(self, uri: str) -> None:
        """Direct writes wait until the queue of a data set is empty."""
        if any(j["uri"] == uri and j["state"] != "completed" for j in self._load()["jobs"]):
            raise StateConflict("the data set has unfinished jobs")

    def refuse(self, uri: str, rows: DataFrame | None) -> None:
        """The guard of a store: no direct write beside unfinished jobs, nor of rows that are tracked by revision."""
        self.guard_direct_write(uri)
        if rows is None:
            if any(s["uri"] == uri for s in self._load()["state"].values()):
                raise StateConflict("the data set has rows tracked by revision")
        elif not rows.select(F.col("id").alias("doc_id")).join(self.state(), "doc_id", "left_semi").isEmpty():
            raise StateConflict("some rows are tracked by revision")

    def process_next(self, now: float | None = None, apply=None, lease_s: float = LEASE_S) -> dict | None:
        """Apply the oldest job that may run; None if there is none.

        A failure is recorded and retried later.  Applying is by id, so repeating a
        job whose acknowledgement was lost changes nothing; its lease runs out.
        """
        now = time.time() if now is None else now
        with self._changed() as data:
            first: dict[str, dict] = {}
            for j in data["jobs"]:
                if j["state"] != "completed":
                    first.setdefault(j["uri"], j)
            free = [j for j in first.values() if j["state"] == "pending" and j["next_attempt"] <= now and j.get("leased_until", 0) <= time.time()]
            if not free:
                return None
            job = min(free, key=lambda j: j["job_id"])
            job["leased_until"] = time.time() + lease_s
            job = dict(job)
        try:
            version = (apply or self._apply)(job)
        except Exception as e:  # noqa: BLE001 - any failure of a job is its own state
            n = job["attempts"] + 1
            done = {"attempts": n, "state": "failed" if n >= MAX_ATTEMPTS else "pending", "next_attempt": now + min(3600, 2 ** min(12, n - 1)), "error": str(e)[:MAX_ERROR]}
        else:
            done = {"state": "completed", "rows": [[r[0], None, None, r[3]] for r in job["rows"]], "applied_version": version, "error": None}
        with self._changed() as data:
            mine = next(j for j in data["jobs"] if j["job_id"] == job["job_id"])
            mine.pop("leased_until", None)
            mine.update(done)
            return {k: mine[k] for k in ("job_id", "state", "applied_version", "attempts")}

    def _apply(self, job: dict) -> int:
        rows = self.spark.createDataFrame([tuple(r) for r in job["rows"]], "id long, vector array<float>, label string, revision string")
        return self.store.delete(job["uri"], rows, queued=True) if job["op"] == "delete" else self.store.upsert(job["uri"], rows, queued=True)


CHANGE = "seq long, op string, id long, vector array<float>, label string, revision string"


def apply_changes(store: VectorStore, uri: str, batch: DataFrame) -> None:
    """Apply the last change of each id of a batch of any size (seq, op, id, vector, label, revision)."""
    last = latest(batch, ["id"], "seq").persist()
    puts = last.filter("op = 'upsert'").select("id", "vector", "label", "revision")
    gone = last.filter("op = 'delete'").select("id")
    if not puts.isEmpty():
        store.upsert(uri, puts, most=None, queued=True)
    if not gone.isEmpty():
        store.delete(uri, gone, queued=True)
    last.unpersist()


def drain_stream(store: VectorStore, uri: str, changes: DataFrame, checkpoint: str, **trigger):
    """Start a query that applies a stream of changes, batch by batch and in order."""
    return changes.writeStream.foreachBatch(lambda df, _: apply_changes(store, uri, df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
