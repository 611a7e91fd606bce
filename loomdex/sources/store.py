"""Versioned vector data sets: Parquet snapshots under one root, a manifest per data set.

A version lists directories of immutable files.  Appending adds one directory and
rewrites nothing; upserts and deletes write a new snapshot.  The manifest is
replaced by one atomic rename under an exclusive lock file, so readers see whole
versions only.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collections.abc import Callable

from ..errors import InvalidArgument, LimitExceeded, NotPermitted, NullArgument, StateConflict
from ..operators import vector

MAX_BATCH = 10_000
#: Seconds after which a lock whose owner did not come back may be taken over.
LEASE_S = 900.0
COLUMNS = "id long, vector array<float>, label string, revision string"


@dataclass(frozen=True)
class Policy:
    root: str
    max_scan_rows: int = 1_000_000
    allow_destructive: bool = False

    def resolve(self, uri: str) -> Path:
        """The absolute path of a data set, which must lie under the root."""
        raw = Path(uri)
        if "%" in uri or ".." in raw.parts or not raw.is_absolute():
            raise NotPermitted("a data set is an absolute local path without '..' and '%'")
        base = Path(self.root).resolve(strict=True)
        full = raw.resolve()
        if full != base and base not in full.parents:
            raise NotPermitted("the path leaves the root")
        return full


@contextlib.contextmanager
def leased(at: Path, wait_s: float = 30, lease_s: float = LEASE_S):
    """Hold the lock file `at`; yields a check that raises once another owner has taken it over.

    The file names its owner and when its lease ends; a killed owner's lock can be
    taken over then, by one rename, so two waiters can't both get it.
    """
    me, end = uuid.uuid4().hex, time.monotonic() + wait_s
    body = lambda: json.dumps({"owner": me, "until": time.time() + lease_s})
    while True:
        try:
            with os.fdopen(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(body())
            break
        except FileExistsError:
            try:
                held = at.read_text()
                age = time.time() - at.stat().st_mtime
            except FileNotFoundError:
                continue
            if (json.loads(held)["until"] if held else time.time() + lease_s - age) < time.time():
                with contextlib.suppress(FileNotFoundError):
                    os.rename(at, at.with_name(f"{at.name}.{me}"))
                    at.with_name(f"{at.name}.{me}").unlink()
                continue
            if time.monotonic() > end:
                raise StateConflict("another writer holds the data set") from None
            time.sleep(0.05)

    def check() -> None:
        if not at.exists() or f'"{me}"' not in at.read_text():
            raise StateConflict("the lock was taken over")

    try:
        yield check
    finally:
        if at.exists() and f'"{me}"' in at.read_text():
            at.unlink(missing_ok=True)


class VectorStore:
    def __init__(self, spark: SparkSession, policy: Policy):
        self.spark, self.policy = spark, policy
        #: Called with (uri, ids or None) before a direct write; a queue sets it to refuse some.
        self.guard: Callable[[str, DataFrame | None], None] | None = None
        self._check: Callable[[], None] = lambda: None

    @contextlib.contextmanager
    def lock(self, uri: str, wait_s: float = 30):
        """One writer per data set; a writer that lost its lease can't publish."""
        path = self.policy.resolve(uri)
        path.mkdir(parents=True, exist_ok=True)
        with leased(path / "_lock", wait_s) as check:
            self._check = check
            yield path

    def _direct(self, uri: str, ids: DataFrame | None, queued: bool) -> None:
        if self.guard is not None and not queued:
            self.guard(uri, ids)

    def _manifest(self, uri: str) -> dict:
        at = self.policy.resolve(uri) / "_manifest.json"
        if not at.exists():
            raise StateConflict("no such data set")
        return json.loads(at.read_text())

    def _publish(self, path: Path, manifest: dict, dirs: list[str], event: str, rows: int) -> int:
        self._check()
        version = max((v["version"] for v in manifest["versions"]), default=0) + 1
        now = int(time.time() * 1000)
        manifest["versions"].append({"version": version, "created_ms": now, "dirs": dirs})
        manifest["log"].append({"version": version, "event": event, "rows": rows, "at_ms": now})
        part = path / f"_manifest.{uuid.uuid4().hex}"
        part.write_text(json.dumps(manifest))
        os.replace(part, path / "_manifest.json")
        return version

    def create(self, uri: str, dim: int = 3, overwrite: bool = False) -> int:
        if dim <= 0:
            raise InvalidArgument("the dimension must be positive")
        if overwrite and not self.policy.allow_destructive:
            raise NotPermitted("overwriting is switched off")
        with self.lock(uri) as path:
            if (path / "_manifest.json").exists() and not overwrite:
                raise StateConflict("the data set exists")
            return self._publish(path, {"dim": dim, "versions": [], "log": []}, [], "create", 0)

    def dim(self, uri: str) -> int:
        return self._manifest(uri)["dim"]

    def read(self, uri: str, version: int | None = None) -> DataFrame:
        """(id, vector, label, revision) of a version; a column that old files lack is null."""
        found = self._manifest(uri)["versions"]
        entry = found[-1] if version is None else next((v for v in found if v["version"] == version), None)
        if entry is None:
            raise InvalidArgument(f"no version {version}")
        if not entry["dirs"]:
            return self.spark.createDataFrame([], COLUMNS)
        base = self.policy.resolve(uri)
        return self.spark.read.schema(COLUMNS).parquet(*(str(base / d) for d in entry["dirs"]))

    def _checked(self, rows: DataFrame, dim: int, unique: bool, most: int | None = MAX_BATCH) -> DataFrame:
        """Rows in the stored layout; wrong ones raise before anything is written."""
        for name in ("label", "revision"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        rows = rows.selectExpr("cast(id as long) id", "cast(vector as array<float>) vector", "cast(label as string) label", "cast(revision as string) revision")
        bad = F.col("vector").isNull() | (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), F.count_if(bad).alias("bad")).first()
        if found.nulls:
            raise NullArgument("ids must not be null")
        if found.bad:
            raise InvalidArgument(f"{found.bad} vectors are not {dim} finite numbers")
        if unique:
            if most is not None and found.n > most:
                raise LimitExceeded(f"a batch has {most} rows at most")
            if not rows.groupBy("id").count().filter("count > 1").isEmpty():
                raise InvalidArgument("ids repeat within the batch")
        return rows

    def _write(self, path: Path, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(str(path / name))
        return name

    def append(self, uri: str, rows: DataFrame) -> int:
        """Append rows, duplicates allowed; returns their number."""
        self._direct(uri, rows, False)
        with self.lock(uri) as path:
            m = self._manifest(uri)
            rows = self._checked(rows, m["dim"], False)
            name = self._write(path, rows)
            n = self.spark.read.parquet(str(path / name)).count()
            self._publish(path, m, [*(m["versions"][-1]["dirs"]), name], "append", n)
            return n

    def insert_flat(self, uri: str, ids: list[int], flat: list[float], dim: int, labels: list[str | None] | None = None) -> int:
        """Append ids with a row-major flat array of their vectors."""
        if len(flat) != len(ids) * dim or (labels is not None and len(labels) != len(ids)):
            raise InvalidArgument("ids, values and labels don't fit each other")
        one = self.spark.createDataFrame([(ids, [float(x) for x in flat], labels)], "ids array<long>, flat array<float>, labels array<string>")
        rows = one.select("flat", "labels", F.posexplode("ids").alias("i", "id")).select("id", F.slice("flat", F.col("i") * dim + 1, F.lit(dim)).alias("vector"), F.get("labels", F.col("i")).alias("label"))
        return self.append(uri, rows)

    def upsert(self, uri: str, rows: DataFrame, most: int | None = MAX_BATCH, queued: bool = False) -> int:
        """Replace or add rows by id in one new version, which is returned; more than `most` rows raise, None is no limit."""
        self._direct(uri, rows, queued)
        with self.lock(uri) as path:
            m = self._manifest(uri)
            rows = self._checked(rows, m["dim"], True, most)
            old = self.read(uri)
            if not old.groupBy("id").count().filter("count > 1").isEmpty():
                raise StateConflict("the data set holds repeated ids")
            name = self._write(path, old.join(rows.select("id"), "id", "left_anti").unionByName(rows))
            return self._publish(path, m, [name], "upsert", rows.count())

    def delete(self, uri: str, ids: DataFrame, queued: bool = False) -> int:
        """Remove the rows of (id) in one new version, which is returned."""
        self._direct(uri, ids, queued)
        with self.lock(uri) as path:
            m = self._manifest(uri)
            name = self._write(path, self.read(uri).join(ids.select("id").distinct(), "id", "left_anti"))
            return self._publish(path, m, [name], "delete", ids.count())

    def search(self, uri: str, query, k: int = 10, eligible: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
        """(id, label, distance) of the nearest vectors; a query of another dimension raises."""
        return vector.search(self.read(uri), query, k, eligible, id_col="id", vec_col="vector", label_col="label", state=state, dim=self.dim(uri))

    def scan(self, uri: str, limit: int = 100) -> DataFrame:
        if not 0 <= limit <= self.policy.max_scan_rows:
            raise LimitExceeded(f"a scan returns {self.policy.max_scan_rows} rows at most")
        return self.read(uri).select("id", "vector", "label").limit(limit)

    def scan_state(self, uri: str, limit: int = 100) -> DataFrame:
        if not 0 <= limit <= self.policy.max_scan_rows:
            raise LimitExceeded(f"a scan returns {self.policy.max_scan_rows} rows at most")
        return self.read(uri).select(F.col("id").alias("doc_id"), "label", "revision").limit(limit)

    def count(self, uri: str) -> int:
        return self.read(uri).count()

    def versions(self, uri: str) -> DataFrame:
        rows = [(v["version"], v["created_ms"]) for v in self._manifest(uri)["versions"]]
        return self.spark.createDataFrame(rows, "version long, created_ms long")

    def write_log(self, uri: str) -> DataFrame:
        rows = [(x["version"], x["event"], x["rows"], x["at_ms"]) for x in self._manifest(uri)["log"]]
        return self.spark.createDataFrame(rows, "version long, event string, rows long, at_ms long")

    def restore(self, uri: str, version: int) -> int:
        """Make an old version the newest one; returns the version asked for."""
        if not self.policy.allow_destructive:
            raise NotPermitted("restoring is switched off")
        self._direct(uri, None, False)
        with self.lock(uri) as path:
            m = self._manifest(uri)
            entry = next((v for v in m["versions"] if v["version"] == version), None)
            if entry is None:
                raise InvalidArgument(f"no version {version}")
            self._publish(path, m, list(entry["dirs"]), "restore", 0)
            return version
