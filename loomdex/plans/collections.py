"""Collection manifests and resumable imports: which version serves, and what is done."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotPermitted, StateConflict
from ..sources.store import leased


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def _locked(change):
    @functools.wraps(change)
    def run(self, *args, **kwargs):
        with self.lock():
            return change(self, *args, **kwargs)

    return run


class Manifest:
    """Staged, prepared and active generations of a collection, changed by atomic rename."""

    def __init__(self, path: str, root: str | None = None):
        self.path = Path(path)
        #: Staged generations must lie under it, if it is given.
        self.root = Path(root).resolve() if root else None

    @contextlib.contextmanager
    def lock(self):
        """One change at a time; a killed owner's lock runs out."""
        with leased(self.path.with_name(f"{self.path.name}.lock")):
            yield

    def load(self) -> dict:
        return json.loads(self.path.read_text())

    def _save(self, data: dict) -> dict:
        part = self.path.with_name(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(data, sort_keys=True))
        os.replace(part, self.path)
        return data

    @_locked
    def create(self, collection: str, profile: dict) -> dict:
        if self.path.exists():
            raise StateConflict("the manifest exists")
        return self._save({"collection": collection, "profile": profile, "profile_sha256": digest(profile), "active": None, "previous": None, "staged": None, "prepared": False})

    @_locked
    def stage(self, uri: str, expected: int, profile: dict) -> dict:
        data = self.load()
        if data["staged"]:
            raise StateConflict("a generation is staged already")
        at = Path(uri)
        if self.root and (".." in at.parts or (at.resolve() != self.root and self.root not in at.resolve().parents)):
            raise NotPermitted("the generation lies outside the collection's root")
        if digest(profile) != data["profile_sha256"]:
            raise InvalidArgument("the profile differs from the collection's")
        return self._save(data | {"staged": {"uri": uri, "expected": expected}, "prepared": False})

    @_locked
    def prepare(self, ready: int) -> dict:
        data = self.load()
        if not data["staged"]:
            raise StateConflict("nothing is staged")
        if ready != data["staged"]["expected"]:
            raise StateConflict(f"{ready} rows are ready, {data['staged']['expected']} expected")
        return self._save(data | {"prepared": True})

    @_locked
    def activate(self) -> dict:
        data = self.load()
        if not data["prepared"]:
            raise StateConflict("the staged generation is not prepared")
        return self._save(data | {"previous": data["active"], "active": data["staged"], "staged": None, "prepared": False})

    @_locked
    def rollback(self) -> dict:
        data = self.load()
        if not data["previous"]:
            raise StateConflict("there is no previous generation")
        return self._save(data | {"active": data["previous"], "previous": data["active"]})

    @_locked
    def abandon(self) -> dict:
        return self._save(self.load() | {"staged": None, "prepared": False})

    def resolve(self) -> str:
        active = self.load()["active"]
        if not active:
            raise StateConflict("no generation is active")
        return active["uri"]


def pending_records(found: DataFrame, done: DataFrame, config: dict) -> DataFrame:
    """Records (archive, ordinal, ...) that no finished row of the same configuration covers."""
    mine = done.filter((F.col("config") == digest(config)) & (F.col("status") == "done"))
    return found.join(mine.select("archive", "ordinal"), ["archive", "ordinal"], "left_anti")
