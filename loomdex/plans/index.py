"""A stored inverted index: immutable versions, postings clustered by term.

Postings are range-partitioned and sorted by term, so the min and max of a row group
stand in for a tree index: a query on a few terms reads a few row groups.  Frequencies
and statistics are stored with them under the same version, so a reader never mixes
two states.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hashlib

from ..errors import HashCollision, StateConflict
from ..functions.text import LONG_TERM_BYTES, LONG_TERM_PREFIX, term_key
from ..operators import bm25


def key_of(term: str) -> str:
    """The stored key of a query's term, as `term_key` makes it."""
    raw = term.encode()
    return LONG_TERM_PREFIX + hashlib.sha256(raw).hexdigest() if len(raw) > LONG_TERM_BYTES else term


def keyed(raw: DataFrame) -> DataFrame:
    """Postings under their stored keys; two long terms with one key raise."""
    long = raw.filter(F.octet_length("term") > LONG_TERM_BYTES).select("term").distinct()
    if not long.groupBy(term_key(F.col("term")).alias("key")).count().filter("count > 1").isEmpty():
        raise HashCollision("two long terms share a key")
    return raw.withColumn("term", term_key(F.col("term")))


def keyed_postings(docs: DataFrame) -> DataFrame:
    return keyed(bm25.postings(docs))


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    def build(self, docs: DataFrame) -> str:
        """Write a new version and make it current; returns its name."""
        base = self.path / f"v-{uuid.uuid4().hex}"
        return self._write(base, *self._counted(base, docs))

    def _counted(self, base: Path, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lengths and postings of some documents, from a table that one scan of their texts writes.

        The range partitioning reads its input twice and the check of keys once: they
        read this table, not the texts.
        """
        bm25.counted_rows(docs).write.option("compression", "zstd").parquet(str(base / "counted"))
        rows = self.spark.read.parquet(str(base / "counted"))
        postings = keyed(rows.filter("term is not null and doc_id is not null"))
        return rows.filter("term is null").select("doc_id", "doc_len"), postings.select("doc_id", "term", "tf", "doc_len")

    def _write(self, base: Path, lengths: DataFrame, postings: DataFrame) -> str:
        lengths.write.parquet(str(base / "lengths"))
        postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(str(base / "postings"))
        bm25.doc_frequency(self.spark.read.parquet(str(base / "postings"))).sort("term").write.parquet(str(base / "terms"))
        stats = bm25.corpus_stats(self.spark.read.parquet(str(base / "lengths"))).first()
        part = self.path / f".{uuid.uuid4().hex}"
        part.write_text(json.dumps({"current": base.name, "doc_count": stats.doc_count, "avg_doc_len": stats.avg_doc_len}))
        os.replace(part, self.path / "_current.json")
        shutil.rmtree(base / "counted", ignore_errors=True)
        return base.name

    def _current(self) -> dict:
        at = self.path / "_current.json"
        if not at.exists():
            raise StateConflict("the index has no version")
        return json.loads(at.read_text())

    def table(self, name: str) -> DataFrame:
        """postings (doc_id, term, tf, doc_len), lengths or terms (term, df) of the current version."""
        return self.spark.read.parquet(str(self.path / self._current()["current"] / name))

    def search(self, query: str, k: int = 10, eligible: DataFrame | None = None) -> DataFrame:
        """(doc_id, score) of the k best documents; the terms reach the scan as a filter."""
        bm25.check_k(k)
        state = self._current()
        terms = [key_of(t) for t in bm25.query_terms(self.table("lengths"), query)] if k else []
        if not terms or not state["avg_doc_len"]:
            return self.spark.createDataFrame([], "doc_id long, score double")
        hits = self.table("postings").filter(F.col("term").isin(terms))
        if eligible is not None:
            hits = hits.join(eligible.select("doc_id"), "doc_id", "left_semi")
        weights = self.table("terms").filter(F.col("term").isin(terms)).select("term", bm25.idf(F.lit(float(state["doc_count"])), F.col("df").cast("double")).alias("idf"))
        part = F.col("idf") * bm25.weight(F.col("tf"), F.col("doc_len"), F.lit(state["avg_doc_len"]))
        # One row per query term at most: at most as many as the query has.
        scored = hits.join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("term", part.alias("c")))), F.lit(0.0), lambda s, x: s + x["c"]).alias("score"))
        return scored.orderBy(F.desc("score"), "doc_id").limit(k)

    def update(self, docs: DataFrame) -> str:
        """A new version with the given documents replaced or added (doc_id, text)."""
        base = self.path / f"v-{uuid.uuid4().hex}"
        ids = docs.select("doc_id")
        lengths, postings = self._counted(base, docs)
        keep = self.table("lengths").join(ids, "doc_id", "left_anti").unionByName(lengths)
        merged = self.table("postings").join(ids, "doc_id", "left_anti").unionByName(postings)
        return self._write(base, keep, merged)

    def remove(self, ids: DataFrame) -> str:
        """A new version without the documents of (doc_id)."""
        base = self.path / f"v-{uuid.uuid4().hex}"
        gone = ids.select("doc_id").distinct()
        return self._write(base, self.table("lengths").join(gone, "doc_id", "left_anti"), self.table("postings").join(gone, "doc_id", "left_anti"))
