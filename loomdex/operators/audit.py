"""Consistency reports: index against documents, store against metadata, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bm25


def index_audit(docs: DataFrame, stored_postings: DataFrame, stored_lengths: DataFrame) -> DataFrame:
    """One row of counters: postings missing, extra or of another tf; wrong lengths; unverifiable texts."""
    known = docs.filter("text is not null")
    want = bm25.postings(known).withColumnRenamed("tf", "want")
    have = stored_postings.join(docs.filter("text is null").select("doc_id"), "doc_id", "left_anti").withColumnRenamed("tf", "have")
    both = want.join(have, ["doc_id", "term"], "full_outer")
    postings = both.agg(
        F.count_if(F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("extra"),
        F.count_if(F.col("want") != F.col("have")).alias("wrong_tf"),
    )
    lengths = bm25.doc_lengths(known).withColumnRenamed("doc_len", "want").join(stored_lengths, "doc_id", "left").agg(F.count_if(~F.col("want").eqNullSafe(F.col("doc_len"))).alias("wrong_length"))
    unknown = docs.agg(F.count_if(F.col("text").isNull()).alias("unverifiable"))
    return postings.crossJoin(lengths).crossJoin(unknown)


def reconcile(documents: DataFrame, metadata: DataFrame, vectors: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, finding) of every inconsistency between texts, metadata, vectors and revisions."""
    ids = documents.select("doc_id").unionByName(metadata.select("doc_id")).distinct()
    live = state.filter("not is_deleted").select("doc_id", F.col("revision").alias("want"))
    gone = state.filter("is_deleted").select("doc_id")
    v = vectors.select(F.col("id").alias("doc_id"), "revision")
    tag = lambda df, what: df.select("doc_id", F.lit(what).alias("finding"))
    found = [
        tag(v.groupBy("doc_id").count().filter("count > 1"), "duplicate_vector"),
        tag(ids.join(v, "doc_id", "left_anti"), "missing_vector"),
        tag(v.select("doc_id").distinct().join(ids, "doc_id", "left_anti").join(gone, "doc_id", "left_anti"), "orphan_vector"),
        tag(v.join(gone, "doc_id", "left_semi").select("doc_id").distinct(), "deleted_but_present"),
        tag(v.join(live, "doc_id").filter("not (revision <=> want)").select("doc_id").distinct(), "stale_revision"),
        tag(v.join(state, "doc_id", "left_anti").filter("revision is not null").select("doc_id").distinct(), "untracked_revision"),
        tag(live.join(v, "doc_id", "left_anti"), "tracked_without_vector"),
        tag(metadata.join(documents, "doc_id", "left_anti"), "metadata_without_text"),
        tag(documents.join(metadata, "doc_id", "left_anti"), "text_without_metadata"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def findings(documents: DataFrame, metadata: DataFrame, vectors: DataFrame, state: DataFrame, jobs: DataFrame, now: float) -> DataFrame:
    """One row of counters: every finding of `reconcile`, differing row counts, and the state of the queue."""
    kinds = ("duplicate_vector", "missing_vector", "orphan_vector", "deleted_but_present", "stale_revision", "untracked_revision", "tracked_without_vector", "metadata_without_text", "text_without_metadata")
    found = reconcile(documents, metadata, vectors, state).agg(*(F.count_if(F.col("finding") == k).alias(k) for k in kinds))
    gone = state.filter("is_deleted").select("doc_id")
    more = [
        documents.groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_document")),
        metadata.join(gone, "doc_id", "left_semi").agg(F.count("*").alias("deleted_metadata")),
        _stale_labels(documents, vectors),
        documents.agg(F.count("*").alias("_d")).crossJoin(vectors.agg(F.count("*").alias("_v"))).select((F.col("_d") != F.col("_v")).cast("long").alias("row_count_mismatch")),
    ]
    first = F.col("job_id") == F.col("_first")
    unfinished = jobs.filter("state <> 'completed'")
    heads = unfinished.join(unfinished.groupBy("uri").agg(F.min("job_id").alias("_first")), "uri")
    leased = F.coalesce(F.col("leased_until"), F.lit(0.0)) > now if "leased_until" in jobs.columns else F.lit(False)
    more.append(
        heads.agg(
            F.count("*").alias("unfinished_jobs"),
            F.count_if((F.col("state") == "pending") & ~leased).alias("pending_jobs"),
            F.count_if(first & (F.col("state") == "pending") & ~leased & (F.col("next_attempt") <= now)).alias("ready_jobs"),
            F.count_if(leased).alias("processing_jobs"),
            F.count_if(F.col("state") == "failed").alias("failed_jobs"),
            F.countDistinct("uri").alias("sets_with_jobs"),
        )
    )
    for one in more:
        found = found.crossJoin(F.broadcast(one))  # one row each
    return found


def _stale_labels(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose label is not their document's, where both have one."""
    if "label" not in documents.columns or "label" not in vectors.columns:
        return documents.sparkSession.range(1).select(F.lit(0).cast("long").alias("stale_label"))
    both = vectors.select(F.col("id").alias("doc_id"), F.col("label").alias("_v")).join(documents.select("doc_id", "label"), "doc_id")
    return both.agg(F.count_if(F.col("_v") != F.col("label")).alias("stale_label"))


def inventory(jobs: DataFrame) -> DataFrame:
    """(uri, jobs): the unfinished jobs of each data set as JSON, by id."""
    cells = F.array_sort(F.collect_list(F.struct("job_id", "state", "attempts")))
    return jobs.filter("state <> 'completed'").groupBy("uri").agg(F.to_json(cells).alias("jobs"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows and a digest of them that no order of rows changes."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, at, 14), 16, 10).cast("decimal(38,0)") for at in (1, 15, 29, 43)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in halves)), 256).alias("digest"))
