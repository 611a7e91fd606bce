"""Retrieval quality: per-query metrics, their means, comparisons and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, reciprocal_rank, recall, ndcg) of ranked hits against binary labels.

    `hits` is (query_id, doc_id, rank), `expected` (query_id, doc_id).  A document
    gains once, at its first rank; the ideal ranks the labelled ones first, k at most.
    """
    if k <= 0:
        raise InvalidArgument("k must be positive")
    labels = expected.select("query_id", "doc_id").distinct()
    wanted = labels.groupBy("query_id").agg(F.count("*").alias("n"))
    first = hits.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    got = first.join(labels, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.min("rank").alias("best"),
        F.count("*").alias("found"),
        F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(got, "query_id", "left").select(
        "query_id",
        F.col("best").isNotNull().alias("hit"),
        zero(1.0 / F.col("best")).alias("reciprocal_rank"),
        zero(F.col("found") / F.col("n")).alias("recall"),
        zero(F.col("gain") / ideal).alias("ndcg"),
    )


METHODS = ("bm25", "vector", "hybrid")


def compare_methods(runs: dict[str, DataFrame], expected: DataFrame, k: int) -> DataFrame:
    """(method, queries, hit_rate, mrr, recall, ndcg) of several rankers against the same labels."""
    if not runs or not set(runs) <= set(METHODS):
        raise InvalidArgument(f"methods are {', '.join(METHODS)}")
    out = None
    for name, hits in runs.items():
        one = metrics(hits, expected, k).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return summary(out, ["method"])


def check_labels(queries: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(finding, query_id, doc_id) of what is wrong with a fixture.

    `queries` is (query_id, text), `labels` (query_id, doc_id), `documents` (doc_id).
    """
    none = F.lit(None).cast("long")
    q, d = F.col("query_id"), F.col("doc_id")
    kind = dict(queries.dtypes)["query_id"]
    tag = lambda df, what, a=q, b=none: df.select(F.lit(what).alias("finding"), a.cast(kind).alias("query_id"), b.cast("long").alias("doc_id"))
    known = queries.select("query_id").distinct()
    found = [
        tag(queries.groupBy("query_id").count().filter("count > 1"), "repeated_query"),
        tag(queries.filter(F.coalesce(F.trim("text"), F.lit("")) == ""), "empty_query"),
        tag(known.join(labels, "query_id", "left_anti"), "query_without_labels"),
        tag(labels.groupBy("query_id", "doc_id").count().filter("count > 1"), "repeated_label", q, d),
        tag(labels.join(known, "query_id", "left_anti"), "label_of_unknown_query", q, d),
        tag(labels.join(documents.select("doc_id").distinct(), "doc_id", "left_anti"), "label_of_unknown_document", q, d),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def summary(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries, of all or of each group."""
    return per_query.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("recall").alias("recall"),
        F.avg("ndcg").alias("ndcg"),
    )


def compare_runs(base: DataFrame, candidate: DataFrame, threshold: float) -> DataFrame:
    """(metric, base, candidate, ratio, failed) of (metric, value) tables; lower is better."""
    both = base.withColumnRenamed("value", "base").join(candidate.withColumnRenamed("value", "candidate"), "metric")
    ratio = F.when(F.col("base") != 0, F.col("candidate") / F.col("base") - 1)
    return both.select("metric", "base", "candidate", ratio.alias("ratio"), F.coalesce(ratio > threshold, F.lit(False)).alias("failed"))


def percentile(df: DataFrame, column: str, share: float, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentile: the least value that `share` of the rows don't pass."""
    return df.groupBy(*(by or [])).agg(F.expr(f"percentile_disc({share}) within group (order by `{column}`)").alias("value"))


def rank_within(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
