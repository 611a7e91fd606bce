"""Reciprocal-rank fusion of lexical and vector hits, and its metadata variants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from . import bm25, vector
from .filters import SearchFilter, admitted

RRF_K = 60
METADATA = ("target_uri", "warc_date", "content_type", "http_status", "payload_digest", "source_file", "text_len")
FACETS = ("domain", "content_language", "media_type", "collection_id")


def check_options(bm25_weight: float, vector_weight: float, rrf_k: int) -> None:
    for w in (bm25_weight, vector_weight):
        if not math.isfinite(w) or not 0 <= w <= 1000:
            raise InvalidArgument("weights must be finite and 0 to 1000")
    if not bm25_weight and not vector_weight:
        raise InvalidArgument("one weight must be positive")
    if not 1 <= rrf_k <= 10_000:
        raise InvalidArgument("rrf_k must be 1 to 10000")


def fuse(lexical: DataFrame | None, near: DataFrame | None, k: int, bm25_weight: float = 1.0, vector_weight: float = 1.0, rrf_k: int = RRF_K) -> DataFrame:
    """(doc_id, score, source, ranks, contributions) of the k best fused hits, ties by id.

    `lexical` is (doc_id, score), `near` (id, distance), each at most a candidate
    limit long, so ranking them in one window moves a bounded number of rows.
    """
    check_options(bm25_weight, vector_weight, rrf_k)
    spark = (lexical if lexical is not None else near).sparkSession
    ranked = lambda df, order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    none = spark.createDataFrame([], "doc_id long, rank int")
    a = none if lexical is None else ranked(lexical, (F.desc("score"), "doc_id")).select("doc_id", "rank")
    b = none if near is None else ranked(near, ("distance", "id")).groupBy(F.col("id").alias("doc_id")).agg(F.max("rank").alias("rank"))
    both = a.withColumnRenamed("rank", "bm25_rank").join(b.withColumnRenamed("rank", "vector_rank"), "doc_id", "full_outer")
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.col(rank) + rrf_k), F.lit(0.0))
    both = both.withColumns({"bm25_contribution": part(bm25_weight, "bm25_rank"), "vector_contribution": part(vector_weight, "vector_rank")})
    source = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("bm25_rank").isNull(), "vector").otherwise("bm25+vector")
    both = both.select("doc_id", (F.col("bm25_contribution") + F.col("vector_contribution")).alias("score"), source.alias("source"), "bm25_rank", "vector_rank", "bm25_contribution", "vector_contribution")
    return both.orderBy(F.desc("score"), "doc_id").limit(k)


def explain(docs: DataFrame, vectors: DataFrame, query: str, query_vector, k: int = 10, candidate_k: int = 100, bm25_weight: float = 1.0, vector_weight: float = 1.0, rrf_k: int = RRF_K, eligible: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Fused hits with ranks and contributions; a source of weight 0 is not run.

    `state` hides deleted and stale vectors, before the candidate limit where
    `eligible` is given and after it otherwise.
    """
    check_options(bm25_weight, vector_weight, rrf_k)
    bm25.check_k(k)
    bm25.check_k(candidate_k)
    lexical = bm25.search(docs, query, candidate_k, eligible) if bm25_weight else None
    near = vector.search(vectors, query_vector, candidate_k, eligible, state=state) if vector_weight else None
    return fuse(lexical, near, k, bm25_weight, vector_weight, rrf_k)


def search(docs: DataFrame, vectors: DataFrame, query: str, query_vector, k: int = 10, eligible: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, source) with k candidates of each source."""
    return explain(docs, vectors, query, query_vector, k, k, eligible=eligible, state=state).select("doc_id", "score", "source")


def with_metadata(hits: DataFrame, metadata: DataFrame, columns=METADATA) -> DataFrame:
    """Hits with their metadata; a hit without any keeps nulls and a text length of 0."""
    found = hits.join(metadata.select("doc_id", *columns), "doc_id", "left")
    return found.withColumn("text_len", F.coalesce("text_len", F.lit(0))) if "text_len" in columns else found


def search_metadata(docs: DataFrame, vectors: DataFrame, metadata: DataFrame, query: str, query_vector, k: int = 10, columns=METADATA, state: DataFrame | None = None) -> DataFrame:
    """Unfiltered search; hits carry their metadata."""
    return with_metadata(search(docs, vectors, query, query_vector, k, state=state), metadata, columns)


def search_filtered(docs: DataFrame, vectors: DataFrame, metadata: DataFrame, query: str, query_vector, filters: SearchFilter, k: int = 10, columns=METADATA + FACETS, state: DataFrame | None = None) -> DataFrame:
    """Search within the documents that the filter admits, however many."""
    ids = admitted(metadata, filters)
    return with_metadata(search(docs, vectors, query, query_vector, k, ids, state), metadata, columns)


def explain_filtered(docs: DataFrame, vectors: DataFrame, metadata: DataFrame, query: str, query_vector, filters: SearchFilter, k: int = 10, candidate_k: int = 100, columns=METADATA + FACETS, state: DataFrame | None = None, **weights) -> DataFrame:
    """Search within the documents that the filter admits, however many, with ranks, contributions and metadata of every hit."""
    ids = admitted(metadata, filters)
    return with_metadata(explain(docs, vectors, query, query_vector, k, candidate_k, eligible=ids, state=state, **weights), metadata, columns)
