"""Exact nearest neighbours by squared Euclidean distance, as native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .bm25 import check_k


def check_vector(vector: Sequence[float], dim: int | None = None) -> list[float]:
    out = [float(x) for x in vector]
    if not out or not all(map(math.isfinite, out)):
        raise InvalidArgument("a query vector needs finite components")
    if dim is not None and len(out) != dim:
        raise InvalidArgument(f"the vector has {len(out)} components, the data set {dim}")
    return out


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision; null where lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def search(
    vectors: DataFrame, query: Sequence[float] | DataFrame, k: int = 10, eligible: DataFrame | None = None, visible: Column | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, state: DataFrame | None = None, dim: int | None = None,
) -> DataFrame:
    """(id, distance), or (id, label, distance), of the k nearest vectors, nearest first, ties by id before the limit.

    `query` is a vector, or a frame of one row with the column q.  With `eligible`
    (doc_id) only those vectors are ranked, and `visible` is applied before the
    limit; without it `visible` is applied after, so fewer than k may return.  `state`
    (doc_id, revision, is_deleted) hides deleted and stale vectors by their column
    revision, at the same place.  A query of other than `dim` components raises.
    """
    if not isinstance(query, DataFrame):
        query = check_vector(query, dim)
    if not check_k(k):
        return vectors.sparkSession.createDataFrame([], "id long, " + ("label string, " if label_col else "") + "distance double")
    rows = vectors.withColumnsRenamed({id_col: "id", vec_col: "v", **({label_col: "label"} if label_col else {})})
    if eligible is not None:
        rows = rows.join(eligible.select(F.col("doc_id").alias("id")), "id", "left_semi")
        if visible is not None:
            rows = rows.filter(visible)
        if state is not None:
            rows = shown(rows, state)
    if isinstance(query, DataFrame):
        rows = rows.crossJoin(F.broadcast(query.select("q").limit(1)))
        against = F.col("q")
    else:
        against = literal(query)
    out = rows.withColumn("distance", squared_distance(F.col("v"), against)).filter("distance is not null").orderBy("distance", "id").limit(k)
    if eligible is None and visible is not None:
        out = out.filter(visible)
    if eligible is None and state is not None:
        out = shown(out, state).orderBy("distance", "id")
    return out.select(F.col("id").cast("long").alias("id"), *(["label"] if label_col else []), "distance")


def shown(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (id, ...) that are untracked, or not deleted and at their tracked revision; without a column revision theirs is null."""
    s = state.select(F.col("doc_id").alias("id"), F.col("revision").alias("_expected"), F.col("is_deleted").alias("_gone"))
    own = F.col("revision") if "revision" in rows.columns else F.lit(None).cast("string")
    keep = F.col("_gone").isNull() | (~F.col("_gone") & F.col("_expected").eqNullSafe(own))
    return rows.join(s, "id", "left").filter(keep).drop("_expected", "_gone")


def centroid(vectors: DataFrame, vec_col: str = "embedding", by: str | None = None) -> DataFrame:
    """Mean vector per group, scaled to length 1: (group, position, value)."""
    each = vectors.select(*([by] if by else []), F.posexplode(vec_col).alias("position", "x"))
    means = each.groupBy(*([by] if by else []), "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = means.groupBy(*([by] if by else [])).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    joined = means.join(norm, by) if by else means.crossJoin(F.broadcast(norm))  # one row
    return joined.select(*([by] if by else []), "position", F.when(F.col("norm") > 0, F.col("mean") / F.col("norm")).otherwise(F.col("mean")).alias("value"))
