"""JSON-lines exchange: records out, embeddings in; and embeddings by a callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument

FLOAT_MAX = 3.4028234663852886e38
UNIT_TOLERANCE = 1e-3


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are written."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def bad_vector(vector, dim: int, unit: bool):
    """Condition of a vector that is not `dim` finite numbers in the range of a float, or not of length 1."""
    wrong = vector.isNull() | (F.size(vector) != dim) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > FLOAT_MAX))
    if unit:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
        wrong = wrong | (F.abs(norm - 1) > UNIT_TOLERANCE)
    return wrong


def read_embeddings(spark: SparkSession, path: str, dim: int, wanted: DataFrame | None = None, unit: bool = False) -> DataFrame:
    """(doc_id, vector) of a JSON-lines file with doc_id or id, checked as a whole before it is used.

    Repeated ids, ids of `wanted` (doc_id) without a vector, and malformed vectors raise.
    """
    raw = spark.read.schema("doc_id long, id long, vector array<double>").json(path)
    rows = raw.select(F.coalesce("doc_id", "id").alias("doc_id"), "vector")
    found = rows.agg(F.count_if(F.col("doc_id").isNull()).alias("nameless"), F.count_if(bad_vector(F.col("vector"), dim, unit)).alias("bad")).first()
    if found.nameless or found.bad:
        raise InvalidArgument(f"{found.nameless} rows without an id, {found.bad} malformed vectors")
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        raise InvalidArgument("ids repeat")
    if wanted is not None and not wanted.join(rows, "doc_id", "left_anti").isEmpty():
        raise InvalidArgument("some ids have no vector")
    return rows.select("doc_id", F.col("vector").cast("array<float>").alias("vector"))


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector) by a callable that maps a list of texts to as many vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                vectors = model(part["t"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the model returned another number of vectors")
                yield pd.DataFrame({"doc_id": part["i"].to_numpy(), "vector": vectors})

    src = rows.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    return src.mapInPandas(run, "doc_id long, vector array<float>")


def remote(post: Callable[[list[str]], list[dict]]) -> Callable[[list[str]], list[list[float]]]:
    """A model for `embed` out of a client call.

    `post` sends a list of texts and returns items with index and embedding in any
    order; each index must come once.
    """

    def model(texts: list[str]) -> list[list[float]]:
        items = post(texts)
        if sorted(x["index"] for x in items) != list(range(len(texts))):
            raise ValueError("the service returned other items than were asked for")
        return [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]

    return model


def quality_fixture(records: DataFrame, embeddings: DataFrame, queries: DataFrame, query_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (doc_id, ...) and queries (query_id, ...), each with its vector; any without one raises."""
    docs = records.join(embeddings.select("doc_id", "vector"), "doc_id", "left")
    asked = queries.join(query_vectors.select("query_id", "vector"), "query_id", "left")
    missing = docs.filter("vector is null").count(), asked.filter("vector is null").count()
    if any(missing):
        raise InvalidArgument(f"{missing[0]} records and {missing[1]} queries have no vector")
    return docs, asked
