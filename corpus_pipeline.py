"""Corpus preparation: toxicity, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`.  Stages are tied by Parquet tables in the shared
folder, so a lost executor never sends the work back further than one stage.

Defined results, for every stage: rows with repeated or null ids stay rows of their
own, other columns come through as they are, whatever their names; an empty table
gives an empty one; a null text stays null, and no stage but the first rejects it or
an empty one; ties between copies go to the smallest id, then the first row; a very
long text is one row of one task and is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import minhash, packing, pii, suffix, toxicity
from loomdex.llm.tables import cut

#: Bytes from which a passage counts as repeated: shorter than 50 words of prose.
PASSAGE = 240


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon rejects go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters within repeated strings go; every document stays."""
    return suffix.remove(docs, length=PASSAGE, length_col="n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data gives way to placeholders."""
    return pii.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of document pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("minhash", near_copies), ("suffix", repeated_passages), ("pii", personal_data), ("packing", packed)]

#: The first stage learns its decisions, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
