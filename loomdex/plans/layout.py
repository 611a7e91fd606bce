"""How inputs are laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many tasks as the session runs at once.

    A file of one row group is read by one task, whatever its size.  Inputs with
    enough splits, as all large ones have, stay as they are and are not shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
