"""Materialised intermediate tables and row keys.

Lineage is cut by Parquet tables in the folder that the cluster names in
`spark.checkpoint.dir`; every executor can read them, so a lost executor costs
only the tasks it ran.  No state is left on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is made only if none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by `cut` that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def keyed(df: DataFrame, id_col: str, name: str = ROW) -> DataFrame:
    """Add the column `name`, a long that is unique to each row.

    It is the id itself where ids are unique and not null, which one pass over
    the id column establishes.  Otherwise the rows are written once with
    generated keys, so that repeated or null ids stay apart and a recomputed
    task can't number them anew.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    twice = ids.groupBy("i").count().filter("count > 1 or i is null")
    if twice.isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long"))
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that clashes with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
