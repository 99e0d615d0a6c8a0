"""Logs of micro-batches that are merged from time to time, so that a read takes one merged part and a few batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_EVERY = 50


def newest(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Number of the last batch in the newest complete merged part of the log at ``root``, of those that end earlier than ``before``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/merged")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    parts = [s.getPath() for s in fs.listStatus(folder)]
    done = [p for p in parts if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    ends = [int(p.getName().partition("=")[2]) for p in done]
    return max((n for n in ends if before is None or n < before), default=None)


def entries(spark: SparkSession, root: str, schema: str, up_to: int | None = None) -> DataFrame:
    """The merged part of the log and the batches after it, with their number as ``batch``.

    With ``up_to``: the batches up to it, and an earlier merged part than that of ``up_to`` itself, which a
    replay writes again.
    """
    merged = newest(spark, root, up_to)
    log = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/log")
    if up_to is not None:
        log = log.filter(F.col("batch") <= up_to)
    if merged is None:
        return log
    part = spark.read.schema(schema).parquet(f"{root}/merged/upto={merged}").withColumn("batch", F.lit(merged).cast("long"))
    return log.filter(F.col("batch") > merged).unionByName(part)


def add(df: DataFrame, batch_id: int, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY) -> None:
    """Log ``df`` as a batch, and every so many batches merge the log up to it.

    A replayed batch writes the same folders again. ``merge`` takes entries with ``batch`` and returns rows of
    ``schema``.
    """
    df.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
    if (batch_id + 1) % every == 0:
        spark = df.sparkSession
        merge(entries(spark, root, schema, batch_id)).write.mode("overwrite").parquet(f"{root}/merged/upto={batch_id}")
