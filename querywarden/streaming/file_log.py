"""Changes of a source tree as its files arrive: a log of content hashes per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, content_hash string, change string, batch long"


def apply_batch(files: DataFrame, batch_id: int, root: str) -> None:
    """Log the files (path, content) of a micro-batch as ADD, or MODIFY if the latest content known differs.

    A path that arrives with the content it has is not logged; of two contents of a path in one batch the one with
    the larger hash counts. A batch reads only earlier numbers and overwrites its own, so a replay changes nothing.
    """
    spark = files.sparkSession
    arrived = files.groupBy("path").agg(F.max(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("content_hash"))
    found = arrived.withColumn("change", F.lit("ADD"))
    if batch_id > 0:
        known = latest(file_changes(spark, root).filter(F.col("batch") < batch_id)).select("path", F.col("content_hash").alias("_old"))
        change = F.when(F.col("_old").isNull(), "ADD").when(F.col("_old") != F.col("content_hash"), "MODIFY")
        found = arrived.join(known, "path", "left").withColumn("change", change).filter("change is not null").drop("_old")
    found.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of each path."""
    newest = F.max_by(F.struct("content_hash", "change"), F.col("batch")).alias("n")
    return changes.groupBy("path").agg(newest).select("path", "n.content_hash", "n.change")


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """All logged changes with their ``batch``."""
    return spark.read.schema(SCHEMA).parquet(root)
