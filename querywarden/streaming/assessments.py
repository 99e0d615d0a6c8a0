"""One assessment per key and time to live, on streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.operators.expiry import assess_with_ttl

TTL = timedelta(hours=24)


def dedup_within_watermark(stream: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """Built-in form: the first row of a key within the watermark delay; late rows are dropped.

    Expiry follows the watermark, which moves between micro-batches, so it depends on how rows arrive.
    ``apply_batch`` gives the exact instants.
    """
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def apply_batch(rows: DataFrame, batch_id: int, root: str, key: str, ts: str, schema: str, ttl: timedelta = TTL) -> None:
    """Add the assessments due in one micro-batch to the log, exact when batches arrive in time order.

    A batch reads only earlier numbers and overwrites its own, so a replay changes nothing. Of the log only
    results that can still be valid when the batch starts are read.
    """
    spark = rows.sparkSession
    first = rows.agg(F.min(ts).alias("a")).first().a
    if first is None:
        return
    state = None
    if batch_id > 0:
        recent = F.col("assessed_at") > F.lit(first - ttl).cast("timestamp_ntz")
        earlier = assessments(spark, root, schema).filter((F.col("batch") < batch_id) & recent)
        state = earlier.groupBy(key).agg(F.max("assessed_at").alias("assessed_at"))
    found = assess_with_ttl(rows, key, ts, ttl, state)
    found.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def assessments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All logged assessments with their ``batch``."""
    return spark.read.schema(f"{schema}, batch long").parquet(root)
