"""Running failure streaks of providers, on streams.

A batch is boiled down to one row per provider: whether it had a success, and the failures after the last
one. These rows add up, so a provider with very many calls costs no more than any other.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.operators.assessment import COOLDOWN, FAILURE_THRESHOLD
from querywarden.operators.lookups import salted_lookup
from querywarden.streaming.compaction import COMPACT_EVERY, add, entries

SUMMARY = "provider long, has_success boolean, tail bigint, last_failure timestamp_ntz"


def summarize(calls: DataFrame) -> DataFrame:
    """(provider, has_success, tail, last_failure) of calls ``event_id, ts, provider, ok``."""
    at = F.struct("ts", "event_id")
    ends = calls.groupBy("provider").agg(F.max(F.when(F.col("ok") == 1, at)).alias("_success"))
    after = (F.col("ok") == 0) & (F.col("_success").isNull() | (at > F.col("_success")))
    return (
        salted_lookup(calls, ends, ["provider"], "event_id", "inner")
        .groupBy("provider")
        .agg(
            F.max(F.col("_success").isNotNull()).alias("has_success"),
            F.count_if(after).alias("tail"),
            F.max(F.when(after, F.col("ts"))).alias("last_failure"),
        )
    )


def apply_batch(calls: DataFrame, batch_id: int, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """Log the summary of one micro-batch; batches arrive in time order and a replay overwrites itself."""
    add(summarize(calls), batch_id, root, SUMMARY, merge, compact_every)


def merge(log: DataFrame) -> DataFrame:
    """One summary per provider: failures count from the batch of its last success on."""
    reset = log.groupBy("provider").agg(F.max(F.when(F.col("has_success"), F.col("batch"))).alias("_reset"))
    since = F.col("_reset").isNull() | (F.col("batch") >= F.col("_reset"))
    return (
        log.join(reset, "provider")
        .groupBy("provider")
        .agg(
            F.max("has_success").alias("has_success"),
            F.coalesce(F.sum(F.when(since, F.col("tail"))), F.lit(0)).alias("tail"),
            F.max(F.when(since, F.col("last_failure"))).alias("last_failure"),
        )
    )


def provider_health(spark: SparkSession, root: str, as_of: Column, threshold: int = FAILURE_THRESHOLD, cooldown: timedelta = COOLDOWN) -> DataFrame:
    """``provider, streak, last_failure, cooling`` after all batches."""
    state = merge(entries(spark, root, SUMMARY)).select("provider", F.col("tail").alias("streak"), "last_failure")
    cooling = (F.col("streak") >= threshold) & (as_of - F.col("last_failure") < F.lit(cooldown))
    return state.withColumn("cooling", F.coalesce(cooling, F.lit(False)))
