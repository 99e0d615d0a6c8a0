"""Expiry after writing: when a key is assessed if a result holds for a given time.

The first row of a key is assessed, and then each first row at or after the end of the last result. Which row
follows an assessment depends only on its time, so every row gets its successor by an as-of lookup, all rows at
once; the chain from a key's first row is then found by pointer doubling, in about log2(chain) joins.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.session import cut_lineage

#: parts of the time to live; a task orders the instants of a key and part, or a key's parts
PARTS = 16


def _micros(ts: str | Column) -> Column:
    at = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def first_from(events: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """``asks`` (``_k, _at, _id``) with ``_next``, the first of ``events`` (``_k, _t``) at or after ``_at``; null if none.

    Time is cut into parts of ``width`` microseconds. An answer lies in the part asked for, found by one pass over
    that key and part, or is the first event of the key's next part that has any.
    """
    part = lambda c: F.floor(_micros(c) / width).alias("_p")
    own = events.select("_k", part("_t"), F.col("_t").alias("_at"), F.lit(False).alias("_asks"), F.lit(None).cast(asks.schema["_id"].dataType).alias("_id"))
    both = own.unionByName(asks.select("_k", part("_at"), "_at", F.lit(True).alias("_asks"), "_id"))
    down = Window.partitionBy("_k", "_p").orderBy(F.col("_at").desc(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.min(F.when(~F.col("_asks"), F.col("_at"))).over(down)).filter("_asks")
    firsts = own.groupBy("_k", "_p").agg(F.min("_at").alias("_first"))
    wanted = asks.select("_k", part("_at")).distinct().withColumn("_first", F.lit(None).cast(events.schema["_t"].dataType))
    # of a part that asks and has events, the asking row comes first and does not see them
    later = Window.partitionBy("_k").orderBy(F.col("_p").desc(), F.col("_first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    far = firsts.unionByName(wanted).withColumn("_far", F.min("_first").over(later)).filter("_first is null").select("_k", "_p", "_far")
    return near.join(far, ["_k", "_p"]).select("_k", "_at", "_id", F.coalesce("_near", "_far").alias("_next"))


def chain_from(starts: DataFrame, links: DataFrame, longest: int) -> DataFrame:
    """``_k, _t`` of ``starts`` and all that ``links`` (``_k, _t, _next``) lead to, in at most ``longest`` steps.

    Each round doubles the steps that a link spans and the part of the chains that is known.
    """
    known, jumps = starts, links
    rounds = longest.bit_length()
    for n in range(rounds):
        reached = known.join(jumps, ["_k", "_t"]).select("_k", F.col("_next").alias("_t"))
        known = cut_lineage(known.unionByName(reached), "expiry-chain")
        if n + 1 < rounds:
            onward = jumps.select("_k", F.col("_t").alias("_next"), F.col("_next").alias("_then"))
            jumps = cut_lineage(jumps.join(onward, ["_k", "_next"]).select("_k", "_t", F.col("_then").alias("_next")), "expiry-links")
    return known


def assess_with_ttl(rows: DataFrame, key: str, ts: str, ttl: timedelta = timedelta(hours=24), state: DataFrame | None = None) -> DataFrame:
    """``key, assessed_at``: the instants at which each key is assessed when a result expires ``ttl`` after it was written.

    ``state`` (key, assessed_at), with one row per key at most, continues an earlier run. A null key is a key;
    a row without a time is never assessed. Rows of one key and instant count once. The number of jobs grows with
    the logarithm of the longest chain; no pass sees more than the distinct instants of a key
    in a sixteenth of ``ttl``, or one row for each such part of a key.
    """
    if ttl <= timedelta(0):
        raise ValueError("ttl must be positive")
    micros = ttl // timedelta(microseconds=1)
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("_k")
    timed = rows.filter(F.col(ts).isNotNull())
    events = cut_lineage(timed.groupBy(name, F.col(ts).alias("_t")).agg(F.any_value(key).alias("_key")), "expiry-events")
    keys = events.groupBy("_k").agg(F.min("_t").alias("_t"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    steps = F.least(F.col("_n") - 1, F.floor((_micros("_last") - _micros("_t")) / micros))
    longest = keys.agg(F.max(steps)).first()[0]
    if longest is None:
        return timed.select(key, F.col(ts).alias("assessed_at")).limit(0)
    width = max(1, micros // PARTS)
    times = events.select("_k", "_t")
    lapse = F.lit(ttl)
    links = first_from(times, times.select("_k", (F.col("_t") + lapse).alias("_at"), F.col("_t").alias("_id")), width)
    links = cut_lineage(links.filter("_next is not null").select("_k", F.col("_id").alias("_t"), "_next"), "expiry-links")
    starts = keys.select("_k", "_t")
    if state is not None:
        valid = state.filter("assessed_at is not null").select(name, (F.col("assessed_at") + lapse).alias("_at"), F.lit(0).alias("_id"))
        due = first_from(times, valid, width).select("_k", F.col("_next").alias("_t"))
        starts = starts.join(valid, "_k", "left_anti").unionByName(due.filter("_t is not null"))
    found = chain_from(cut_lineage(starts, "expiry-starts"), links, longest)
    return found.join(events, ["_k", "_t"]).select(F.col("_key").alias(key), F.col("_t").alias("assessed_at"))
