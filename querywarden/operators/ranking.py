"""Pick-one, top-n and numbering without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def pick_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key group that sorts first by ``order`` (ascending, nulls first).

    A struct minimum is combined on the map side, so a key holding most rows costs one row per
    partition in the shuffle. ``order`` should be total within a group.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest]).select(*df.columns)


def pick_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key group that sorts last by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest]).select(*df.columns)


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: str, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key group with their rank.

    Ranks first inside salted parts of a group (salt from the hash of column ``spread``), so the
    second ranking sees at most ``SALTS * n`` rows of any group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= n)
    )


def number_by_hash(df: DataFrame, hash_col: str, order: list[str], start: Column, out: str) -> DataFrame:
    """Consecutive numbers from ``start`` + 1 in the order (``hash_col``, ``order``).

    The first three hex digits cut the hash range into at most 4,096 ordered parts; rows are numbered
    within a part, and only the part sizes are summed up in one place.
    """
    parted = df.withColumn("_part", F.substring(hash_col, 1, 3))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(hash_col, *order)
    return (
        parted.withColumn("_rn", F.row_number().over(within))
        .join(offsets, "_part")
        .withColumn(out, (start + F.col("_offset") + F.col("_rn")).cast("long"))
        .drop("_part", "_rn", "_offset")
    )
