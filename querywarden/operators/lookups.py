"""Joining many rows to a lookup table when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: rows of a key that one task should get; how many keys can be heavy; salts of null keys
PART_ROWS, HEAVY_KEYS, NULL_SALTS = 100_000, 4096, 256


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``lookup``, which has at most one row per key.

    Rows of one key are spread over ``SALTS`` partitions by the hash of column ``spread`` and meet a copy
    of their lookup row there. Adaptive execution alone would not split such a key when a later step in
    the same stage needs the rows partitioned by it. A lookup that turns out small is still broadcast.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def _heavy(rows: DataFrame, keys: list[str], part: int) -> DataFrame:
    """``keys, _copies`` of the ``HEAVY_KEYS`` largest keys of more than ``part`` rows; all other keys hold at most one
    ``HEAVY_KEYS``-th of all rows each. Keys are counted, combined before the shuffle, and the list is short by its limit."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part)
    top = counts.orderBy(F.col("_n").desc(), *keys).limit(HEAVY_KEYS)
    return top.select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_copies"))


def _salted(rows: DataFrame, heavy: DataFrame, keys: list[str], spread: str) -> DataFrame:
    places = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in (*keys, keys[0])]) == 1, NULL_SALTS).otherwise(F.coalesce("_copies", F.lit(1)))
    # at most HEAVY_KEYS rows are broadcast
    return rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), places).cast("int")).drop("_copies")


def spread_heavy(rows: DataFrame, keys: list[str], spread: str, part: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``_salt``: those of a heavy key, and those with a null key, which meets nothing, get different salts by
    the hash of column ``spread``; all others have salt 0."""
    return _salted(rows, _heavy(rows, keys, part), keys, spread)


def heavy_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "left", part: int = PART_ROWS) -> DataFrame:
    """``rows`` joined to ``lookup``; a task gets about ``part`` rows of a heavy key and only heavy keys are copied.

    Unlike ``salted_lookup`` this counts the keys of ``rows`` first, so rows should be cheap or stored; ``lookup``
    may have several rows per key.
    """
    heavy = _heavy(rows, keys, part)
    copies = lookup.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return _salted(rows, heavy, keys, spread).join(copies, [*keys, "_salt"], how).drop("_salt")


def keep_if(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Rows where ``condition`` on a costly computed ``column`` holds.

    A filter would be pushed below the column and compute it a second time; a generator stays in place.
    """
    return df.withColumn(column, F.explode(F.when(condition, F.array(column))))
