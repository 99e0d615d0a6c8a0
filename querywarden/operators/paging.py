"""Pages of a report far from its start: by number, or after the last row seen.

An order is a list of column names, a leading ``-`` for descending; its last column must be unique. Nulls are the
smallest values, as in Spark's own order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.session import cut_lineage


def _sorting(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def _names(order: list[str]) -> list[str]:
    return [c.removeprefix("-") for c in order]


def ranges_of_page(counts: list[tuple[int, int]], first: int, size: int) -> tuple[list[int], int]:
    """The ranges (number, rows; in order) that hold rows ``first`` to ``first + size - 1``, and how many rows of the first
    of these come before them."""
    picked, before, skip = [], 0, 0
    for number, rows in sorted(counts):
        if before < first + size and before + rows > first:
            if not picked:
                skip = first - before
            picked.append(number)
        before += rows
    return picked, skip


def deep_page(df: DataFrame, order: list[str], current: int, size: int) -> DataFrame:
    """Page ``current`` (from 1) of ``size`` rows, without a task that holds all rows before it.

    Only the order's columns are sorted into ranges of about equal size, and stored; the driver sees a row count
    for each range. The ranges that hold the page are sorted, and its rows are looked up by their keys.
    """
    first = (max(current, 1) - 1) * size
    names = _names(order)
    keys = df.select(*names).repartitionByRange(*_sorting(order)).withColumn("_range", F.spark_partition_id())
    keys = cut_lineage(keys, "page-keys")
    counts = [tuple(r) for r in keys.groupBy("_range").agg(F.count(F.lit(1))).collect()]
    picked, skip = ranges_of_page(counts, first, size)
    page = keys.filter(F.col("_range").isin(picked)).orderBy(*_sorting(order)).offset(skip).limit(size)
    page = page.select(*[F.col(c).alias(f"_page_{c}") for c in names])
    same = reduce(Column.__and__, [df[c].eqNullSafe(page[f"_page_{c}"]) for c in names])
    # a page has ``size`` rows at most
    return df.join(F.broadcast(page), same, "left_semi").orderBy(*_sorting(order)).limit(size)


def after(order: list[str], last: dict) -> Column:
    """Whether a row comes after the row with the key ``last``."""
    found, equal = F.lit(False), F.lit(True)
    for c in order:
        name, value = c.removeprefix("-"), last[c.removeprefix("-")]
        col, at = F.col(name), F.lit(value)
        if c.startswith("-"):
            beyond = F.lit(False) if value is None else (col < at) | col.isNull()
        else:
            beyond = col.isNotNull() if value is None else col > at
        found = found | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & col.eqNullSafe(at)
    return found


def seek_page(df: DataFrame, order: list[str], size: int, last: dict | None = None) -> DataFrame:
    """The ``size`` rows after the one whose key columns have the values ``last``, or the first rows.

    Each partition keeps its own first ``size`` rows, however far the page lies; the bound reaches the scan.
    """
    rows = df if last is None else df.filter(after(order, last))
    return rows.orderBy(*_sorting(order)).limit(size)
