"""Reading tables for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS_CONF = "querywarden.inputPartitions"
#: rows of a partition when the session does not say how many partitions there are
SPREAD_ROWS = 50_000


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions for ``df`` of about so many rows each, and one for each core at least. Counts ``df``, which should be cheap."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread_small(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` in as many partitions as the session's ``querywarden.inputPartitions`` says, else in parts of ``SPREAD_ROWS``
    rows, one for each core at least.

    A table may be one file with one row group, which one task reads, however many cores there are. Rows are placed by the
    hash of ``key``, by default the first column, so a repeated task gives the same rows.
    """
    n = df.sparkSession.conf.get(PARTITIONS_CONF, None)
    return df.repartition(parts_for(df, SPREAD_ROWS) if n is None else int(n), key or df.columns[0])
