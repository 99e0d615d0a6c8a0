"""The statement inventory kept from a stream of file scans.

Every micro-batch adds two small tables under its own number: what it saw per (project, hash), and which
files it scanned. A replayed batch writes the same folders again, so nothing counts twice, and no earlier
data is rewritten. The inventory is the merge of all batches; the merge of merges is the same, so the log is
merged as it grows, and a read takes the last merged part and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.operators.inventory import KEY, first_occurrence, with_fingerprint
from querywarden.streaming.compaction import COMPACT_EVERY, add, entries

SEEN = "project_id long, sql_hash string, sql_text string, source_file string, source_location string, first_scan_id long, last_scan_id long"
FILES = "project_id long, source_file string, last_scan_id long"


def apply_batch(statements: DataFrame, batch_id: int, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """Log one micro-batch: the whole content of some files, as statement rows.

    A file that holds no statement any more comes as one row without text.
    """
    statements = statements.persist()
    scan = F.lit(batch_id).cast("long")
    found = first_occurrence(with_fingerprint(statements))
    seen = found.select(*KEY, "sql_text", "source_file", "source_location", scan.alias("first_scan_id"), scan.alias("last_scan_id"))
    add(seen, batch_id, f"{root}/seen", SEEN, merge_seen, compact_every)
    files = statements.select("project_id", "source_file").distinct().withColumn("last_scan_id", scan)
    add(files, batch_id, f"{root}/files", FILES, merge_files, compact_every)
    statements.unpersist()


def merge_seen(rows: DataFrame) -> DataFrame:
    """One row per (project, hash): first and last scan, and the place of the last one."""
    last = F.max(F.struct("last_scan_id", "source_file", "source_location", "sql_text")).alias("l")
    merged = rows.groupBy(*KEY).agg(F.min("first_scan_id").alias("first_scan_id"), last)
    return merged.select(*KEY, "l.sql_text", "l.source_file", "l.source_location", "first_scan_id", "l.last_scan_id")


def merge_files(rows: DataFrame) -> DataFrame:
    """Last scan of each file."""
    return rows.groupBy("project_id", "source_file").agg(F.max("last_scan_id").alias("last_scan_id"))


def current_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The inventory; a record whose file was scanned later without it has status 0."""
    seen = merge_seen(entries(spark, f"{root}/seen", SEEN))
    files = merge_files(entries(spark, f"{root}/files", FILES))
    scanned = files.withColumnRenamed("last_scan_id", "_scanned")
    gone = F.coalesce(F.col("_scanned") > F.col("last_scan_id"), F.lit(False))
    return (
        seen.join(scanned, ["project_id", "source_file"], "left")
        .withColumn("status", F.when(gone, 0).otherwise(1))
        .drop("_scanned")
    )

