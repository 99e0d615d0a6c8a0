"""File-level change detection between two snapshots, and patch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change_type) with ADD, MODIFY or DELETE. A rename shows as DELETE plus ADD, a copy as ADD."""
    old = before.select("path", F.col("content_hash").alias("_old"))
    new = after.select("path", F.col("content_hash").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "ADD").when(F.col("_new").isNull(), "DELETE").otherwise("MODIFY")
    differs = ~F.col("_old").eqNullSafe(F.col("_new"))
    return old.join(new, "path", "full_outer").filter(differs).select("path", kind.alias("change_type"))


def is_source_path(path: Column) -> Column:
    """An .xml or .java file outside test folders; one rule for changed and deleted files."""
    return (path.endswith(".xml") | path.endswith(".java")) & ~path.contains("/test/")


def delta_path_filter(delta: DataFrame) -> DataFrame:
    """Rows of a delta that concern scanned sources, with ``file_kind`` XML or JAVA."""
    kind = F.when(F.col("path").endswith(".xml"), "XML").otherwise("JAVA")
    return delta.filter(is_source_path(F.col("path"))).withColumn("file_kind", kind)


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row: changed and deleted sources per kind, all changes, and whether there are any."""
    path, kind = F.col("path"), F.col("change_type")
    src, gone = is_source_path(path), kind == "DELETE"
    return delta.agg(
        F.count_if(src & ~gone & path.endswith(".xml")).alias("changed_xml"),
        F.count_if(src & ~gone & path.endswith(".java")).alias("changed_java"),
        F.count_if(src & gone & path.endswith(".xml")).alias("deleted_xml"),
        F.count_if(src & gone & path.endswith(".java")).alias("deleted_java"),
        F.count("*").alias("total_changed"),
        (F.count("*") > 0).alias("has_changes"),
    )


def patch_line_stats(patches: DataFrame) -> DataFrame:
    """Added and deleted lines per file from its unified diff, and the file's status.

    Input: ``path, diff, new_file, deleted_file, renamed_file``.
    """
    lines = F.split(F.coalesce("diff", F.lit("")), "\n")
    added = F.filter(lines, lambda line: line.startswith("+") & ~line.startswith("+++"))
    removed = F.filter(lines, lambda line: line.startswith("-") & ~line.startswith("---"))
    status = (
        F.when(F.col("deleted_file"), "deleted")
        .when(F.col("new_file"), "added")
        .when(F.col("renamed_file"), "renamed")
        .otherwise("modified")
    )
    return patches.select(
        "path",
        status.alias("status"),
        F.size(added).cast("long").alias("additions"),
        F.size(removed).cast("long").alias("deletions"),
    )
