"""Source trees and table files, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.sources.tables import parts_for

#: files that a task writes
TASK_FILES = 2_000
# Folders that are never scanned.
SKIPPED_DIRS = {
    "xml": [".git", "node_modules", "target", "build"],
    "java": [".git", "node_modules", "target", "build", ".idea", ".mvn"],
}
SKIPPED_PARTS = {"xml": ["/test/", "/pom.xml", "/target/", "/build/"], "java": ["/test/", "/tests/"]}


def is_scanned(path: Column, ext: str) -> Column:
    """Whether a path relative to the tree's root is a scanned file of kind ``xml`` or ``java``."""
    rooted = F.concat(F.lit("/"), path)
    keep = path.endswith(f".{ext}")
    for folder in SKIPPED_DIRS[ext]:
        keep = keep & ~F.contains(rooted, F.lit(f"/{folder}/"))
    for part in SKIPPED_PARTS[ext]:
        keep = keep & ~F.contains(F.lower(rooted), F.lit(part))
    return keep


def _full_path() -> Column:
    """Path of a row's file, percent-escapes resolved."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def source_tree_scan(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """(path, content) of the scanned files under ``root``; the path is relative to it."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{ext}")
    path = F.split_part(_full_path(), F.lit(f"/{base}/"), F.lit(-1))
    return files.select(path.alias("path"), F.col("value").alias("content")).filter(is_scanned(F.col("path"), ext))


def source_tree_write(files: DataFrame, root: str, ext: str = "xml") -> None:
    """Write one file per row of (folder, content) below ``root``, in ``<root>/folder=<folder>``; an extension has three letters.

    The files are written by the executors, about ``TASK_FILES`` by a task, and on every core; a content is written as it is.
    ``files`` are counted first, so they should be cheap or stored.
    """
    raw = {"quote": "", "sep": "\u0001", "extension": ext, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = files.select("folder", "content").repartition(parts_for(files, TASK_FILES), "folder")
    rows.write.partitionBy("folder").options(**raw).mode("append").csv(root)


def source_tree_stream(spark: SparkSession, root: str, ext: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of scanned files under ``root`` as they arrive, each once."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    files = reader.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{ext}")
    path = F.split_part(_full_path(), F.lit(f"/{base}/"), F.lit(-1))
    return files.select(path.alias("path"), F.col("value").alias("content")).filter(is_scanned(F.col("path"), ext))


def ddl_directory_load(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, content) of table files: ``<table>.sql``, or folders ``table_name=<table>``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = _full_path()
    folder = F.regexp_extract(path, r"/table_name=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)\.sql$", 1))
    return files.select(name.alias("table_name"), F.col("value").alias("content")).filter("table_name <> ''")


def ddl_export(tables: DataFrame, root: str) -> None:
    """Write one text file per table with header and DDL, in a folder ``table_name=<table>``.

    Input: ``table_name, estimated_rows, ddl``, counted first as for ``source_tree_write``; a table's rows share its file.
    """
    value = F.format_string("-- Estimated Rows: %d\n\n%s", "estimated_rows", "ddl")
    rows = tables.select("table_name", value.alias("value")).repartition(parts_for(tables, TASK_FILES), "table_name")
    rows.write.partitionBy("table_name").text(root)
