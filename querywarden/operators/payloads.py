"""JSON payloads of code platforms and of a data platform as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx

COMMITS = (
    "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>,"
    "parents:array<struct<sha:string>>>>"
)


def json_path(bodies: DataFrame, paths: dict[str, str], body: str = "body") -> DataFrame:
    """Adds one column per dotted path into a JSON body."""
    cols = [F.get_json_object(body, f"$.{path}").alias(name) for name, path in paths.items()]
    return bodies.select("*", *cols)


def commit_payload_flatten(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per commit of a JSON commit list; the title is the first line of the message."""
    rest = [c for c in payloads.columns if c != body]
    commits = payloads.select(*rest, F.explode(F.from_json(body, COMMITS)).alias("c"))
    return commits.select(
        *rest,
        F.col("c.sha").alias("commit_id"),
        tx.short_id(F.col("c.sha")).alias("short_id"),
        tx.first_line(F.col("c.commit.message")).alias("title"),
        F.col("c.commit.author.name").alias("author"),
        F.col("c.commit.author.date").alias("created_at"),
        F.transform("c.parents", lambda p: p["sha"]).alias("parent_ids"),
    )


def string_rows_decode(results: DataFrame, columns: list[str]) -> DataFrame:
    """Results of (headers array, rows array of JSON-list texts) as named string columns.

    A column is found by its place among the headers; one that is missing there is null.
    """
    rest = [c for c in results.columns if c not in ("headers", "rows")]
    rows = results.select(*rest, "headers", F.explode("rows").alias("_row"))
    cells = rows.withColumn("_cells", F.from_json("_row", "array<string>"))
    picked = [
        F.when(F.array_position("headers", F.lit(c)) > 0, F.get("_cells", F.array_position("headers", F.lit(c)).cast("int") - 1)).alias(c)
        for c in columns
    ]
    return cells.select(*rest, *picked)
