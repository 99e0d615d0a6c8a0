"""Row counts of registered tables and of live catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, estimated_rows) of the given tables; each count reads no column."""
    counts = [
        df.agg(F.count("*").alias("estimated_rows")).select(F.lit(name).alias("table_name"), "estimated_rows")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts)


def numeric_rows(catalog_rows: DataFrame) -> DataFrame:
    """(table_name, table_rows text) to numbers; text that is no number gives 0."""
    rows = F.coalesce(F.col("table_rows").try_cast("bigint"), F.lit(0).cast("bigint"))
    return catalog_rows.select("table_name", rows.alias("estimated_rows"))


def jdbc_inventory(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Base tables of a live database with their estimated rows, by name."""
    query = (
        "select table_name, table_rows from information_schema.tables "
        "where table_schema = database() and table_type = 'BASE TABLE'"
    )
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    named = rows.toDF("table_name", "table_rows").withColumn("table_rows", F.col("table_rows").cast("string"))
    return numeric_rows(named).orderBy("table_name")
