"""Exemption rules: by source class or by table, global or for one project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.lookups import heavy_lookup, salted_lookup


def location_keys(location: Column) -> Column:
    """All patterns that would match a location: its dotted prefixes and the dotted ends of its class.

    This turns "starts with", "equals" and "ends with" into equality, so rules are found by an equi join.
    """
    parts = F.split(location, r"\.")
    inner = F.sequence(F.lit(1), F.size(parts) - 1)
    prefixes = F.transform(inner, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    ends = F.transform(inner, lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i), "."))
    return F.when(F.size(parts) > 1, F.array_distinct(F.concat(prefixes, ends))).otherwise(
        F.array().cast("array<string>")
    )


def _best_rule(facts: DataFrame, by: str, keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Lowest matching rule per (``by``, project_id). ``keys`` maps ``by`` to ``rule_key``.

    A key such as the first part of all package names may belong to every place, so heavy keys are spread. Of the
    rules with one pattern and project only the lowest counts, so a place meets one rule per key and project.
    """
    lowest = rules.groupBy("rule_key", "rule_project").agg(F.min("rule_id").alias("rule_id"))
    hits = heavy_lookup(keys, lowest, ["rule_key"], by, "inner").select(by, "rule_id", "rule_project")
    return (
        facts.select(by, "project_id")
        .distinct()
        .join(hits, by)
        .filter(F.col("rule_project").isNull() | (F.col("rule_project") == F.col("project_id")))
        .groupBy(by, "project_id")
        .agg(F.min("rule_id").alias("_rule"))
    )


def _active(rules: DataFrame, rule_type: str) -> DataFrame:
    return rules.filter((F.col("status") == 1) & (F.col("rule_type") == rule_type)).select(
        F.col("id").alias("rule_id"), F.col("project_id").alias("rule_project"), F.col("pattern").alias("rule_key")
    )


def class_rule(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """Lowest SOURCE_CLASS rule per (source_location, project_id)."""
    places = statements.select("source_location").distinct()
    keys = places.select("source_location", F.explode(location_keys(F.col("source_location"))).alias("rule_key"))
    return _best_rule(statements, "source_location", keys, _active(rules, "SOURCE_CLASS"))


def table_rule(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """Lowest TABLE_NAME rule per (table_refs, project_id); a pattern equals one of the tables."""
    sets = statements.select("table_refs").distinct()
    keys = sets.select("table_refs", F.explode("table_refs").alias("rule_key"))
    lowered = _active(rules, "TABLE_NAME").withColumn("rule_key", F.lower("rule_key"))
    return _best_rule(statements, "table_refs", keys, lowered)


def exemption_match(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """Statements with ``rule_id``, the lowest rule that exempts them, null when none does.

    Rules are matched once per distinct (location, project) and (tables, project), not per statement.
    """
    by_class = class_rule(statements, rules).withColumnRenamed("_rule", "_class_rule")
    by_table = table_rule(statements, rules).withColumnRenamed("_rule", "_table_rule")
    placed = salted_lookup(statements, by_class, ["source_location", "project_id"], "stmt_id")
    ruled = salted_lookup(placed, by_table, ["table_refs", "project_id"], "stmt_id")
    return ruled.withColumn("rule_id", F.least("_class_rule", "_table_rule")).drop("_class_rule", "_table_rule")


def drop_exempt(statements: DataFrame, rules: DataFrame) -> DataFrame:
    """Statements no rule exempts."""
    return exemption_match(statements, rules).filter("rule_id is null").drop("rule_id")


def _preview_filter(records: DataFrame, rule_type: str, pattern: str, project_id: int | None) -> tuple[DataFrame, Column]:
    scope = records.filter("status = 1")
    if project_id is not None:
        scope = scope.filter(F.col("project_id") == project_id)
    if rule_type == "SOURCE_CLASS":
        at = F.col("source_location")
        of_class = F.regexp_extract(at, r"^(.+)\.[^.]*$", 1)
        hit = at.startswith(f"{pattern}.") | F.concat(F.lit("."), of_class).endswith(f".{pattern}")
        hit = hit & F.lit(pattern != "")
    elif rule_type == "TABLE_NAME":
        hit = F.contains(F.lower("sql_normalized"), F.lit(pattern.lower()))
    else:
        hit = F.lit(False)
    return scope, F.coalesce(hit, F.lit(False))


def exemption_preview(
    records: DataFrame, rule_type: str, pattern: str, project_id: int | None = None, show: int = 50
) -> DataFrame:
    """The first ``show`` active records a rule would match, text cut to 120.

    A table pattern matches anywhere in the text here, unlike in ``exemption_match``.
    """
    scope, hit = _preview_filter(records, rule_type, pattern, project_id)
    return (
        scope.filter(hit)
        .orderBy("id")
        .limit(show)
        .select("id", "source_location", "sql_type", tx.truncate_ellipsis(F.col("sql_normalized"), 120).alias("sql_normalized"))
    )


def exemption_preview_counts(
    records: DataFrame, rule_type: str, pattern: str, project_id: int | None = None
) -> DataFrame:
    """How many active records a rule would match, and how many there are."""
    scope, hit = _preview_filter(records, rule_type, pattern, project_id)
    return scope.agg(F.count_if(hit).alias("matched_count"), F.count("*").alias("total_records"))
