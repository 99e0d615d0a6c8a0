"""From builder calls to pseudo SQL: clauses, columns, entities, tables.

Input of most operators: ``usage_id, seq, call_name, args``, one row per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.javasource import literal_value
from querywarden.operators.lookups import keep_if

UNKNOWN_COLUMN = "_unknown_col"
UNKNOWN_TABLE = "_unknown"

# Condition calls and their SQL, ``{}`` stands for the column.
CONDITIONS = {
    "eq": "{} = ?",
    "ne": "{} <> ?",
    "gt": "{} > ?",
    "ge": "{} >= ?",
    "lt": "{} < ?",
    "le": "{} <= ?",
    "like": "{} LIKE CONCAT('%', ?, '%')",
    "likeLeft": "{} LIKE CONCAT('%', ?)",
    "likeRight": "{} LIKE CONCAT(?, '%')",
    "notLike": "{} NOT LIKE CONCAT('%', ?, '%')",
    "between": "{} BETWEEN ? AND ?",
    "notBetween": "{} NOT BETWEEN ? AND ?",
    "in": "{} IN (?, ?, ?)",
    "notIn": "{} NOT IN (?, ?, ?)",
    "isNull": "{} IS NULL",
    "isNotNull": "{} IS NOT NULL",
}

# Classes whose constants do not name an entity.
UTILITY_CLASSES = [
    "Objects", "Collections", "Arrays", "Math", "String",
    "System", "Integer", "Long", "Boolean", "Double", "Float",
    "Optional", "Stream", "Collectors", "List", "Map", "Set",
    "StringUtils", "CollectionUtils", "ObjectUtils", "BeanUtils",
]

IS_LITERAL = r'^"[\s\S]*"$'
GETTER_REF = r"^(?:[A-Za-z_][\w.]*\.)?([A-Za-z_]\w*)::(\w+)$"
CONSTANT = r"^[A-Z][A-Z0-9_]*$"
PLAIN_NAME = r"^[A-Za-z_]\w*$"
FIELD = r"^([A-Za-z_]\w*)\.(\w+)$"


def resolve_column(arg: Column) -> Column:
    """Column an argument names: a literal as it is, a getter or field in snake case, a constant lower."""
    getter = F.regexp_extract(arg, GETTER_REF, 2)
    prop = F.regexp_replace(getter, r"^(?:get|is)(?=.)", "")
    name = F.regexp_extract(arg, r"^(?:[\w.]*\.)?(\w+)$", 1)
    plain = (
        F.when(name == F.upper(name), F.lower(name))
        .when((name == F.lower(name)) & F.contains(name, F.lit("_")), name)
        .otherwise(tx.camel_to_snake(name))
    )
    return (
        F.when(arg.rlike(IS_LITERAL), literal_value(arg))
        .when(arg.rlike(GETTER_REF), tx.camel_to_snake(prop))
        .when(arg.rlike(r"^[A-Za-z_][\w.]*$"), plain)
        .otherwise(UNKNOWN_COLUMN)
    )


def has_leading_condition(args: Column) -> Column:
    """Whether the first argument is a boolean that switches the call on.

    Literals, operators, negations and parentheses are; with three or more arguments a call or a plain
    name is too, but not an upper-case constant, which names a column.
    """
    first = F.get(args, F.lit(0))
    bare = F.regexp_replace(first, r'"(?:[^"\\]|\\.)*"', "")
    expression = bare.rlike(r"^(true|false)$|^!|^\(|^-|&&|\|\||[<>=!]=|[<>+*/%&|-]") & ~bare.rlike("::|->|^new ")
    callish = first.rlike(r"\)$") & ~first.rlike(r"^\(")
    name = first.rlike(PLAIN_NAME) & ~first.rlike(CONSTANT)
    return (F.size(args) >= 2) & (expression | ((F.size(args) >= 3) & (callish | name)))


def bool_prefix_strip(calls: DataFrame) -> DataFrame:
    """Drops the leading condition of a call and says in ``is_dynamic`` whether there was one."""
    takes = F.col("call_name").isin(*CONDITIONS, "exists", "notExists", "apply", "set", "setSql")
    dynamic = F.coalesce(takes & has_leading_condition(F.col("args")), F.lit(False))
    return calls.withColumn("is_dynamic", dynamic).withColumn(
        "args", F.when(dynamic, F.slice("args", F.lit(2), F.size("args") - 1)).otherwise(F.col("args"))
    )


def _raw_sql(arg: Column) -> Column:
    """Text of a literal with ``{0}``-style slots as ``?``; null for anything else."""
    return F.when(arg.rlike(IS_LITERAL), F.regexp_replace(literal_value(arg), r"\{\d+\}", "?"))


def with_clauses(calls: DataFrame) -> DataFrame:
    """Calls with ``kind`` and ``fragments``, the SQL parts each call adds; null for other calls.

    Kinds: condition, select, order, group, having, set, last.
    """
    calls = calls.withColumn("_first", F.get("args", F.lit(0))).withColumn("_columns", F.transform("args", resolve_column))
    name, args, first = F.col("call_name"), F.col("args"), F.col("_first")
    first_column = F.get("_columns", F.lit(0))
    template = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])[name]
    condition = F.when(first.isNotNull(), F.replace(template, F.lit("{}"), first_column))
    sub_query = F.when(first.isNull(), "?").otherwise(F.coalesce(_raw_sql(first), F.lit("?")))
    exists = F.concat(F.when(name == "notExists", "NOT EXISTS (").otherwise("EXISTS ("), sub_query, F.lit(")"))
    known = F.filter("_columns", lambda c: c != UNKNOWN_COLUMN)
    direction = F.when(F.contains(name, F.lit("Desc")), " DESC").otherwise(" ASC")
    pairs = F.filter(F.arrays_zip(args.alias("a"), F.col("_columns").alias("c")), lambda p: ~p["a"].isin("true", "false"))
    ordered = F.transform(pairs, lambda p: F.concat(p["c"], direction))
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    last = F.when(first.rlike(IS_LITERAL), literal_value(first))
    kinds = (
        F.when(name.isin(*CONDITIONS, "exists", "notExists", "apply"), "condition")
        .when(name == "select", "select")
        .when(name.isin("orderBy", "orderByAsc", "orderByDesc"), "order")
        .when(name == "groupBy", "group")
        .when(name.isin("set", "setSql"), "set")
        .when(name.isin("having", "last"), name)
    )
    fragments = (
        F.when(name.isin(*CONDITIONS), one(condition))
        .when(name.isin("exists", "notExists"), one(exists))
        .when(name.isin("apply", "setSql", "having"), one(_raw_sql(first)))
        .when(name == "set", one(F.when(first.isNotNull(), F.concat(first_column, F.lit(" = ?")))))
        .when(name.isin("select", "groupBy"), known)
        .when(name == "last", one(last))
        .otherwise(ordered)
    )
    return (
        calls.withColumn("kind", kinds)
        .withColumn("fragments", F.when(F.col("kind").isNotNull(), fragments))
        .drop("_first", "_columns")
    )


def wrapper_clause_map(calls: DataFrame) -> DataFrame:
    """The calls that add clauses, see ``with_clauses``."""
    return keep_if(with_clauses(calls), "fragments", F.size("fragments") > 0)


def _entity_parts() -> list[Column]:
    """Aggregates for the entity of a usage: declared, by getter reference, by constant."""
    args = F.col("args")
    getters = F.filter(args, lambda a: a.rlike(GETTER_REF) & (F.regexp_extract(a, GETTER_REF, 1) != ""))
    getter = F.when(F.col("wrapper_type").startswith("Lambda"), F.regexp_extract(F.get(getters, F.lit(0)), GETTER_REF, 1))
    owners = F.transform(args, lambda a: F.regexp_extract(a, FIELD, 1))
    constant = F.get(F.filter(owners, lambda o: o.rlike("^[A-Z]") & ~o.isin(*UTILITY_CLASSES)), F.lit(0))
    return [
        F.max("declared_entity").alias("_declared"),
        F.min(F.when(getter.isNotNull(), F.struct("seq", getter.alias("e")))).alias("_getter"),
        F.min(F.when(constant.isNotNull(), F.struct("seq", constant.alias("e")))).alias("_constant"),
    ]


def _entity() -> Column:
    return F.coalesce(F.col("_declared"), F.col("_getter.e"), F.col("_constant.e"))


def entity_infer(calls: DataFrame) -> DataFrame:
    """(usage_id, entity): declared type argument, else class of the first getter reference of a lambda
    builder, else class of the first constant that is no utility class."""
    return calls.groupBy("usage_id").agg(*_entity_parts()).select("usage_id", _entity().alias("entity"))


def table_name_resolve(usages: DataFrame, entity_tables: DataFrame) -> DataFrame:
    """Adds ``table_name``: mapped, else ``t_`` and the entity in snake case, else ``_unknown``."""
    guess = F.when(tx.is_blank(F.col("entity")), UNKNOWN_TABLE).otherwise(F.concat(F.lit("t_"), tx.camel_to_snake(F.col("entity"))))
    mapped = entity_tables.select("entity", F.col("table_name").alias("_mapped"))
    return usages.join(mapped, "entity", "left").withColumn("table_name", F.coalesce("_mapped", guess)).drop("_mapped")


CLAUSE_KINDS = ["condition", "select", "order", "group", "set", "having", "last"]


def _clause_parts() -> list[Column]:
    """Aggregates that gather a usage's fragments per kind in call order."""
    part = F.struct("seq", "fragments")

    def of(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.size("fragments") > 0), part)))
        return F.flatten(F.transform(rows, lambda r: r["fragments"])).alias(kind)

    return [of(k) for k in CLAUSE_KINDS]


def _statement_text() -> tuple[Column, Column]:
    """Text and type of a usage from its gathered fragments, ``wrapper_type`` and ``table_name``."""

    def clause(kind: str, lead: str, sep: str) -> Column:
        return F.when(F.size(kind) > 0, F.concat(F.lit(lead), F.array_join(kind, sep))).otherwise("")

    def final(kind: str, lead: str) -> Column:
        return F.when(F.size(kind) > 0, F.concat(F.lit(lead), F.element_at(kind, -1))).otherwise("")

    is_update = F.col("wrapper_type").isin("UpdateWrapper", "LambdaUpdateWrapper")
    columns = F.when(F.size("select") > 0, F.array_join("select", ", ")).otherwise("*")
    changes = F.when(F.size("set") > 0, F.array_join("set", ", ")).otherwise("_col = ?")
    head = F.when(is_update, F.concat(F.lit("UPDATE "), "table_name", F.lit(" SET "), changes)).otherwise(
        F.concat(F.lit("SELECT "), columns, F.lit(" FROM "), "table_name")
    )
    text = F.concat(
        head,
        clause("condition", " WHERE ", " AND "),
        clause("group", " GROUP BY ", ", "),
        final("having", " HAVING "),
        clause("order", " ORDER BY ", ", "),
        final("last", " "),
    )
    return text, F.when(is_update, "UPDATE").otherwise("SELECT")


def pseudo_sql_assemble(clauses: DataFrame, usages: DataFrame) -> DataFrame:
    """One statement per usage: ``usage_id, sql_text, sql_type`` from clauses in call order.

    ``usages`` is (usage_id, wrapper_type, table_name). Of several ``having`` or ``last`` the final one
    counts. Usages without any clause make no statement.
    """
    rows = clauses.groupBy("usage_id").agg(*_clause_parts())
    text, kind = _statement_text()
    return rows.join(usages.select("usage_id", "wrapper_type", "table_name"), "usage_id").select(
        "usage_id", text.alias("sql_text"), kind.alias("sql_type")
    )


def wrapper_statements(calls: DataFrame, entity_tables: DataFrame) -> DataFrame:
    """Builder calls to statement rows, one per usage with content; the calls are read and grouped once."""
    # a generator stays in place, so that the arguments are worked out once and not in each clause
    plain = bool_prefix_strip(calls).withColumn("args", F.explode(F.array("args")))
    rows = (
        with_clauses(plain)
        .groupBy("usage_id")
        .agg(
            *_clause_parts(), *_entity_parts(), F.max("wrapper_type").alias("wrapper_type"), F.max("path").alias("source_file"),
            F.max(F.concat("cls", F.lit("."), "method")).alias("source_location"),
        )
        .withColumn("entity", _entity())
        .filter(F.size(F.concat(*CLAUSE_KINDS)) > 0)
    )
    text, kind = _statement_text()
    source = F.when(F.col("wrapper_type").startswith("Lambda"), "LAMBDA_WRAPPER").otherwise("QUERY_WRAPPER")
    return table_name_resolve(rows, entity_tables).select(
        text.alias("sql_text"), tx.normalize_sql(text).alias("sql_normalized"), kind.alias("sql_type"),
        source.alias("source_type"), "source_file", "source_location", F.lit(True).alias("has_dynamic"),
    )
