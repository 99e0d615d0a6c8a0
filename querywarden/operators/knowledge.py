"""Knowledge entries for a statement: by referenced table and by vector similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.lookups import heavy_lookup, salted_lookup, spread_heavy
from querywarden.operators.metadata import reference_sets

# Wording of documents and of the retrieved context.
TABLES_LABEL = "相关表: "
TABLES_SHORT = "表: "
CONTEXT_TITLE = "## 相关业务知识（RAG 检索）"
SNIPPET = 500
#: kinds of statements that share a text in one row
ASKS = 1000


def document_text() -> Column:
    """Text of an entry as it is embedded."""
    tables = F.col("related_tables")
    middle = F.when(~tx.is_blank(tables), F.concat(F.lit(TABLES_LABEL), tables, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("["), F.col("knowledge_type"), F.lit("] "), F.col("title"), F.lit("\n"), middle, F.col("content"))


def knowledge_document(entries: DataFrame) -> DataFrame:
    """(id, document) of the entries."""
    return entries.select("id", document_text().alias("document"))


def reembed_selection(entries: DataFrame, force_all: bool = False) -> DataFrame:
    """Active entries that still need a vector, or all of them."""
    active = entries.filter("status = 1")
    return active if force_all else active.filter("embedded = 0")


def knowledge_by_table(statements: DataFrame, entries: DataFrame) -> DataFrame:
    """(table_refs, entry_id): active entries that name one of the tables, per distinct reference set."""
    tables = F.transform(F.split("related_tables", ","), lambda t: F.lower(F.trim(t)))
    named = (
        entries.filter((F.col("status") == 1) & F.col("related_tables").isNotNull())
        .select(F.col("id").alias("entry_id"), F.explode(F.array_distinct(tables)).alias("table_ref"))
    )
    return heavy_lookup(named, reference_sets(statements), ["table_ref"], "entry_id", "inner").select("table_refs", "entry_id").distinct()


def alike(statements: DataFrame, asking: DataFrame, columns: list[str], id_col: str = "stmt_id") -> tuple[DataFrame, DataFrame]:
    """Statements that can share a text, and one for each kind: ``rows, kinds``.

    Statements of equal ``columns`` share it, but those whose id is in the only column of ``asking``, the ids that may have
    hits of their own, have one each. ``rows`` are the statements with ``_own``, null for those that share; ``kinds``
    have the columns, ``_own`` and, as ``id_col``, an id of the kind. What is made of a kind goes back by ``shared``.
    """
    ids = asking.toDF("_own").filter("_own is not null").distinct()
    rows = statements.join(ids, F.col(id_col) == F.col("_own"), "left")
    return rows, rows.groupBy("_own", *columns).agg(F.min(id_col).alias(id_col))


def shared(rows: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` of ``alike`` with the further columns of ``made``, which has one row per kind; nulls are equal."""
    keys = ["_own", *columns]
    named = made.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in made.columns if c not in rows.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(named, reduce(Column.__and__, same), "left").drop(*[f"_k{i}" for i in range(len(keys))], "_own")


def exact_context(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """``table_refs, exact``: all entries of a set of tables (see ``knowledge_by_table``) as one text, once for the set."""
    snippet = tx.truncate_ellipsis(F.col("content"), SNIPPET, "")
    exact_text = F.format_string(
        f"- **[%s] %s** ({TABLES_SHORT}%s): %s", "knowledge_type", "title", "related_tables", snippet
    )
    exact_rows = entries.select(F.col("id").alias("entry_id"), exact_text.alias("part")).join(pairs, "entry_id")
    return exact_rows.groupBy("table_refs").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "part"))), lambda x: x["part"]), "\n\n").alias("exact")
    )


def near_context(statements: DataFrame, pairs: DataFrame, entries: DataFrame, hits: DataFrame) -> DataFrame:
    """``stmt_id, near``: similar entries of a statement that are not among those of its tables, as one text.

    The statements are never broadcast: stored, their sets of tables take a few bytes each, in the driver's memory some hundred.
    """
    near_text = F.format_string("- **[%s] %s**: %s", "knowledge_type", "title", tx.truncate_ellipsis(document_text(), SNIPPET, ""))
    near_rows = (
        hits.select(F.col("query_id").alias("stmt_id"), "entry_id", "rank")
        .join(statements.select("stmt_id", "table_refs").hint("merge"), "stmt_id")
        .join(pairs, ["table_refs", "entry_id"], "left_anti")
        .join(entries.select(F.col("id").alias("entry_id"), near_text.alias("part")), "entry_id")
    )
    return near_rows.groupBy("stmt_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("near")
    )


def gathered(kinds: DataFrame, near: DataFrame, columns: list[str], part: int = ASKS) -> DataFrame:
    """``columns, stmt_id, asks``: the ``kinds`` of ``alike`` of equal columns in rows of about ``part`` kinds, ``asks`` being
    ``_own`` and ``near`` of each. What they share, the text of their tables among it, is then made once for a row.

    ``kinds`` are read twice and should be stored.
    """
    # by a hash, as nulls are equal here
    parted = spread_heavy(kinds.withColumn("_alike", F.xxhash64(*columns)), ["_alike"], "_own", part).withColumnRenamed("_salt", "_part")
    asks = F.collect_list(F.struct("_own", "near")).alias("asks")
    return parted.join(near, "stmt_id", "left").groupBy(*columns, "_part").agg(F.min("stmt_id").alias("stmt_id"), asks).drop("_part")


def retrieve_context(
    statements: DataFrame, entries: DataFrame, hits: DataFrame | None, base: DataFrame | None = None
) -> DataFrame:
    """Statements with ``knowledge_context``: entries by table, then similar ones not among them.

    ``statements`` has ``stmt_id, table_refs``; ``hits`` is (query_id = stmt_id, entry_id, rank). ``base``
    are the same statements before costly columns were added, so that those are not computed again; ``statements`` may
    be some of them only. All entries of a set of tables are joined to one text, once for the set. The texts of statements are made
    behind the last join, so that they are never shuffled. Without ``hits`` the context ends with the entries by table, and
    ``near_lead`` is what comes between it and similar ones, the text of which ``near_context`` gives.
    """
    plain = statements if base is None else base
    pairs = knowledge_by_table(plain, entries)
    exact = exact_context(pairs, entries)
    if hits is None:
        named = salted_lookup(statements, exact, ["table_refs"], "stmt_id")
        has = F.col("exact").isNotNull()
        lead = F.when(has, "\n\n").otherwise(f"{CONTEXT_TITLE}\n\n")
        return named.withColumn("knowledge_context", F.when(has, F.concat_ws("\n\n", F.lit(CONTEXT_TITLE), "exact")).otherwise("")).withColumn("near_lead", lead).drop("exact")
    near = near_context(plain, pairs, entries, hits)
    found = F.coalesce("exact", "near").isNotNull()
    text = F.when(found, F.concat_ws("\n\n", F.lit(CONTEXT_TITLE), "exact", "near")).otherwise("")
    return (
        salted_lookup(statements.join(near, "stmt_id", "left"), exact, ["table_refs"], "stmt_id")
        .withColumn("knowledge_context", text)
        .drop("exact", "near")
    )
