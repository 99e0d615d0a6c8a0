"""Table metadata: DDL files, index statistics, drift, shard resolution and table context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import ddltext as dt
from querywarden.functions import text as tx
from querywarden.operators.lookups import salted_lookup

# Headings of the table context.
CONTEXT_TITLE = "## 相关表结构（自动检索）"
SHARD_NOTE = "（分表）"
ROWS_NOTE = "（约 %,d 行）"


def ddl_file_parse(files: DataFrame) -> DataFrame:
    """(table_name, content) to ``table_name, estimated_rows, ddl_text, index_stats``."""
    content = F.col("content")
    return files.select(
        "table_name",
        dt.estimated_rows(content).alias("estimated_rows"),
        dt.bare_ddl(content).alias("ddl_text"),
        dt.index_section(content).alias("index_stats"),
    )


def prefix_cardinality(table: DataFrame, columns: list[str], approx_rsd: float | None = None) -> DataFrame:
    """Distinct values of every leading part of an index, one row per ``seq``.

    Exact counts work on the distinct full prefixes, so duplicates are gone before columns are counted
    apart; ``approx_rsd`` switches to sketches, which need no shuffle of values at all.
    """
    parts = {f"c{i}": F.struct(*columns[:i]) for i in range(1, len(columns) + 1)}
    if approx_rsd is None:
        keys = table.select(*columns).distinct()
        counted = keys.agg(*[F.count_distinct(p).alias(n) for n, p in parts.items()])
    else:
        counted = table.agg(*[F.approx_count_distinct(p, approx_rsd).alias(n) for n, p in parts.items()])
    rows = [
        F.struct(F.lit(i).alias("seq"), F.lit(columns[i - 1]).alias("column_name"), F.col(f"c{i}").alias("cardinality"))
        for i in range(1, len(columns) + 1)
    ]
    return counted.select(F.inline(F.array(*rows)))


SKETCH_BITS = 14


def prefix_sketches(table: DataFrame, columns: list[str], batch: Column) -> DataFrame:
    """``batch, seq, column_name, n_rows, sketch``: for each part of a table a mergeable sketch of every leading part of an index.

    Stored, these are all that a later refresh needs of rows it has read before. Nulls count as a value.
    """
    parts = range(1, len(columns) + 1)
    sketches = [F.hll_sketch_agg(F.xxhash64(F.lit(i), *columns[:i], *[F.col(c).isNull() for c in columns[:i]]), F.lit(SKETCH_BITS)).alias(f"s{i}") for i in parts]
    found = table.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), *sketches)
    rows = [F.struct(F.lit(i).alias("seq"), F.lit(columns[i - 1]).alias("column_name"), "n_rows", F.col(f"s{i}").alias("sketch")) for i in parts]
    return found.select("batch", F.inline(F.array(*rows)))


def merged_cardinality(sketches: DataFrame) -> DataFrame:
    """``seq, column_name, n_rows, cardinality`` over all batches; of a batch that was sketched again the sketch over more rows counts."""
    once = sketches.groupBy("batch", "seq", "column_name").agg(F.max_by("sketch", "n_rows").alias("sketch"), F.max("n_rows").alias("n_rows"))
    estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False)))
    return once.groupBy("seq", "column_name").agg(F.sum("n_rows").alias("n_rows"), estimate.alias("cardinality"))


def index_stats(index_rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    """One row per index from one row per index column; the last column's cardinality counts."""
    cols = F.array_sort(F.collect_list(F.struct("seq", "column_name", "cardinality", "non_unique", "index_type")))
    grouped = index_rows.groupBy("table_name", "index_name").agg(cols.alias("c"))
    joined = grouped.join(table_rows.select("table_name", "estimated_rows"), "table_name", "left")
    rows = F.coalesce("estimated_rows", F.lit(0))
    card = F.element_at("c", -1)["cardinality"]
    selectivity = F.when((rows > 0) & card.isNotNull(), F.round(card / rows, 4)).otherwise(0.0)
    return joined.select(
        "table_name",
        "index_name",
        F.array_join(F.transform("c", lambda x: x["column_name"]), ", ").alias("columns"),
        card.alias("cardinality"),
        (F.element_at("c", 1)["non_unique"] == 0).alias("is_unique"),
        F.element_at("c", 1)["index_type"].alias("index_type"),
        rows.alias("table_rows"),
        selectivity.alias("selectivity"),
    )


def index_stats_text(stats: DataFrame) -> DataFrame:
    """Index section text per table, indexes in name order."""
    line = F.format_string(
        "-- Index: %s | Columns: %s | Cardinality: %s | Unique: %s | Type: %s | Selectivity: %.4f",
        "index_name",
        "columns",
        F.coalesce(F.col("cardinality").cast("string"), F.lit("N/A")),
        F.when(F.col("is_unique"), "YES").otherwise("NO"),
        F.coalesce("index_type", F.lit("N/A")),
        "selectivity",
    )
    lines = stats.withColumn("line", line).groupBy("table_name").agg(
        F.max("table_rows").alias("rows"),
        F.array_sort(F.collect_list(F.struct("index_name", "line"))).alias("ls"),
    )
    head = F.format_string(f"{dt.INDEX_MARKER}\n-- Table Rows: %d\n", "rows")
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return lines.select("table_name", F.concat(head, body, F.lit("\n")).alias("index_stats"))


def ddl_drift(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per table: new, deleted, changed or same. Local is (table_name, content), remote (table_name, rows, ddl).

    Only the DDL is compared; a different row estimate shows in ``rows_drift``. A remote table without
    DDL could not be read and counts as ``unread``.
    """
    mine = local.select(
        "table_name",
        F.lit(True).alias("_local"),
        dt.bare_ddl(F.col("content")).alias("_ddl"),
        dt.estimated_rows(F.col("content")).alias("_rows"),
    )
    theirs = remote.select("table_name", F.lit(True).alias("_remote"), "ddl", "rows")
    state = (
        F.when(F.col("_local").isNull(), "new")
        .when(F.col("_remote").isNull(), "deleted")
        .when(F.col("ddl").isNull(), "unread")
        .when(F.col("_ddl") != dt.strip_all(F.col("ddl")), "changed")
        .otherwise("same")
    )
    both = F.col("_local") & F.col("_remote")
    return mine.join(theirs, "table_name", "full_outer").select(
        "table_name", state.alias("drift"), F.coalesce(both & (F.col("_rows") != F.col("rows")), F.lit(False)).alias("rows_drift")
    )


def _first_tables(local: DataFrame, limit: int) -> DataFrame:
    return local if limit <= 0 else local.orderBy("table_name").limit(limit)


def ddl_refresh(local: DataFrame, remote: DataFrame, limit: int = -1) -> DataFrame:
    """Local files with the DDL section replaced and the index section kept.

    ``outcome`` is failed (no remote DDL, file untouched), updated or unchanged. A positive ``limit``
    refreshes the first tables by name.
    """
    picked = _first_tables(local, limit)
    section = dt.table_file(F.col("rows"), F.col("ddl"))
    index = dt.index_section(F.col("content"))
    no_ddl = tx.is_blank(F.col("ddl"))
    fresh = F.when(index.isNotNull(), F.concat(section, F.lit("\n"), index)).otherwise(section)
    outcome = (
        F.when(no_ddl, "failed")
        .when(dt.bare_ddl(F.col("content")) != dt.strip_all(F.col("ddl")), "updated")
        .otherwise("unchanged")
    )
    return picked.join(remote, "table_name", "left").select(
        "table_name", F.when(no_ddl, F.col("content")).otherwise(fresh).alias("content"), outcome.alias("outcome")
    )


def index_stats_refresh(local: DataFrame, stats_text: DataFrame, limit: int = -1) -> DataFrame:
    """Local files with the index section replaced and the DDL section kept; null-safe change test."""
    picked = _first_tables(local, limit)
    ddl = F.concat(dt.ddl_section(F.col("content")), F.lit("\n"))
    new_index = F.col("index_stats")
    changed = ~dt.index_section(F.col("content")).eqNullSafe(dt.strip_all(new_index))
    content = F.when(new_index.isNotNull(), F.concat(ddl, F.lit("\n"), new_index)).otherwise(ddl)
    return picked.join(stats_text, "table_name", "left").select(
        "table_name", content.alias("content"), changed.alias("changed")
    )


def collect_all_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Full collection: a remote table counts as changed when it is absent locally or its DDL differs."""
    mine = local.select("table_name", dt.bare_ddl(F.col("content")).alias("_ddl"))
    no_ddl = tx.is_blank(F.col("ddl"))
    outcome = (
        F.when(no_ddl, "failed")
        .when(~F.col("_ddl").eqNullSafe(dt.strip_all(F.col("ddl"))), "changed")
        .otherwise("unchanged")
    )
    return remote.join(mine, "table_name", "left").select("table_name", outcome.alias("outcome"))


def with_table_refs(statements: DataFrame, sql: str = "sql_normalized") -> DataFrame:
    """Adds ``table_refs``, the tables a statement names."""
    return statements.withColumn("table_refs", tx.table_refs(F.col(sql)))


def resolve_names(names: DataFrame, meta: DataFrame) -> DataFrame:
    """(table_ref) to ``table_ref, base_table, ...meta``: exact name first, else without a shard suffix.

    Both candidates of a name are looked up in one join, so the metadata is read once. Works on distinct names, so it costs the number of tables and not the number of statements.
    """
    details = [c for c in meta.columns if c != "table_name"]
    options = F.array(
        F.struct(F.lit(0).alias("rank"), F.lower("table_ref").alias("_name")),
        F.struct(F.lit(1).alias("rank"), tx.shard_base(F.col("table_ref")).alias("_name")),
    )
    wanted = names.select("table_ref", F.inline(options)).filter(F.col("_name").isNotNull())
    packed = meta.select(F.lower("table_name").alias("_name"), F.struct("table_name", *details).alias("m"))
    best = wanted.join(packed, "_name").groupBy("table_ref").agg(F.min(F.struct("rank", "m")).alias("b"))
    found = best.select(
        "table_ref", F.col("b.m.table_name").alias("base_table"), *[F.col(f"b.m.{c}").alias(c) for c in details]
    )
    return names.join(found, "table_ref", "left")


def reference_sets(statements: DataFrame) -> DataFrame:
    """Distinct sets of referenced tables, exploded to ``table_refs, pos, table_ref``."""
    sets = statements.select("table_refs").distinct()
    return sets.select("table_refs", F.posexplode("table_refs").alias("pos", "table_ref"))


def resolve_sets(statements: DataFrame, meta: DataFrame) -> DataFrame:
    """``table_refs, pos, table_ref, base_table, ...`` for every distinct reference set."""
    sets = reference_sets(statements)
    names = resolve_names(sets.select("table_ref").distinct(), meta).filter(F.col("base_table").isNotNull())
    return sets.join(names, "table_ref")


def _context_block(rows: Column, ddl: Column, stats: Column, ref: Column, base: Column) -> Column:
    shard = base != ref
    title = F.when(shard, F.concat(ref, F.lit(" → base: "), base, F.lit(SHARD_NOTE))).otherwise(ref)
    note = F.when(rows > 0, F.format_string(ROWS_NOTE, rows)).otherwise("")
    head = F.when(rows > 0, F.format_string(f"{dt.ROWS_HEADER}%d\n\n", rows)).otherwise("")
    tail = F.when(~tx.is_blank(stats), F.concat(F.lit("\n\n"), stats)).otherwise("")
    body = dt.strip_all(F.concat(head, ddl, tail))
    return F.concat(F.lit("### "), title, note, F.lit("\n```sql\n"), body, F.lit("\n```"))


def ddl_context(statements: DataFrame, meta: DataFrame, id_col: str = "stmt_id") -> DataFrame:
    """Statements with ``ddl_context``, the text on all tables they name, '' when none is known.

    ``statements`` has ``table_refs``; ``meta`` is ``table_name, estimated_rows, ddl_text, index_stats``.
    The text depends on the set of tables only, so it is built once per distinct set.
    """
    hits = resolve_sets(statements, meta).filter(F.col("ddl_text").isNotNull())
    once = hits.groupBy("table_refs", F.lower("base_table").alias("base_table")).agg(
        F.min(F.struct("pos", "table_ref", F.coalesce("estimated_rows", F.lit(0)).alias("rows"), "ddl_text", "index_stats")).alias("h")
    )
    block = _context_block(F.col("h.rows"), F.col("h.ddl_text"), F.col("h.index_stats"), F.col("h.table_ref"), F.col("base_table"))
    texts = once.groupBy("table_refs").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("h.pos", block.alias("block")))), lambda x: x["block"]),
            "\n\n",
        ).alias("_body")
    )
    text = F.when(F.col("_body").isNotNull(), F.concat(F.lit(f"{CONTEXT_TITLE}\n\n"), F.col("_body"))).otherwise("")
    return salted_lookup(statements, texts, ["table_refs"], id_col).withColumn("ddl_context", text).drop("_body")


def affected_statements(statements: DataFrame, changed_tables: DataFrame) -> DataFrame:
    """Active statements that name a changed table."""
    changed = changed_tables.select(F.lower("table_name").alias("table_ref")).distinct()
    sets = reference_sets(statements).join(changed, "table_ref", "left_semi").select("table_refs").distinct()
    return statements.filter("status = 1").join(sets, "table_refs", "left_semi")
