"""Report queries over projects, records, analyses and scans."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.inventory import latest_analysis

# Codes counted in overviews.
LEVELS = ["P0", "P1", "P2", "P3", "P4"]
STATUSES = ["PENDING", "ANALYZED", "CONFIRMED", "FIXED", "IGNORED"]
UNRATED = "未分析"


def paginate(df: DataFrame, order: list[Column], current: int = 1, size: int = 20) -> DataFrame:
    """One page; ``order`` should end in a unique column. Spark keeps only the first rows per partition."""
    return df.orderBy(*order).offset((max(current, 1) - 1) * size).limit(size)


def total(df: DataFrame) -> DataFrame:
    """The number of rows a page is cut from."""
    return df.agg(F.count("*").alias("total"))


def _one_row(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Aggregates of several tables side by side: one row each, zero elsewhere, then summed."""
    names = [n for _, aggs in parts for n in aggs]
    rows = [
        df.agg(*[c.alias(n) for n, c in aggs.items()]).select(
            *[F.col(n) if n in aggs else F.lit(0).cast("long").alias(n) for n in names]
        )
        for df, aggs in parts
    ]
    return reduce(DataFrame.unionByName, rows).agg(*[F.sum(n).alias(n) for n in names])


def dashboard_overview(projects: DataFrame, records: DataFrame, batches: DataFrame, analyses: DataFrame, latest_only: bool = False) -> DataFrame:
    """Counts of active projects and statements, scans, risky and pending analyses.

    All analyses count, also older ones and those of retired statements, unless ``latest_only``.
    """
    rated = _current(analyses, records) if latest_only else analyses
    level = F.col("final_risk_level")
    return _one_row(
        [
            (projects, {"project_count": F.count_if(F.col("status") == 1)}),
            (records, {"total_sql_count": F.count_if(F.col("status") == 1)}),
            (batches, {"total_scan_count": F.count("*")}),
            (
                rated,
                {
                    "risk_sql_count": F.count_if(level.isin("P0", "P1", "P2")),
                    "pending_count": F.count_if((F.col("handle_status") == "ANALYZED") & level.isin("P0", "P1")),
                },
            ),
        ]
    )


def _current(analyses: DataFrame, records: DataFrame) -> DataFrame:
    active = records.filter("status = 1").select(F.col("id").alias("sql_record_id"))
    return latest_analysis(analyses).join(active, "sql_record_id", "left_semi")


def risk_overview(records: DataFrame, analyses: DataFrame) -> DataFrame:
    """Totals and one count per level and status, zero where there is none."""
    by_level = {f"risk_{v}": F.count_if(F.col("final_risk_level") == v) for v in LEVELS}
    by_status = {f"status_{v}": F.count_if(F.col("handle_status") == v) for v in STATUSES}
    return _one_row(
        [
            (records, {"total_sql_records": F.count_if(F.col("status") == 1)}),
            (analyses, {"total_analyses": F.count("*"), **by_level, **by_status}),
        ]
    )


def active_projects(projects: DataFrame) -> DataFrame:
    """Id and name of the active projects."""
    return projects.filter("status = 1").select("id", "project_name")


def _text_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None or not value.strip() else df.filter(F.col(column) == value)


def _project_names(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), "project_name")


# what an analysis says besides its level, as far as the table has it
ADVICE = ["ai_analysis", "ai_index_suggestion", "ai_rewrite_suggestion", "ai_estimated_scan_rows"]


def risky_statements(
    analyses: DataFrame, records: DataFrame, projects: DataFrame, level: str | None = None, status: str | None = None, limit: int | None = None
) -> DataFrame:
    """Analyses by level, newest first, with their statement; 20 by default.

    The first rows are cut before the joins.
    """
    size = 20 if limit is None or limit <= 0 else limit
    rows = _text_filter(analyses, "final_risk_level", level and level.strip().upper())
    rows = _text_filter(rows, "handle_status", status and status.strip().upper())
    top = rows.orderBy(F.col("final_risk_level"), F.col("create_time").desc(), F.col("id").desc()).limit(size)
    stmts = records.select(
        F.col("id").alias("sql_record_id"), "project_id", "sql_type", "source_file", "source_location", "source_type",
        tx.truncate_ellipsis(F.col("sql_text"), 500).alias("sql_text"),
    )
    return (
        top.select(
            F.col("id").alias("analysis_id"), "sql_record_id", "final_risk_level", "handle_status", "ai_model", "create_time",
            *[c for c in ADVICE if c in analyses.columns],
        )
        .join(stmts, "sql_record_id", "left")
        .join(_project_names(projects), "project_id", "left")
    )


def analysis_detail(analyses: DataFrame, records_with_context: DataFrame, projects: DataFrame) -> DataFrame:
    """Analyses with statement, project and table context where known."""
    stmts = records_with_context.select(
        F.col("id").alias("sql_record_id"), "project_id", "sql_text", "sql_type", "source_file", "source_location", "owner",
        F.nullif("ddl_context", F.lit("")).alias("table_context"),
    )
    return analyses.join(stmts, "sql_record_id", "left").join(_project_names(projects), "project_id", "left")


def project_list(projects: DataFrame, records: DataFrame) -> DataFrame:
    """Active projects with their number of active statements."""
    counts = records.filter("status = 1").groupBy("project_id").agg(F.count("*").alias("active_sql_count"))
    return (
        projects.filter("status = 1")
        .join(counts, projects["id"] == counts["project_id"], "left")
        .select(
            projects["id"].alias("project_id"), "project_name", "git_remote_url", "git_branch", "last_scan_commit",
            F.coalesce("active_sql_count", F.lit(0)).alias("active_sql_count"),
        )
    )


def keyword_search(records: DataFrame, analyses: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    """Active statements with the keyword in text, file or location, newest first; 10 by default.

    ``records`` has ``update_time``. Only the found records' analyses are looked up.
    """
    size = 10 if limit is None or limit <= 0 else limit
    word = F.lit(keyword.strip())
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, word), F.lit(False)) for c in ("sql_text", "source_file", "source_location")])
    found = records.filter((F.col("status") == 1) & hit).orderBy(F.col("update_time").desc(), F.col("id").desc()).limit(size)
    cols = ["sql_record_id", "create_time", "id", "final_risk_level", "handle_status", "ai_analysis"]
    ids = found.select(F.col("id").alias("sql_record_id"))
    latest = latest_analysis(analyses.select(*cols).join(ids, "sql_record_id", "left_semi"))
    rated = latest.select(
        F.col("sql_record_id").alias("id"), "final_risk_level", "handle_status",
        tx.truncate_ellipsis(F.col("ai_analysis"), 200).alias("brief_analysis"),
    )
    return found.join(rated, "id", "left").select(
        F.col("id").alias("record_id"),
        tx.truncate_ellipsis(F.col("sql_text"), 300).alias("sql_text"),
        "sql_type", "source_type", "source_file", "source_location",
        F.when(F.col("final_risk_level").isNull(), UNRATED).otherwise(F.col("final_risk_level")).alias("risk_level"),
        "handle_status", "brief_analysis",
    )


def analysis_filter(
    analyses: DataFrame, records: DataFrame, project_id: int | None = None, level: str | None = None, status: str | None = None,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Analyses of a project's active statements, by level, status and time (both ends included)."""
    rows = _text_filter(_text_filter(analyses, "final_risk_level", level), "handle_status", status)
    if start is not None:
        rows = rows.filter(F.col("create_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("create_time") <= F.lit(end).cast("timestamp_ntz"))
    if project_id is not None:
        ids = records.filter((F.col("project_id") == project_id) & (F.col("status") == 1)).select(F.col("id").alias("sql_record_id"))
        rows = rows.join(ids, "sql_record_id", "left_semi")
    return rows


def newest_first(time: str = "create_time") -> list[Column]:
    return [F.col(time).desc(), F.col("id").desc()]


def batch_page(analyses: DataFrame, batch_id: int, current: int = 1, size: int = 20) -> DataFrame:
    """A page of one scan's analyses, worst level first."""
    rows = analyses.filter(F.col("scan_batch_id") == batch_id)
    return paginate(rows, [F.col("final_risk_level"), F.col("id")], current, size)


def record_filter(
    records: DataFrame, project_id: int | None = None, sql_type: str | None = None, source_type: str | None = None, owner: str | None = None
) -> DataFrame:
    """Active records by project, type, source and part of the owner's name."""
    rows = records.filter("status = 1")
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    rows = _text_filter(_text_filter(rows, "sql_type", sql_type), "source_type", source_type)
    return rows.filter(F.contains("owner", F.lit(owner))) if owner and owner.strip() else rows


def scan_history(batches: DataFrame) -> DataFrame:
    """Scans with their duration in both readable forms."""
    ms = F.col("scan_duration_ms")
    return batches.withColumn("duration", tx.duration_text(ms)).withColumn("duration_short", tx.duration_decimal(ms))


def analysis_with_owner(analyses: DataFrame, records: DataFrame) -> DataFrame:
    """Analyses with the owner of their statement, ``-`` when there is none."""
    owners = records.select(F.col("id").alias("sql_record_id"), F.col("owner").alias("_owner"))
    return analyses.join(owners, "sql_record_id", "left").withColumn("owner", F.coalesce("_owner", F.lit("-"))).drop("_owner")


def handle_status_apply(analyses: DataFrame, changes: DataFrame) -> DataFrame:
    """Analyses with the newest change per id applied (status, note, handler, time).

    ``changes`` is ``id, change_id, handle_status, handle_note, handler, handle_time``.
    """
    values = ["handle_status", "handle_note", "handler", "handle_time"]
    newest = changes.groupBy("id").agg(F.max(F.struct("handle_time", "change_id", "handle_status", "handle_note", "handler")).alias("n"))
    joined = analyses.join(newest, "id", "left")
    for v in values:
        old = F.col(v) if v in analyses.columns else F.lit(None)
        joined = joined.withColumn(v, F.coalesce(F.col("n").getField(v), old))
    return joined.drop("n")


def catalog_list(df: DataFrame, filters: dict[str, object], contains: dict[str, str], order: list[Column]) -> DataFrame:
    """Rows that equal and contain the given values, sorted; blank parameters do not filter."""
    for name, value in filters.items():
        if value is not None and str(value).strip():
            df = df.filter(F.col(name) == value)
    for name, part in contains.items():
        if part and part.strip():
            df = df.filter(F.contains(name, F.lit(part.strip())))
    return df.orderBy(*order)


def trailing_window_counts(analyses: DataFrame, as_of: Column | None = None, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Analyses per level within the last days before ``as_of``, by default the newest row's time."""
    now = analyses.agg(F.max("create_time")).scalar() if as_of is None else as_of
    counts = [F.count_if(F.col("create_time") >= now - F.lit(timedelta(days=d))).alias(f"last_{d}d") for d in days]
    return analyses.groupBy("final_risk_level").agg(*counts)
