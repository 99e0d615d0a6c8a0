"""Who owns a statement, and the notices sent about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators.inventory import latest_analysis
from querywarden.operators.lookups import salted_lookup
from querywarden.operators.ranking import pick_last

# Wording of notices.
UNRATED = "未分析"
UNKNOWN_PROJECT = "未知项目"
PLEASE = "请尽快处理，谢谢！"


def file_last_author(commit_files: DataFrame) -> DataFrame:
    """(path, author) of the newest commit that touched a file; the higher commit id wins a tie."""
    rows = commit_files.select("path", "author", "commit_time", "commit_id")
    return pick_last(rows, ["path"], ["commit_time", "commit_id"]).select("path", "author")


def owner_resolve(authors: DataFrame, owner_map: DataFrame, default_owner: str) -> DataFrame:
    """Adds ``owner`` by the author's name in any case, else the default."""
    names = owner_map.select(F.lower("git_name").alias("_name"), F.col("owner").alias("_owner"))
    return (
        authors.join(names, F.lower(authors["author"]) == F.col("_name"), "left")
        .withColumn("owner", F.coalesce("_owner", F.lit(default_owner)))
        .drop("_name", "_owner")
    )


def fill_missing_owners(
    records: DataFrame, commit_files: DataFrame, owner_map: DataFrame, default_owner: str, project_id: int | None = None
) -> DataFrame:
    """Active records without owner take the one of their file; ``filled`` says which were."""
    owners = owner_resolve(file_last_author(commit_files), owner_map, default_owner)
    by_file = owners.select(F.col("path").alias("source_file"), F.col("owner").alias("_file_owner"))
    missing = (F.col("status") == 1) & (F.coalesce("owner", F.lit("")) == "")
    if project_id is not None:
        missing = missing & (F.col("project_id") == project_id)
    return (
        salted_lookup(records.withColumn("filled", missing), by_file, ["source_file"], "id")
        .withColumn("owner", F.when(F.col("filled"), F.coalesce("_file_owner", F.lit(default_owner))).otherwise(F.col("owner")))
        .drop("_file_owner")
    )


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"> **{label}：** "), value, F.lit("\n"))


def remind_message(
    records: DataFrame,
    analyses: DataFrame,
    projects: DataFrame,
    owner_map: DataFrame,
    frontend_url: str,
    title: str = "风险 SQL 提醒",
) -> DataFrame:
    """(id, message): the notice to the owner of each record."""
    levels = latest_analysis(analyses.select("sql_record_id", "create_time", "id", "final_risk_level")).select(
        F.col("sql_record_id").alias("id"), "final_risk_level"
    )
    names = projects.select(F.col("id").alias("project_id"), "project_name")
    mentions = owner_map.groupBy(F.lower("owner").alias("_owner")).agg(F.max("mention_id").alias("mention_id"))
    rows = (
        records.join(levels, "id", "left")
        .join(names, "project_id", "left")
        .join(mentions, F.lower("owner") == F.col("_owner"), "left")
    )
    mention = F.coalesce("mention_id", "owner")
    level = F.coalesce("final_risk_level", F.lit(UNRATED))
    link = F.concat(F.lit(f"> [查看详情]({frontend_url}/#/sql-records?recordId="), F.col("id").cast("string"), F.lit(")\n"))
    ending = F.when(tx.is_blank(mention), f"\n{PLEASE}").otherwise(
        F.concat(F.lit(" \n <@"), mention, F.lit(f"> {PLEASE}"))
    )
    message = F.concat(
        F.lit(f"### {title}\n"),
        _line("项目", F.coalesce("project_name", F.lit(UNKNOWN_PROJECT))),
        _line("风险等级", F.concat(F.lit('<font color="warning">'), level, F.lit("</font>"))),
        _line("来源", F.col("source_location")),
        _line("SQL", F.concat(F.lit("`"), tx.truncate_ellipsis(F.col("sql_text"), 200), F.lit("`"))),
        link,
        ending,
    )
    return rows.select("id", message.alias("message"))


def scan_message(
    batches: DataFrame, projects: DataFrame, owner_map: DataFrame, done: str = "### ✅ 扫描完成", failed: str = "### ❌ 扫描失败"
) -> DataFrame:
    """(id, message): the notice about each finished scan; counts only when it completed."""
    names = projects.select(F.col("id").alias("project_id"), "project_name")
    mentions = owner_map.groupBy(F.lower("git_name").alias("_git")).agg(F.max("mention_id").alias("mention_id"))
    rows = batches.join(names, "project_id", "left").join(mentions, F.lower("git_author") == F.col("_git"), "left")
    ok = F.col("status") == "COMPLETED"
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    risk = F.coalesce("risk_sql_count", F.lit(0))
    risk_line = F.when(
        risk > 0, F.concat(F.lit('> **<font color="warning">风险 SQL：'), risk.cast("string"), F.lit("</font>**\n"))
    ).otherwise(F.lit("> **风险 SQL：** 0\n"))
    counts = F.concat(_line("SQL 总数", number("total_sql_count")), _line("新发现", number("new_sql_count")), risk_line)
    message = F.concat(
        F.when(ok, f"{done}\n").otherwise(f"{failed}\n"),
        _line("项目", F.coalesce("project_name", F.lit(UNKNOWN_PROJECT))),
        _line("类型", F.col("scan_type")),
        F.coalesce(_line("耗时", tx.duration_text(F.col("scan_duration_ms"))), F.lit("")),
        F.when(ok, counts).otherwise(""),
        F.coalesce(_line("提交者", F.col("git_author")), F.lit("")),
        F.coalesce(F.concat(F.lit(" \n <@"), F.col("mention_id"), F.lit(">")), F.lit("")),
    )
    return rows.select("id", message.alias("message"))
