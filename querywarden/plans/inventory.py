"""Queries on the statement inventory."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators import changes, inventory as inv
from querywarden.operators.expiry import assess_with_ttl
from querywarden.plans.inputs import Inputs
from querywarden.plans.oracle_parts import FP, LATEST, NORM, SCANS, first_of
from querywarden.plans.registry import query
from querywarden.session import cut_lineage

INV_COLS = ["id", "project_id", "sql_hash", "sql_text", "source_file", "source_location"]


def fingerprinted(inp: Inputs):
    return inv.with_fingerprint(inp.get("statements", spread=True))


def fingerprinted_once(inp: Inputs):
    """The same, stored: two scans are compared in a query."""
    return inp.once("fingerprinted", lambda: fingerprinted(inp))


def existing_inventory(inp: Inputs):
    """Active records of an earlier scan (scan 1), a stored table; the id is that of the first statement."""
    kept = inv.first_occurrence(fingerprinted_once(inp).filter("o_custkey % 7 <> 0"))
    one = F.lit(1).cast("long")
    rows = kept.withColumnRenamed("stmt_id", "id").select(
        *INV_COLS, F.lit(1).alias("status"), one.alias("first_scan_id"), one.alias("last_scan_id")
    )
    return cut_lineage(rows, "inventory")


def current_scan(inp: Inputs):
    return inv.first_occurrence(fingerprinted_once(inp).filter("o_custkey % 5 <> 0"))


@query(
    "statement_union",
    """select case when source_type in ('QUERY_WRAPPER', 'LAMBDA_WRAPPER') then 'WRAPPER' else source_type end as source_kind,
  count(*) as statements from statements group by 1""",
)
def statement_union(inp):
    st = inp.get("statements")
    kinds = ["MAPPER_XML", "ANNOTATION", "QUERY_WRAPPER", "LAMBDA_WRAPPER"]
    return inv.count_by_source(inv.statement_union(*[st.filter(F.col("source_type") == k) for k in kinds]))


@query("sql_normalize", f"select stmt_id, {NORM} as sql_normalized from statements")
def sql_normalize(inp):
    return inp.get("statements").select("stmt_id", tx.normalize_sql(F.col("sql_text")).alias("sql_normalized"))


@query("sql_fingerprint", "select stmt_id, sql_hash from fp", FP)
def sql_fingerprint(inp):
    return fingerprinted(inp).select("stmt_id", "sql_hash")


@query("first_occurrence_dedup", f"select project_id, sql_hash, stmt_id, source_file from ({first_of()})", FP)
def first_occurrence_dedup(inp):
    return inv.first_occurrence(fingerprinted(inp)).select("project_id", "sql_hash", "stmt_id", "source_file")


@query(
    "statement_delta",
    """select coalesce(s.project_id, i.project_id) as project_id, coalesce(s.sql_hash, i.sql_hash) as sql_hash,
  case when i.id is null then 'new' when s.stmt_id is null then 'removed' else 'unchanged' end as delta
from scan s full outer join inv i on s.project_id = i.project_id and s.sql_hash = i.sql_hash""",
    SCANS,
)
def statement_delta(inp):
    return inv.statement_delta(current_scan(inp), existing_inventory(inp))


FULL = {
    **SCANS,
    "upserted": """
select i.id, i.project_id, i.sql_hash, coalesce(s.source_file, i.source_file) as source_file,
  coalesce(s.source_location, i.source_location) as source_location,
  case when s.stmt_id is null then 0 else 1 end as status, 1 as first_scan_id,
  case when s.stmt_id is null then 1 else 2 end as last_scan_id,
  case when s.stmt_id is null then 'retired' else 'refreshed' end as change
from inv i left join scan s on s.project_id = i.project_id and s.sql_hash = i.sql_hash
union all
select (select max(id) from inv) + row_number() over (order by s.sql_hash, s.project_id), s.project_id, s.sql_hash,
  s.source_file, s.source_location, 1, 2, 2, 'new'
from scan s anti join inv i on s.project_id = i.project_id and s.sql_hash = i.sql_hash""",
}


def full_upserted(inp: Inputs):
    return inv.full_scan_upsert(existing_inventory(inp), cut_lineage(current_scan(inp), "scan"), 2)


@query("full_scan_upsert", "select * from upserted", FULL)
def full_scan_upsert(inp):
    return full_upserted(inp).drop("sql_text")


@query(
    "scan_batch_summary",
    """select project_id, count(*) filter (where change in ('new', 'refreshed')) as total_sql,
  count(*) filter (where change = 'new') as new_sql, cast(0 as bigint) as changed_sql,
  count(*) filter (where change = 'retired') as removed_sql,
  count(*) filter (where change in ('new', 'refreshed') and final_risk_level in ('P0', 'P1', 'P2')) as risk_sql
from upserted u left join latest l on l.sql_record_id = u.id group by project_id""",
    {**FULL, **LATEST},
)
def scan_batch_summary(inp):
    return inv.scan_batch_summary(full_upserted(inp), inv.latest_analysis(inp.get("analyses")))


CHANGED = """
select distinct project_id, source_file,
  case o_custkey % 3 when 0 then 'MODIFY' when 1 then 'DELETE' else 'ADD' end as change_type
from statements where o_custkey % 4 = 0"""


@query(
    "incremental_scan_upsert",
    """select id, project_id, sql_hash, source_file, case when change = 'retired' then 0 else 1 end as status,
  1 as first_scan_id, case when change = 'refreshed' then 3 else 1 end as last_scan_id, change from judged
union all
select (select max(id) from inv) + row_number() over (order by sql_hash, project_id), project_id, sql_hash, source_file,
  1, 3, 3, 'new' from inc_scan s where not exists (select 1 from judged j where j.project_id = s.project_id
  and j.sql_hash = s.sql_hash and j.change <> 'retired')""",
    {
        **SCANS,
        "changed": CHANGED,
        "inc_fp": """select * from fp semi join (select distinct project_id, source_file from changed
  where change_type <> 'DELETE') c using (project_id, source_file) where o_custkey % 5 <> 0""",
        "inc_scan": first_of().replace("from fp", "from inc_fp"),
        "marks": "select project_id, source_file, bool_or(change_type = 'DELETE') as gone from changed group by all",
        "judged": """
select i.*, case when m.gone then 'retired' when m.gone is not null and s.stmt_id is null then 'retired'
  when s.stmt_id is not null then 'refreshed' else 'kept' end as change
from inv i left join marks m using (project_id, source_file)
left join inc_scan s on s.project_id = i.project_id and s.sql_hash = i.sql_hash""",
    },
)
def incremental_scan_upsert(inp):
    changed = inp.sql(CHANGED)
    touched = changed.filter("change_type <> 'DELETE'").select("project_id", "source_file").distinct()
    part = fingerprinted_once(inp).filter("o_custkey % 5 <> 0").join(touched, ["project_id", "source_file"], "left_semi")
    scan = cut_lineage(inv.first_occurrence(part), "scan")
    out = inv.incremental_scan_upsert(existing_inventory(inp), scan, changed, 3)
    return out.drop("sql_text", "source_location")


DELETED = "select distinct cast(s_nationkey as bigint) as project_id, concat('src/m', cast(s_suppkey % 200 as string), '.java') as source_file from supplier"


@query(
    "retire_by_deleted_file",
    """select r.id, case when d.project_id is not null then 0 else r.status end as status,
  d.project_id is not null and r.status = 1 as retired_now
from sql_records r left join deleted d on d.project_id = r.project_id and d.source_file = r.source_file""",
    {"deleted": DELETED},
)
def retire_by_deleted_file(inp):
    out = inv.retire_by_deleted_file(inp.get("sql_records"), inp.sql(DELETED))
    return out.select("id", "status", "retired_now")


@query(
    "latest_analysis",
    "select sql_record_id, id, create_time, final_risk_level, handle_status from latest",
    LATEST,
)
def latest_analysis(inp):
    cols = ["sql_record_id", "id", "create_time", "final_risk_level", "handle_status"]
    return inv.latest_analysis(inp.get("analyses").select(*cols))


@query(
    "reuse_prior_analysis",
    """select r.id as sql_record_id, p.prior_record_id, l.final_risk_level, l.ai_model, cast(0 as bigint) as ai_tokens_used,
  'ANALYZED' as handle_status, concat('Reused from prior analysis (record #', p.prior_record_id, ')') as handle_note
from sql_records r join (select sql_hash, min(r2.id) as prior_record_id from sql_records r2
    where status = 1 and exists (select 1 from latest l where l.sql_record_id = r2.id) group by sql_hash) p using (sql_hash)
join latest l on l.sql_record_id = p.prior_record_id
where r.status = 1 and not exists (select 1 from latest l2 where l2.sql_record_id = r.id)""",
    LATEST,
)
def reuse_prior_analysis(inp):
    return inv.reuse_prior_analysis(inp.get("sql_records"), inp.get("analyses"))


@query(
    "reuse_within_ttl",
    """select event_id, user_id, count(*) over (partition by user_id order by ts
  range between interval 86399999999 microseconds preceding and interval 1 microsecond preceding) > 0 as reused from events""",
)
def reuse_within_ttl(inp):
    rows = inp.table("events").select("event_id", "user_id", "ts")
    return inv.seen_within_ttl(rows, "user_id", "ts").select("event_id", "user_id", "reused")


@query(
    "reuse_within_ttl_short",
    """select event_id, user_id, count(*) over (partition by user_id order by ts
  range between interval 599999999 microseconds preceding and interval 1 microsecond preceding) > 0 as reused from events""",
)
def reuse_within_ttl_short(inp):
    rows = inp.table("events").select("event_id", "user_id", "ts")
    return inv.seen_within_ttl(rows, "user_id", "ts", timedelta(minutes=10)).select("event_id", "user_id", "reused")


def expiry_chain(ttl: str) -> dict[str, str]:
    return {
        "chain": f"""
select user_id, min(ts) as assessed_at from events group by user_id
union all
select c.user_id, (select min(e.ts) from events e where e.user_id = c.user_id and e.ts >= c.assessed_at + interval {ttl})
from chain c where exists (select 1 from events e where e.user_id = c.user_id and e.ts >= c.assessed_at + interval {ttl})"""
    }


@query("reuse_within_ttl_exact", "select user_id, assessed_at from chain", expiry_chain("24 hours"))
def reuse_within_ttl_exact(inp):
    return assess_with_ttl(inp.table("events").select("user_id", "ts"), "user_id", "ts")


@query("reuse_within_ttl_exact_short", "select user_id, assessed_at from chain", expiry_chain("10 minutes"))
def reuse_within_ttl_exact_short(inp):
    return assess_with_ttl(inp.table("events").select("user_id", "ts"), "user_id", "ts", timedelta(minutes=10))


@query(
    "analysis_budget",
    """select project_id, stmt_id, cast(budget_rank as bigint) as budget_rank from (
  select *, row_number() over (partition by project_id order by scan_ord, source_file, source_location, stmt_id) as budget_rank from scan)
where budget_rank <= 20""",
    SCANS,
)
def analysis_budget(inp):
    out = inv.analysis_budget(current_scan(inp), 20)
    return out.select("project_id", "stmt_id", F.col("budget_rank").cast("long").alias("budget_rank"))


HEADS = """
select p.*, h.head_commit, p.id % 10 = 0 as forced from projects p
left join (select cast(s_nationkey as bigint) as id, md5(max(s_name)) as head_commit from supplier group by s_nationkey) h on h.id = p.id"""


@query(
    "scan_mode_decide",
    """select id, case when forced or last_scan_commit is null or head_commit is null then 'FULL' else 'INCREMENTAL' end as scan_type
from heads""",
    {"heads": HEADS},
)
def scan_mode_decide(inp):
    return inv.scan_mode(inp.sql(HEADS), F.col("forced")).select("id", "scan_type")


UNKNOWN = "status = 1 and contains(sql_text, '_unknown')"


@query(
    "retire_unknown",
    f"select id, case when {UNKNOWN} then 0 else status end as status, {UNKNOWN} as retired_now from sql_records",
)
def retire_unknown(inp):
    return inv.retire_unknown(inp.get("sql_records")).select("id", "status", "retired_now")


@query(
    "retire_duplicates",
    """select a.id, case when a.st = 1 and k.id is null then 0 else a.st end as status, a.st = 1 and k.id is null as retired_now
from alive a left join (select max(id) as id from alive where st = 1 group by project_id, sql_hash) k on k.id = a.id""",
    {"alive": f"select *, case when {UNKNOWN} then 0 else status end as st from sql_records"},
)
def retire_duplicates(inp):
    cleaned = inv.retire_unknown(inp.get("sql_records")).drop("retired_now")
    return inv.retire_duplicates(cleaned).select("id", "status", "retired_now")


@query(
    "cleanup_counts",
    """select (select count(*) from sql_records where status = 1 and contains(sql_text, '_unknown')) as unknown_removed,
  (select count(*) - count(distinct concat(project_id, ':', sql_hash)) from sql_records where status = 1 and not contains(sql_text, '_unknown')) as duplicates_removed""",
)
def cleanup_counts(inp):
    step = inv.retire_unknown(inp.get("sql_records")).withColumnRenamed("retired_now", "unknown")
    return inv.retire_duplicates(step).agg(
        F.count_if("unknown").alias("unknown_removed"), F.count_if("retired_now").alias("duplicates_removed")
    )


@query(
    "first_last_seen",
    """select project_id, sql_hash, min(o_custkey % 40) as first_scan_id, max(o_custkey % 40) as last_scan_id
from fp group by project_id, sql_hash""",
    FP,
)
def first_last_seen(inp):
    return inv.first_last_seen(fingerprinted(inp).withColumn("scan_id", F.col("o_custkey") % 40))


INCOMING = """
select table_name, estimated_rows * 2 as estimated_rows from table_meta where table_name <> 'region'
union all select concat('t_', lower(r_name)), cast(r_regionkey as bigint) from region"""


@query(
    "upsert_by_key",
    """select coalesce(i.table_name, m.table_name) as table_name, coalesce(i.estimated_rows, m.estimated_rows) as estimated_rows,
  case when m.table_name is null then 'created' when i.table_name is null then 'kept' else 'updated' end as outcome
from incoming i full outer join table_meta m on i.table_name = m.table_name""",
    {"incoming": INCOMING},
)
def upsert_by_key(inp):
    return inv.upsert_by_key(inp.get("table_meta"), inp.sql(INCOMING), "table_name")


def snapshots(inp: Inputs):
    both = inp.get("file_snapshots")
    return both.filter("snap = 'before'"), both.filter("snap = 'after'")


FILE_DELTA = {
    "delta": """
select coalesce(a.path, b.path) as path,
  case when b.path is null then 'ADD' when a.path is null then 'DELETE' else 'MODIFY' end as change_type
from (select * from file_snapshots where snap = 'after') a
full outer join (select * from file_snapshots where snap = 'before') b on a.path = b.path
where a.content_hash is distinct from b.content_hash""",
    "src": """select *, case when ends_with(path, '.xml') then 'XML' else 'JAVA' end as file_kind from delta
where (ends_with(path, '.xml') or ends_with(path, '.java')) and not contains(path, '/test/')""",
}


@query("file_snapshot_delta", "select path, change_type from delta", FILE_DELTA)
def file_snapshot_delta(inp):
    return changes.file_snapshot_delta(*snapshots(inp))


@query("delta_path_filter", "select path, change_type, file_kind from src", FILE_DELTA)
def delta_path_filter(inp):
    return changes.delta_path_filter(changes.file_snapshot_delta(*snapshots(inp)))


@query(
    "delta_summary",
    """select count(*) filter (where s.change_type <> 'DELETE' and file_kind = 'XML') as changed_xml,
  count(*) filter (where s.change_type <> 'DELETE' and file_kind = 'JAVA') as changed_java,
  count(*) filter (where s.change_type = 'DELETE' and file_kind = 'XML') as deleted_xml,
  count(*) filter (where s.change_type = 'DELETE' and file_kind = 'JAVA') as deleted_java,
  count(*) as total_changed, count(*) > 0 as has_changes
from delta d left join src s on s.path = d.path""",
    FILE_DELTA,
)
def delta_summary(inp):
    return changes.delta_summary(changes.file_snapshot_delta(*snapshots(inp)))


PATCHES = """
select concat('src/p', cast(p_partkey as string), '.java') as path,
  concat('--- a/x', chr(10), '+++ b/x', chr(10), '@@ -1 +1 @@', chr(10), repeat(concat('+new ', p_name, chr(10)), p_size % 7), ' same', chr(10), repeat(concat('-old', chr(10)), p_size % 4)) as diff,
  p_partkey % 5 = 0 as new_file, p_partkey % 7 = 0 as deleted_file, p_partkey % 3 = 0 as renamed_file, p_size
from part"""


@query(
    "patch_line_stats",
    """select concat('src/p', cast(p_partkey as string), '.java') as path,
  case when p_partkey % 7 = 0 then 'deleted' when p_partkey % 5 = 0 then 'added' when p_partkey % 3 = 0 then 'renamed' else 'modified' end as status,
  cast(p_size % 7 as bigint) as additions, cast(p_size % 4 as bigint) as deletions from part""",
)
def patch_line_stats(inp):
    return changes.patch_line_stats(inp.sql(PATCHES))
