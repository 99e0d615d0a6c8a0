"""Whole scans: from statements, without exempted ones, to the next inventory with owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from querywarden.operators import assessment as am
from querywarden.operators import exemptions as ex
from querywarden.operators import inventory as inv
from querywarden.operators import metadata as md
from querywarden.plans.assessment import ISSUES, with_issues
from querywarden.plans.enrichment import RULED
from querywarden.plans.inputs import Inputs
from querywarden.plans.inventory import CHANGED, existing_inventory, fingerprinted_once
from querywarden.plans.metadata import stats_of
from querywarden.plans.oracle_parts import SCANS, first_of
from querywarden.plans.registry import query
from querywarden.session import cut_lineage

# a scan from statements to inventory: exempted ones go first, owners come from the last author of the file
AUTHORS = "select source_file, max(concat('Dev', cast(o_custkey % 20 as string))) as owner from statements group by source_file"
RECORDS = {
    **RULED,
    **SCANS,
    "authors": AUTHORS.replace("as string", "as varchar"),
    "records": "select i.*, 'old' as owner, f.source_type, f.sql_normalized, 1 as updated from inv i join fp f on f.stmt_id = i.id",
    "allowed": "select fp.* from fp anti join (select stmt_id from ruled) r using (stmt_id)",
    "full_found": first_of("o_custkey % 5 <> 0").replace("from fp", "from allowed"),
    "full_scan": "select s.*, a.owner from full_found s left join authors a using (source_file)",
}


def records(inp: Inputs):
    """An earlier inventory with all columns of a record."""
    more = fingerprinted_once(inp).select(F.col("stmt_id").alias("id"), "source_type", "sql_normalized")
    old = existing_inventory(inp).join(more, "id")
    return cut_lineage(old.withColumn("owner", F.lit("old")).withColumn("updated", F.lit(1)), "records")


def scanned(inp: Inputs, statements, scan_id: int):
    """Distinct statements of a scan that no rule exempts, with the owners of their files."""
    named = md.with_table_refs(statements)
    allowed = ex.drop_exempt(cut_lineage(named, "found"), inp.get("exemption_rules"))
    owners = inp.sql(AUTHORS)
    found = inv.first_occurrence(allowed.drop("table_refs"))
    return cut_lineage(found.join(owners, "source_file", "left").withColumn("updated", F.lit(scan_id)), "scan")


@query(
    "full_scan_pipeline",
    """select i.id, i.project_id, i.sql_hash, coalesce(s.source_file, i.source_file) as source_file, case when s.stmt_id is null then 0 else 1 end as status,
  case when s.stmt_id is null then i.owner else s.owner end as owner, coalesce(s.source_type, i.source_type) as source_type, md5(i.sql_normalized) as text_md5,
  case when s.stmt_id is null then 1 else 2 end as updated, case when s.stmt_id is null then 'retired' else 'refreshed' end as change
from records i left join full_scan s on s.project_id = i.project_id and s.sql_hash = i.sql_hash
union all
select (select max(id) from records) + row_number() over (order by s.sql_hash, s.project_id), s.project_id, s.sql_hash, s.source_file, 1, s.owner, s.source_type,
  md5(s.sql_normalized), 2, 'new' from full_scan s anti join records i on s.project_id = i.project_id and s.sql_hash = i.sql_hash""",
    RECORDS,
)
def full_scan_pipeline(inp):
    """A newly exempted statement is not scanned, so its record is retired."""
    scan = scanned(inp, fingerprinted_once(inp).filter("o_custkey % 5 <> 0"), 2)
    out = inv.full_scan_upsert(records(inp), scan, 2)
    return out.select("id", "project_id", "sql_hash", "source_file", "status", "owner", "source_type", F.md5("sql_normalized").alias("text_md5"), "updated", "change")


@query(
    "incremental_scan_pipeline",
    """select id, project_id, sql_hash, case when change = 'retired' then 0 else 1 end as status, case when change = 'refreshed' then new_owner else owner end as owner,
  case when change = 'refreshed' then 3 else 1 end as updated, change from judged
union all
select (select max(id) from records) + row_number() over (order by sql_hash, project_id), project_id, sql_hash, 1, owner, 3, 'new'
from inc_scan s where not exists (select 1 from judged j where j.project_id = s.project_id and j.sql_hash = s.sql_hash and j.change <> 'retired')""",
    {
        **RECORDS,
        "changed": CHANGED,
        "inc_fp": """select * from allowed semi join (select distinct project_id, source_file from changed
  where change_type <> 'DELETE') c using (project_id, source_file) where o_custkey % 5 <> 0""",
        "inc_found": first_of().replace("from fp", "from inc_fp"),
        "inc_scan": "select s.*, a.owner from inc_found s left join authors a using (source_file)",
        "marks": "select project_id, source_file, bool_or(change_type = 'DELETE') as gone from changed group by all",
        "judged": """
select i.*, s.owner as new_owner, case when m.gone then 'retired' when m.gone is not null and s.stmt_id is null then 'retired'
  when s.stmt_id is not null then 'refreshed' else 'kept' end as change
from records i left join marks m using (project_id, source_file)
left join inc_scan s on s.project_id = i.project_id and s.sql_hash = i.sql_hash""",
    },
)
def incremental_scan_pipeline(inp):
    changed = inp.sql(CHANGED)
    touched = changed.filter("change_type <> 'DELETE'").select("project_id", "source_file").distinct()
    part = fingerprinted_once(inp).filter("o_custkey % 5 <> 0").join(touched, ["project_id", "source_file"], "left_semi")
    out = inv.incremental_scan_upsert(records(inp), scanned(inp, part, 3), changed, 3)
    return out.select("id", "project_id", "sql_hash", "status", "owner", "updated", "change")


DRIFT_LOCAL = "select table_name, concat('-- Estimated Rows: ', cast(estimated_rows as string), chr(10), chr(10), 'CREATE TABLE ', table_name, ' (id bigint)') as content from table_meta"
DRIFT_REMOTE = """select table_name, estimated_rows as rows,
  concat('CREATE TABLE ', table_name, case when table_name in ('lineitem', 'region') then ' (id bigint, more int)' else ' (id bigint)' end) as ddl from table_meta"""


@query(
    "drift_reanalysis",
    """select g.stmt_id, g.level as final_risk_level, 'ANALYZED' as handle_status from graded g join refs_of r using (stmt_id)
where g.project_id % 2 = 0 and (list_contains(r.refs, 'lineitem') or list_contains(r.refs, 'region'))""",
    ISSUES,
)
def drift_reanalysis(inp):
    """Tables whose DDL changed, the active statements that name them, their grades, their analysis rows."""
    drift = md.ddl_drift(inp.sql(DRIFT_LOCAL), inp.sql(DRIFT_REMOTE))
    active = with_issues(inp).withColumn("status", F.when(F.col("project_id") % 2 == 0, 1).otherwise(0))
    affected = md.affected_statements(active, drift.filter("drift = 'changed'").select("table_name"))
    scored = am.batch_score(am.with_table_facts(affected, inp.get("table_meta"), stats_of(inp)))
    return scored.select("stmt_id", F.col("risk_level").alias("final_risk_level"), F.lit("ANALYZED").alias("handle_status"))
