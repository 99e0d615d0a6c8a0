"""Report, ownership and notice queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from querywarden.operators import metadata as md
from querywarden.operators import ownership as ow
from querywarden.operators import paging as pg
from querywarden.operators import reports as rp
from querywarden.plans.inputs import Inputs
from querywarden.plans.metadata import STATS, full_meta
from querywarden.plans.oracle_parts import LATEST, REFS, RESOLVE
from querywarden.plans.registry import query


@query(
    "dashboard_overview",
    """select (select count(*) from projects where status = 1) as project_count, (select count(*) from sql_records where status = 1) as total_sql_count,
  (select count(*) from scan_batches) as total_scan_count,
  (select count(*) from analyses where final_risk_level in ('P0', 'P1', 'P2')) as risk_sql_count,
  (select count(*) from analyses where handle_status = 'ANALYZED' and final_risk_level in ('P0', 'P1')) as pending_count""",
)
def dashboard_overview(inp):
    return rp.dashboard_overview(inp.get("projects"), inp.get("sql_records"), inp.get("scan_batches"), inp.get("analyses"))


@query(
    "dashboard_overview_latest",
    """select (select count(*) from projects where status = 1) as project_count, (select count(*) from sql_records where status = 1) as total_sql_count,
  (select count(*) from scan_batches) as total_scan_count,
  (select count(*) from cur where final_risk_level in ('P0', 'P1', 'P2')) as risk_sql_count,
  (select count(*) from cur where handle_status = 'ANALYZED' and final_risk_level in ('P0', 'P1')) as pending_count""",
    {**LATEST, "cur": "select l.* from latest l semi join sql_records r on r.id = l.sql_record_id and r.status = 1"},
)
def dashboard_overview_latest(inp):
    return rp.dashboard_overview(
        inp.get("projects"), inp.get("sql_records"), inp.get("scan_batches"), inp.get("analyses"), latest_only=True
    )


@query(
    "risk_overview",
    "select (select count(*) from sql_records where status = 1) as total_sql_records, count(*) as total_analyses, "
    + ", ".join(f"count(*) filter (where final_risk_level = '{v}') as risk_{v}" for v in rp.LEVELS)
    + ", "
    + ", ".join(f"count(*) filter (where handle_status = '{v}') as status_{v}" for v in rp.STATUSES)
    + " from analyses",
)
def risk_overview(inp):
    return rp.risk_overview(inp.get("sql_records"), inp.get("analyses"))


@query("active_projects", "select id, project_name from projects where status = 1")
def active_projects(inp):
    return rp.active_projects(inp.get("projects"))


@query(
    "risky_statements",
    """select a.id as analysis_id, a.sql_record_id, a.final_risk_level, a.handle_status, a.ai_model, a.create_time, r.project_id, r.sql_type,
  a.ai_analysis, concat('["index ', a.id % 7, '"]') as ai_index_suggestion, case when a.id % 2 = 0 then '[]' end as ai_rewrite_suggestion, a.ai_tokens_used * 3 as ai_estimated_scan_rows,
  r.source_file, r.source_location, r.source_type, case when length(r.sql_text) > 500 then concat(left(r.sql_text, 500), '...') else r.sql_text end as sql_text, p.project_name
from (select * from analyses where handle_status = 'PENDING' order by final_risk_level, create_time desc, id desc limit 500) a
left join sql_records r on r.id = a.sql_record_id left join projects p on p.id = r.project_id""",
)
def risky_statements(inp):
    advised = inp.get("analyses").withColumns(
        {
            "ai_index_suggestion": F.concat(F.lit('["index '), (F.col("id") % 7).cast("string"), F.lit('"]')),
            "ai_rewrite_suggestion": F.when(F.col("id") % 2 == 0, "[]"),
            "ai_estimated_scan_rows": F.col("ai_tokens_used") * 3,
        }
    )
    return rp.risky_statements(advised, inp.get("sql_records"), inp.get("projects"), None, " pending ", 500)


DETAIL = {
    "refs_of": f"select id, q, {REFS} as refs from (select *, sql_text as q from sql_records)",
    **RESOLVE,
    **STATS,
    "context": r"""
select r.id, concat('## 相关表结构（自动检索）', chr(10), chr(10), string_agg(concat('### ', case when v.base_table <> r.table_ref then concat(r.table_ref, ' → base: ', v.base_table, '（分表）') else r.table_ref end,
  case when v.estimated_rows > 0 then concat('（约 ', format('{:,}', v.estimated_rows), ' 行）') else '' end, chr(10), '```sql', chr(10),
  regexp_replace(concat(case when v.estimated_rows > 0 then concat('-- Estimated Rows: ', v.estimated_rows::varchar, chr(10), chr(10)) else '' end,
    'CREATE TABLE ', v.base_table, ' (id bigint)', case when s.index_stats is not null then concat(chr(10), chr(10), s.index_stats) else '' end), '\s+$', ''), chr(10), '```'), concat(chr(10), chr(10)))) as ddl_context
from (select id, unnest(refs) as table_ref from refs_of) r join resolved v using (table_ref) left join stats_text s on s.table_name = v.base_table
where v.base_table is not null group by r.id""",
}


def records_with_context(inp: Inputs):
    rows = md.with_table_refs(inp.get("sql_records"), sql="sql_text")
    return md.ddl_context(rows, full_meta(inp), "id")


@query(
    "analysis_detail",
    """select a.id, a.sql_record_id, a.final_risk_level, r.sql_text, r.owner, p.project_name, c.ddl_context as table_context
from analyses a left join sql_records r on r.id = a.sql_record_id left join projects p on p.id = r.project_id left join context c on c.id = r.id""",
    DETAIL,
)
def analysis_detail(inp):
    out = rp.analysis_detail(inp.get("analyses"), records_with_context(inp), inp.get("projects"))
    return out.select("id", "sql_record_id", "final_risk_level", "sql_text", "owner", "project_name", "table_context")


@query(
    "project_list",
    """select p.id as project_id, project_name, git_remote_url, git_branch, last_scan_commit, coalesce(n, 0) as active_sql_count
from projects p left join (select project_id, count(*) as n from sql_records where status = 1 group by 1) c on c.project_id = p.id where p.status = 1""",
)
def project_list(inp):
    return rp.project_list(inp.get("projects"), inp.get("sql_records"))


@query(
    "keyword_search",
    """select r.id as record_id, r.sql_text, r.sql_type, r.source_type, r.source_file, r.source_location,
  coalesce(l.final_risk_level, '未分析') as risk_level, l.handle_status, case when length(l.ai_analysis) > 200 then concat(left(l.ai_analysis, 200), '...') else l.ai_analysis end as brief_analysis
from (select r.* from sql_records r join customer on c_custkey = r.id
  where r.status = 1 and (contains(sql_text, 'lineitem') or contains(source_file, 'lineitem') or contains(source_location, 'lineitem'))
  order by c_acctbal desc, r.id desc limit 99) r left join latest l on l.sql_record_id = r.id""",
    LATEST,
)
def keyword_search(inp):
    times = inp.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("update_time"))
    return rp.keyword_search(inp.get("sql_records").join(times, "id"), inp.get("analyses"), " lineitem ", 99)


@query(
    "analysis_filter_page",
    """select id, sql_record_id, final_risk_level, handle_status, create_time from analyses a
where handle_status = 'ANALYZED' and create_time >= timestamp '2024-01-05 00:00:00' and create_time <= timestamp '2024-01-25 12:00:00'
 and exists (select 1 from sql_records r where r.id = a.sql_record_id and r.status = 1 and r.project_id = 7)
order by create_time desc, id desc limit 10 offset 10""",
)
def analysis_filter_page(inp):
    rows = rp.analysis_filter(
        inp.get("analyses"), inp.get("sql_records"), 7, None, "ANALYZED", datetime(2024, 1, 5), datetime(2024, 1, 25, 12)
    )
    page = rp.paginate(rows, rp.newest_first(), 2, 10)
    return page.select("id", "sql_record_id", "final_risk_level", "handle_status", "create_time")


@query(
    "batch_page",
    "select id, final_risk_level from analyses where scan_batch_id = 3 order by final_risk_level, id limit 20",
)
def batch_page(inp):
    return rp.batch_page(inp.get("analyses"), 3).select("id", "final_risk_level")


@query(
    "record_filter_page",
    """select id, project_id, sql_type, owner from sql_records where status = 1 and sql_type = 'SELECT' and contains(owner, 'hold')
order by id desc limit 20 offset 20""",
)
def record_filter_page(inp):
    rows = rp.record_filter(inp.get("sql_records"), sql_type="SELECT", source_type=" ", owner="hold")
    return rp.paginate(rows, [F.col("id").desc()], 2).select("id", "project_id", "sql_type", "owner")


@query("paginate_total", "select count(*) as total from sql_records where status = 1 and sql_type = 'SELECT' and contains(owner, 'hold')")
def paginate_total(inp):
    return rp.total(rp.record_filter(inp.get("sql_records"), sql_type="SELECT", owner="hold"))


@query(
    "paginate",
    """select p.*, t.total from (select id, project_id, owner from sql_records where status = 1 order by project_id, id limit 50 offset 100) p,
  (select count(*) as total from sql_records where status = 1) t""",
)
def paginate(inp):
    rows = rp.record_filter(inp.get("sql_records"))
    page = rp.paginate(rows, [F.col("project_id"), F.col("id")], 3, 50)
    return page.select("id", "project_id", "owner", rp.total(rows).scalar().alias("total"))


@query(
    "paginate_deep",
    "select event_id, user_id, event_type, value from events order by event_type desc, ts, event_id limit 37 offset 851",
)
def paginate_deep(inp):
    page = pg.deep_page(inp.table("events"), ["-event_type", "ts", "event_id"], 24, 37)
    return page.select("event_id", "user_id", "event_type", "value")


@query(
    "paginate_seek",
    """select e.event_id, e.user_id, e.event_type from events e, events l where l.event_id = 77
and (e.event_type < l.event_type or (e.event_type = l.event_type and (e.ts > l.ts or (e.ts = l.ts and e.event_id > l.event_id))))
order by e.event_type desc, e.ts, e.event_id limit 50""",
)
def paginate_seek(inp):
    events = inp.table("events")
    last = events.filter("event_id = 77").select("event_type", "ts", "event_id").first()
    return pg.seek_page(events, ["-event_type", "ts", "event_id"], 50, last.asDict()).select("event_id", "user_id", "event_type")


DURATION = """case when scan_duration_ms < 1000 then concat(scan_duration_ms::varchar, 'ms') when scan_duration_ms // 1000 < 60 then concat((scan_duration_ms // 1000)::varchar, 's')
  when scan_duration_ms is not null then concat((scan_duration_ms // 60000)::varchar, 'm ', (scan_duration_ms // 1000 % 60)::varchar, 's') end"""


@query(
    "scan_history",
    f"""select id, project_id, create_time, status, {DURATION} as duration, case when scan_duration_ms is null then '-'
  when scan_duration_ms < 1000 then concat(scan_duration_ms::varchar, 'ms') else concat(printf('%.1f', round(scan_duration_ms / 1000.0, 1)), 's') end as duration_short from scan_batches""",
)
def scan_history(inp):
    return rp.scan_history(inp.get("scan_batches")).select("id", "project_id", "create_time", "status", "duration", "duration_short")


@query(
    "analysis_with_owner",
    "select a.id, a.sql_record_id, coalesce(r.owner, '-') as owner from analyses a left join sql_records r on r.id = a.sql_record_id",
)
def analysis_with_owner(inp):
    return rp.analysis_with_owner(inp.get("analyses"), inp.get("sql_records")).select("id", "sql_record_id", "owner")


CHANGE_FEED = """
select l_orderkey % 5000 as id, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber as change_id, l_shipdate as handle_time,
  case when l_quantity > 25 then 'FIXED' else 'IGNORED' end as handle_status,
  concat('note ', cast(l_linenumber as string)) as handle_note, concat('dev', cast(l_suppkey as string)) as handler
from lineitem"""


@query(
    "handle_status_apply",
    """select a.id, coalesce(c.handle_status, a.handle_status) as handle_status, c.handle_note, c.handler, c.handle_time
from analyses a left join (select * from feed qualify row_number() over (partition by id order by handle_time desc, change_id desc, handle_status desc, handle_note desc, handler desc) = 1) c on c.id = a.id""",
    {"feed": CHANGE_FEED},
)
def handle_status_apply(inp):
    out = rp.handle_status_apply(inp.get("analyses"), inp.sql(CHANGE_FEED))
    return out.select("id", "handle_status", "handle_note", "handler", "handle_time")


@query(
    "catalog_lists",
    """select 'projects' as list, project_name as item from projects where status = 1
union all select 'tables', table_name from table_meta where contains(table_name, 'o')
union all select 'rules', pattern from exemption_rules where rule_type = 'TABLE_NAME'
union all select 'knowledge', title from knowledge_entries where knowledge_type = 'QPS_INFO' and status = 1""",
)
def catalog_lists(inp):
    lists = {
        "projects": (inp.get("projects"), {"status": 1}, {}, "project_name"),
        "tables": (inp.get("table_meta"), {}, {"table_name": " o "}, "table_name"),
        "rules": (inp.get("exemption_rules"), {"rule_type": "TABLE_NAME", "project_id": None}, {"pattern": ""}, "pattern"),
        "knowledge": (inp.get("knowledge_entries"), {"knowledge_type": "QPS_INFO", "status": 1}, {}, "title"),
    }
    parts = [
        rp.catalog_list(df, same, part, [F.col(item)]).select(F.lit(name).alias("list"), F.col(item).alias("item"))
        for name, (df, same, part, item) in lists.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("catalog_projects", "select id, project_name from projects where status = 1 and contains(project_name, 'NATION')")
def catalog_projects(inp):
    return rp.catalog_list(inp.get("projects"), {"status": 1}, {"project_name": "NATION"}, [F.col("id").desc()]).select("id", "project_name")


@query("catalog_tables", "select table_name, estimated_rows from table_meta where contains(table_name, 'o')")
def catalog_tables(inp):
    return rp.catalog_list(inp.get("table_meta"), {}, {"table_name": "o"}, [F.col("table_name")])


@query("catalog_rules", "select id, rule_type, pattern from exemption_rules where rule_type = 'SOURCE_CLASS'")
def catalog_rules(inp):
    rows = rp.catalog_list(inp.get("exemption_rules"), {"rule_type": "SOURCE_CLASS", "project_id": None}, {}, [F.col("id").desc()])
    return rows.select("id", "rule_type", "pattern")


@query("catalog_knowledge", "select id, title from knowledge_entries where knowledge_type = 'EXPERIENCE' and status = 1")
def catalog_knowledge(inp):
    rows = rp.catalog_list(inp.get("knowledge_entries"), {"knowledge_type": "EXPERIENCE", "status": 1}, {}, [F.col("id").desc()])
    return rows.select("id", "title")


@query("catalog_templates", "select concat('KEY_', r_name) as template_key from region order by 1")
def catalog_templates(inp):
    from querywarden.plans.assessment import TEMPLATES

    return rp.catalog_list(inp.sql(TEMPLATES), {}, {"template_key": ""}, [F.col("template_key")]).select("template_key")


@query(
    "trailing_window_counts",
    """select final_risk_level, count(*) filter (where create_time >= m - interval 1 day) as last_1d, count(*) filter (where create_time >= m - interval 7 day) as last_7d,
  count(*) filter (where create_time >= m - interval 30 day) as last_30d from analyses, (select max(create_time) as m from analyses) group by 1""",
)
def trailing_window_counts(inp):
    return rp.trailing_window_counts(inp.get("analyses"))


AUTHORS = {
    "authors": "select path, author from commit_files qualify row_number() over (partition by path order by commit_time desc, commit_id desc) = 1",
    "owners": "select a.path, a.author, coalesce(m.owner, 'lead') as owner from authors a left join owner_map m on m.git_name = lower(a.author)",
}


@query("file_last_author", "select path, author from authors", AUTHORS)
def file_last_author(inp):
    return ow.file_last_author(inp.get("commit_files"))


@query("owner_resolve", "select path, author, owner from owners", AUTHORS)
def owner_resolve(inp):
    return ow.owner_resolve(ow.file_last_author(inp.get("commit_files")), inp.get("owner_map"), "lead")


@query(
    "fill_missing_owners",
    """select r.id, case when r.status = 1 and coalesce(r.owner, '') = '' then coalesce(o.owner, 'lead') else r.owner end as owner,
  r.status = 1 and coalesce(r.owner, '') = '' as filled from sql_records r left join owners o on o.path = r.source_file""",
    AUTHORS,
)
def fill_missing_owners(inp):
    out = ow.fill_missing_owners(inp.get("sql_records"), inp.get("commit_files"), inp.get("owner_map"), "lead")
    return out.select("id", "owner", "filled")


OWNER_NAMES = """select concat(r_owner, '') as owner, r_owner as git_name, concat('@', r_owner) as mention_id
from (select distinct lower(c_mktsegment) as r_owner from customer where c_custkey % 2 = 0 and c_mktsegment <> 'BUILDING') x"""


@query(
    "remind_message",
    """select r.id, concat('### 风险 SQL 提醒', chr(10), '> **项目：** ', coalesce(p.project_name, '未知项目'), chr(10),
  '> **风险等级：** <font color="warning">', coalesce(l.final_risk_level, '未分析'), '</font>', chr(10), '> **来源：** ', r.source_location, chr(10),
  '> **SQL：** `', case when length(r.sql_text) > 200 then concat(left(r.sql_text, 200), '...') else r.sql_text end, '`', chr(10),
  '> [查看详情](http://host/#/sql-records?recordId=', r.id::varchar, ')', chr(10),
  case when coalesce(m.mention_id, r.owner, '') = '' then concat(chr(10), '请尽快处理，谢谢！') else concat(' ', chr(10), ' <@', coalesce(m.mention_id, r.owner), '> 请尽快处理，谢谢！') end) as message
from sql_records r left join latest l on l.sql_record_id = r.id left join projects p on p.id = r.project_id left join names m on m.owner = r.owner""",
    {**LATEST, "names": OWNER_NAMES},
)
def remind_message(inp):
    return ow.remind_message(inp.get("sql_records"), inp.get("analyses"), inp.get("projects"), inp.sql(OWNER_NAMES), "http://host")


@query(
    "scan_message",
    f"""select b.id, concat(case when b.status = 'COMPLETED' then '### ✅ 扫描完成' else '### ❌ 扫描失败' end, chr(10), '> **项目：** ', coalesce(p.project_name, '未知项目'), chr(10),
  '> **类型：** ', b.scan_type, chr(10), case when scan_duration_ms is not null then concat('> **耗时：** ', {DURATION}, chr(10)) else '' end,
  case when b.status = 'COMPLETED' then concat('> **SQL 总数：** ', coalesce(total_sql_count, 0)::varchar, chr(10), '> **新发现：** ', coalesce(new_sql_count, 0)::varchar, chr(10),
    case when coalesce(risk_sql_count, 0) > 0 then concat('> **<font color="warning">风险 SQL：', risk_sql_count::varchar, '</font>**', chr(10)) else concat('> **风险 SQL：** 0', chr(10)) end) else '' end,
  case when git_author is not null then concat('> **提交者：** ', git_author, chr(10)) else '' end,
  case when m.mention_id is not null then concat(' ', chr(10), ' <@', m.mention_id, '>') else '' end) as message
from scan_batches b left join projects p on p.id = b.project_id left join owner_map m on m.git_name = lower(b.git_author)""",
)
def scan_message(inp):
    return ow.scan_message(inp.get("scan_batches"), inp.get("projects"), inp.get("owner_map"))
