"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querywarden.session import cut_lineage
from querywarden.sources.tables import spread_small

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED: dict[str, str] = {
    "statements": """
select o_orderkey as stmt_id, o_custkey % 25 as project_id, o_custkey,
  concat('src/m', cast(o_custkey % 200 as string), case when o_orderkey % 4 = 0 then '.xml' else '.java' end) as source_file,
  concat('com.acme.Mapper', cast(o_custkey % 50 as string), '.m', cast(o_orderkey % 10 as string)) as source_location,
  case o_orderkey % 4 when 0 then 'MAPPER_XML' when 1 then 'ANNOTATION' when 2 then 'QUERY_WRAPPER' else 'LAMBDA_WRAPPER' end as source_type,
  case o_orderkey % 5 when 2 then 'UPDATE' when 3 then 'DELETE' when 4 then 'INSERT' else 'SELECT' end as sql_type,
  case o_orderkey % 5
    when 0 then concat('SELECT  *', chr(10), ' FROM lineitem WHERE l_orderkey = #{id', cast(o_custkey % 40 as string), '}')
    when 1 then concat('select o.* from orders o join customer c on o.c = c.c and ', chr(36), '{col} = ', cast(o_custkey % 30 as string))
    when 2 then concat('UPDATE t_log_', cast(202400 + o_custkey % 12 as string), ' SET a = #{a}')
    when 3 then concat('DELETE FROM part_', cast(o_custkey % 9 as string), ' WHERE p LIKE ''%', cast(o_custkey % 7 as string), '''')
    else concat('INSERT INTO region VALUES (#{a}, #{b})', '  ') end as sql_text
from orders""",
    "sql_records": """
select c_custkey as id, cast(c_nationkey as bigint) as project_id,
  md5(concat('stmt', cast(c_custkey % 1200 as string))) as sql_hash,
  concat('SELECT * FROM ', case c_custkey % 6 when 0 then '_unknown' when 1 then 'orders' when 2 then 'lineitem' when 3 then 't_log_202403' when 4 then 'part' else 'customer' end, ' WHERE k = ?') as sql_text,
  case c_custkey % 4 when 0 then 'UPDATE' else 'SELECT' end as sql_type,
  case c_custkey % 3 when 0 then 'MAPPER_XML' when 1 then 'ANNOTATION' else 'LAMBDA_WRAPPER' end as source_type,
  concat('src/m', cast(c_custkey % 200 as string), '.java') as source_file,
  concat('com.acme.Mapper', cast(c_custkey % 50 as string), '.m', cast(c_custkey % 10 as string)) as source_location,
  case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then '' else lower(c_mktsegment) end as owner,
  case when c_custkey % 17 = 0 then 0 else 1 end as status
from customer""",
    "analyses": """
select event_id as id, user_id as sql_record_id, event_id % 40 as scan_batch_id, ts as create_time,
  concat('P', cast(event_id % 5 as string)) as final_risk_level,
  case event_type when 'error' then 'PENDING' when 'click' then 'ANALYZED' when 'view' then 'CONFIRMED' when 'signup' then 'FIXED' else 'IGNORED' end as handle_status,
  concat('model', cast(user_id % 6 as string)) as ai_model, cast(floor(value) as bigint) as ai_tokens_used,
  concat('Plan note ', props) as ai_analysis
from events""",
    "projects": """
select cast(n_nationkey as bigint) as id, n_name as project_name,
  concat('https://Git.example.com/', lower(n_name), case when n_nationkey % 2 = 0 then '.git' else '/' end) as git_remote_url,
  case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then 'main' else 'master' end as git_branch,
  case when n_nationkey % 4 = 0 then null else md5(n_name) end as last_scan_commit,
  case when n_nationkey % 6 = 5 then 0 else 1 end as status
from nation""",
    "table_meta": """
select 'lineitem' as table_name, count(*) as estimated_rows from lineitem
union all select 'orders', count(*) from orders
union all select 'customer', count(*) from customer
union all select 'part', count(*) from part
union all select 'region', count(*) from region
union all select 't_log', count(*) from events""",
    "index_rows": """
select 'lineitem' as table_name, 'idx_order_part' as index_name, 1 as seq, 'l_orderkey' as column_name, 1 as non_unique, count(distinct l_orderkey) as cardinality, 'BTREE' as index_type from lineitem
union all select 'lineitem', 'idx_order_part', 2, 'l_partkey', 1, count(*), 'BTREE' from (select distinct l_orderkey, l_partkey from lineitem) x
union all select 'lineitem', 'idx_flag', 1, 'l_returnflag', 1, count(distinct l_returnflag), 'BTREE' from lineitem
union all select 'orders', 'PRIMARY', 1, 'o_orderkey', 0, count(distinct o_orderkey), 'BTREE' from orders
union all select 'part', 'idx_null', 1, 'p_size', 1, case when count(*) < 0 then count(*) end, 'HASH' from part""",
    "exemption_rules": """
select cast(r_regionkey as bigint) as id,
  case when r_regionkey % 2 = 0 then 'SOURCE_CLASS' else 'TABLE_NAME' end as rule_type,
  case r_regionkey when 0 then 'Mapper7' when 1 then 'region' when 2 then 'com.acme.Mapper11' when 3 then 'Part_3' else 'apper9' end as pattern,
  cast(case when r_regionkey = 1 then 3 else null end as bigint) as project_id,
  case when r_regionkey = 2 then 0 else 1 end as status
from region""",
    "knowledge_entries": """
select doc_id as id,
  case doc_id % 5 when 0 then 'EXEMPTION' when 1 then 'BACKGROUND' when 2 then 'EXPERIENCE' when 3 then 'QPS_INFO' else 'SLOW_QUERY_NOTE' end as knowledge_type,
  concat('K', cast(doc_id as string)) as title, text as content,
  case when doc_id % 100 = 0 then 'lineitem, T_LOG' when doc_id % 100 = 1 then 'Orders' else null end as related_tables,
  case when doc_id % 4 = 0 then 1 else 0 end as embedded,
  case when doc_id % 9 = 0 then 0 else 1 end as status
from documents""",
    "file_snapshots": """
select 'before' as snap, concat('src/', case when doc_id % 8 = 0 then 'test/' else '' end, 'f', cast(doc_id as string), case when doc_id % 2 = 0 then '.xml' else '.java' end) as path, md5(text) as content_hash from documents where doc_id % 10 <> 0
union all
select 'after', concat('src/', case when doc_id % 8 = 0 then 'test/' else '' end, 'f', cast(doc_id as string), case when doc_id % 2 = 0 then '.xml' else '.java' end), md5(case when doc_id % 7 = 0 then concat(text, 'x') else text end) from documents where doc_id % 10 <> 1""",
    "push_events": """
select event_id, ts,
  case when event_type = 'error' then 'ping' else 'push' end as kind,
  concat('refs/heads/', case when event_id % 3 = 0 then 'main' else 'master' end) as ref,
  concat('git@git.example.com:nation_', cast(user_id % 25 as string), '.git') as ssh_url,
  concat('https://git.example.com/NATION_', cast(user_id % 25 as string)) as http_url
from events""",
    "call_log": """
select event_id, ts, user_id as provider, case when event_type = 'error' then 0 else 1 end as ok, value as elapsed_ms, props
from events""",
    "raw_responses": """
select event_id, concat('model', cast(user_id % 6 as string)) as model,
  concat('```json', chr(10), '{"riskLevel":"P', cast(event_id % 5 as string), '","canUseIndex":', case when event_id % 2 = 0 then 'true' else 'false' end,
    ',"estimatedScanRows":', cast(event_id as string), ',"issues":["full scan"],"extra":1,"explanation":"', case when event_id % 10 = 0 then '' else 'why' end, '"}', chr(10), '```') as response
from events""",
    "mapper_xml": """
select concat('src/main/P', cast(p_partkey as string), '.xml') as path, p_partkey,
  concat('<mapper namespace="com.acme.P', cast(p_partkey % 50 as string), '"><sql id="c">p_name, p_size</sql><select id="q', cast(p_partkey as string),
    '">SELECT <include refid="c"/> FROM part<where><if test="a != null">AND p_size = #{a}</if><if test="b != null"> AND p_brand = #{b}</if></where></select></mapper>') as content
from part""",
    "wrapper_calls": """
select l_orderkey as usage_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint) as seq,
  case l_partkey % 8 when 0 then 'eq' when 1 then 'like' when 2 then 'between' when 3 then 'in' when 4 then 'orderByDesc' when 5 then 'groupBy' when 6 then 'select' else 'isNull' end as call_name,
  case l_suppkey % 4 when 0 then 'User::getUserName' when 1 then 'COUNTRY_ID' when 2 then 'maxTaskNum' else '"status"' end as arg0
from lineitem""",
    "commit_files": """
select concat('src/m', cast(o_custkey % 200 as string), '.java') as path, o_orderkey as commit_id, o_orderdate as commit_time,
  concat(case when o_custkey % 2 = 0 then 'Dev' else 'dev' end, cast(o_custkey % 20 as string)) as author
from orders""",
    "owner_map": """
select concat('dev', cast(s_suppkey % 15 as string)) as git_name, concat('owner', cast(s_suppkey % 15 as string)) as owner,
  min(case when s_suppkey % 15 < 9 then concat('im_', cast(s_suppkey % 15 as string)) end) as mention_id
from supplier group by s_suppkey % 15""",
    "scan_batches": """
select event_id as id, user_id % 25 as project_id, ts as create_time,
  case when event_id % 4 = 0 then 'FULL' else 'INCREMENTAL' end as scan_type,
  case event_type when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'COMPLETED' end as status,
  case when event_id % 19 = 0 then null else event_id * 37 % 400000 end as scan_duration_ms,
  event_id % 500 as total_sql_count, event_id % 50 as new_sql_count,
  case when event_id % 3 = 0 then null else event_id % 7 end as risk_sql_count,
  case when event_id % 11 = 0 then null else concat('Dev', cast(user_id % 20 as string)) end as git_author
from events""",
}


def sources_of(sql: str) -> tuple[list[str], list[str]]:
    """Driver tables and derived inputs that a SQL text names."""
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "''", sql)))
    return [t for t in TABLES if t in words], [d for d in DERIVED if d in words]


class Inputs:
    """Driver tables and derived inputs of one scale factor folder; each is read and analysed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[tuple[str, bool], DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}

    def table(self, name: str, spread: bool = False) -> DataFrame:
        """A driver table; ``spread`` is for work that is heavy per row, see ``spread_small``."""
        if (name, spread) not in self._known:
            df = self.table(name) if spread else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._known[name, spread] = spread_small(df) if spread else df
        return self._known[name, spread]

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        tables, derived = sources_of(text)
        frames = {n: self.table(n, spread) for n in tables} | {n: self.get(n, spread) for n in derived}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def get(self, name: str, spread: bool = False) -> DataFrame:
        if (name, spread) not in self._known:
            self._known[name, spread] = self.sql(DERIVED[name], spread)
        return self._known[name, spread]

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` returns, computed once for a query and kept in the shared folder: for a table that costs
        work per row and is read for several lookups."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(build(), name)
        return self._stored[name]


def with_inputs(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL with the derived inputs it names in front, as common table expressions."""
    extra = extra or {}
    parts: dict[str, str] = {}

    def add(text: str) -> None:
        for name in sources_of(text)[1]:
            if name not in parts:
                add(DERIVED[name])
                parts[name] = DERIVED[name].strip()

    add(sql)
    for name, body in extra.items():
        add(body)
        parts[name] = body.strip()
    if not parts:
        return sql.strip()
    ctes = ",\n".join(f"{n} as (\n{b}\n)" for n, b in parts.items())
    return f"with recursive {ctes}\n{sql.strip()}"
