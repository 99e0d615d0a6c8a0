"""Queries on table metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from querywarden.functions import ddltext as dt
from querywarden.functions import text as tx
from querywarden.operators import inventory as inv
from querywarden.operators import metadata as md
from querywarden.plans.inputs import Inputs
from querywarden.plans.oracle_parts import FP, REFS, RESOLVE
from querywarden.plans.registry import query
from querywarden.sources import catalog as cat
from querywarden.session import scratch_dir

MARK = dt.INDEX_MARKER

DDL_LOCAL = f"""
select concat('tab', cast(p_partkey as string)) as table_name,
  concat(case when p_partkey % 6 = 0 then '' else concat('-- Estimated Rows: ', cast(p_size * 1000 as string), chr(10), chr(10)) end,
    'CREATE TABLE tab', cast(p_partkey as string), ' (', chr(10), '  ', p_name, ' int', chr(10), ')', chr(10),
    case when p_partkey % 3 = 0 then concat(chr(10), '{MARK}', chr(10), '-- Table Rows: ', cast(p_size as string), chr(10)) else '' end) as content
from part where p_partkey % 10 <> 1"""

DDL_REMOTE = """
select concat('tab', cast(p_partkey as string)) as table_name, cast(p_size * (case when p_partkey % 5 = 0 then 2000 else 1000 end) as bigint) as rows,
  case when p_partkey % 13 = 0 then null else concat('CREATE TABLE tab', cast(p_partkey as string), ' (', chr(10), '  ', p_name,
    case when p_partkey % 4 = 0 then ' bigint' else ' int' end, chr(10), ')') end as ddl
from part where p_partkey % 10 <> 2"""

INDEX_REMOTE = f"""
select concat('tab', cast(p_partkey as string)) as table_name,
  concat('{MARK}', chr(10), '-- Table Rows: ', cast(p_size + p_partkey % 2 as string), chr(10)) as index_stats
from part where p_partkey % 7 <> 0"""

# what the constructed files must parse to
DDL_PARTS = {
    "local_parts": f"""
select concat('tab', p_partkey::varchar) as table_name,
  case when p_partkey % 6 = 0 then 0 else p_size * 1000 end as estimated_rows,
  concat('CREATE TABLE tab', p_partkey::varchar, ' (', chr(10), '  ', p_name, ' int', chr(10), ')') as ddl_text,
  case when p_partkey % 3 = 0 then concat('{MARK}', chr(10), '-- Table Rows: ', p_size::varchar) end as index_stats
from part where p_partkey % 10 <> 1""",
    "remote": DDL_REMOTE,
}

INVENTORY = ["customer", "events", "lineitem", "orders", "part", "region"]


@query(
    "table_inventory",
    " union all ".join(f"select '{t}' as table_name, count(*) as estimated_rows from {t}" for t in INVENTORY),
)
def table_inventory(inp):
    return cat.table_inventory({t: inp.table(t) for t in INVENTORY})


@query(
    "catalog_row_counts",
    """select concat('tab', p_partkey::varchar) as table_name,
  cast(case when p_partkey % 3 = 0 then p_size when p_partkey % 3 = 1 then 0 else 0 end as bigint) as estimated_rows from part""",
)
def catalog_row_counts(inp):
    rows = inp.sql(
        """select concat('tab', cast(p_partkey as string)) as table_name, case p_partkey % 3 when 0 then cast(p_size as string)
  when 1 then 'null' else p_brand end as table_rows from part"""
    )
    return cat.numeric_rows(rows)


@query("ddl_file_parse", "select table_name, estimated_rows, ddl_text, index_stats from local_parts", DDL_PARTS)
def ddl_file_parse(inp):
    return md.ddl_file_parse(inp.sql(DDL_LOCAL))


STATS = {
    "stats": """
select i.table_name, index_name, string_agg(column_name, ', ' order by seq) as columns, arg_max(cardinality, seq) as cardinality,
  arg_min(non_unique, seq) = 0 as is_unique, arg_min(index_type, seq) as index_type, any_value(m.estimated_rows) as table_rows
from index_rows i left join table_meta m on m.table_name = i.table_name group by i.table_name, index_name""",
    "stats_card": """
select s.* exclude (cardinality), c.cardinality, case when table_rows > 0 and c.cardinality is not null
  then round(c.cardinality / table_rows, 4) else 0.0 end as selectivity
from stats s join (select table_name, index_name, cardinality from index_rows
  qualify row_number() over (partition by table_name, index_name order by seq desc) = 1) c using (table_name, index_name)""",
    "stats_text": f"""
select table_name, concat('{MARK}', chr(10), '-- Table Rows: ', max(table_rows)::varchar, chr(10),
  string_agg(concat('-- Index: ', index_name, ' | Columns: ', columns, ' | Cardinality: ', coalesce(cardinality::varchar, 'N/A'),
    ' | Unique: ', case when is_unique then 'YES' else 'NO' end, ' | Type: ', index_type, ' | Selectivity: ', printf('%.4f', selectivity)), chr(10) order by index_name), chr(10)) as index_stats
from stats_card group by table_name""",
}


def stats_of(inp: Inputs):
    """Index statistics, collected once for a query."""
    return inp.once("index_stats", lambda: md.index_stats(inp.get("index_rows"), inp.get("table_meta")))


@query(
    "index_stats",
    """select table_name, index_name, columns, cardinality, is_unique, index_type, table_rows, cast(selectivity as double) as selectivity from stats_card""",
    STATS,
)
def index_stats(inp):
    return stats_of(inp)


@query("index_stats_text", "select table_name, index_stats from stats_text", STATS)
def index_stats_text(inp):
    return md.index_stats_text(stats_of(inp))


CARD_COLS = ["l_orderkey", "l_partkey", "l_suppkey"]


@query(
    "column_cardinality",
    """select 1 as seq, 'l_orderkey' as column_name, count(distinct l_orderkey) as cardinality from lineitem
union all select 2, 'l_partkey', count(*) from (select distinct l_orderkey, l_partkey from lineitem)
union all select 3, 'l_suppkey', count(*) from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem)""",
)
def column_cardinality(inp):
    return md.prefix_cardinality(inp.table("lineitem"), CARD_COLS)


@query(
    "column_cardinality_approx",
    "select unnest(range(1, 4)) as seq, unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) as column_name, true as within_5_percent",
)
def column_cardinality_approx(inp):
    rows = inp.table("lineitem")
    exact = md.prefix_cardinality(rows, CARD_COLS).select("seq", F.col("cardinality").alias("n"))
    near = F.abs(F.col("cardinality") - F.col("n")) <= 0.05 * F.col("n")
    found = md.prefix_cardinality(rows, CARD_COLS, approx_rsd=0.01).join(exact, "seq")
    return found.select("seq", "column_name", near.alias("within_5_percent"))


@query(
    "index_stats_incremental",
    """select unnest(range(1, 4)) as seq, unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) as column_name, (select count(*) from lineitem) as n_rows, true as within_5_percent""",
)
def index_stats_incremental(inp):
    """Sketches of the first rows are stored; then only the rows that came since are read and merged."""
    rows, store = inp.table("lineitem").select(*CARD_COLS), scratch_dir(inp.spark, "sketches")
    for n, part in enumerate(("l_orderkey % 4 <> 0", "l_orderkey % 4 = 0")):
        md.prefix_sketches(rows.filter(part), CARD_COLS, F.lit(n)).write.mode("append").parquet(store)
    found = md.merged_cardinality(inp.spark.read.parquet(store))
    exact = md.prefix_cardinality(rows, CARD_COLS).select("seq", F.col("cardinality").alias("n"))
    near = F.abs(F.col("cardinality") - F.col("n")) <= 0.05 * F.col("n")
    return found.join(exact, "seq").select("seq", "column_name", "n_rows", near.alias("within_5_percent"))


@query(
    "ddl_drift",
    """select coalesce(l.table_name, r.table_name) as table_name,
  case when l.table_name is null then 'new' when r.table_name is null then 'deleted' when r.ddl is null then 'unread'
    when l.ddl_text <> r.ddl then 'changed' else 'same' end as drift,
  coalesce(l.estimated_rows <> r.rows, false) as rows_drift
from local_parts l full outer join remote r on l.table_name = r.table_name""",
    DDL_PARTS,
)
def ddl_drift(inp):
    return md.ddl_drift(inp.sql(DDL_LOCAL), inp.sql(DDL_REMOTE))


@query(
    "ddl_refresh",
    """select l.table_name, case when r.ddl is null then f.content else concat('-- Estimated Rows: ', r.rows::varchar, chr(10), chr(10), r.ddl, chr(10),
    case when l.index_stats is not null then concat(chr(10), l.index_stats) else '' end) end as content,
  case when r.ddl is null then 'failed' when l.ddl_text <> r.ddl then 'updated' else 'unchanged' end as outcome
from local_parts l join files f on f.table_name = l.table_name left join remote r on r.table_name = l.table_name""",
    {**DDL_PARTS, "files": DDL_LOCAL},
)
def ddl_refresh(inp):
    return md.ddl_refresh(inp.sql(DDL_LOCAL), inp.sql(DDL_REMOTE))


@query(
    "index_stats_refresh",
    """select l.table_name,
  concat(case when l.table_name is not null and f.p_partkey % 6 <> 0 then concat('-- Estimated Rows: ', (f.p_size * 1000)::varchar, chr(10), chr(10)) else '' end,
    l.ddl_text, chr(10), case when x.index_stats is not null then concat(chr(10), x.index_stats) else '' end) as content,
  rtrim(x.index_stats, chr(10)) is distinct from l.index_stats as changed
from local_parts l join (select concat('tab', p_partkey::varchar) as table_name, p_partkey, p_size from part) f on f.table_name = l.table_name
left join idx x on x.table_name = l.table_name""",
    {**DDL_PARTS, "idx": INDEX_REMOTE},
)
def index_stats_refresh(inp):
    return md.index_stats_refresh(inp.sql(DDL_LOCAL), inp.sql(INDEX_REMOTE))


@query(
    "collect_all_diff",
    """select r.table_name, case when r.ddl is null then 'failed' when l.ddl_text is distinct from r.ddl then 'changed' else 'unchanged' end as outcome
from remote r left join local_parts l on l.table_name = r.table_name""",
    DDL_PARTS,
)
def collect_all_diff(inp):
    return md.collect_all_diff(inp.sql(DDL_LOCAL), inp.sql(DDL_REMOTE))


REFS_OF = {**FP, "refs_of": f"select stmt_id, project_id, q, {REFS} as refs from (select *, sql_normalized as q from fp)"}


def referenced_now(inp: Inputs):
    return md.with_table_refs(inv.with_fingerprint(inp.get("statements", spread=True)))


def referenced(inp: Inputs):
    """Statements with fingerprint and tables, worked out once: lookups read narrow columns of the stored table."""
    return inp.once("referenced", lambda: referenced_now(inp))


LISTS = """
select p_partkey, case p_partkey % 16
  when 0 then 'select * from a, b x, db.c where a.i = b.i, 1'
  when 1 then 'SELECT 1 FROM `Shop`.`Orders` AS o , part p, _tmp t JOIN nation n ON n.k = o.k, region'
  when 2 then 'update t_log l, part set l.a = 1, l.b = 2'
  when 3 then 'delete from customer where id in (select id from supplier, nation n)'
  when 4 then 'insert into region(a, b) values (?, ?), (?, ?)'
  when 5 then 'select f(a, b) from x left join y using (id), z order by 1, 2'
  when 6 then 'select * from (select 1 from inner_a, inner_b) s join c1 on f(s.a, 2) = (c1.b), c2'
  when 7 then concat('select * from d', cast(p_partkey as string), ' a join e on f(g(h(1))) = 2, f')
  when 8 then 'select * from a join b on (((a.x=b.x) and (a.y=b.y))), c'
  when 9 then concat('select * from (select 1 from x', cast(p_partkey as string), ') t, y')
  when 10 then 'select * from a, (select 2 from b) s, c'
  when 11 then 'select * from a force index (i), b'
  when 12 then 'select * from a left join lateral (select a.x from g) e on true, f'
  when 13 then concat('select '',x from zz'' from a', cast(p_partkey as string), ' /* , no */, b -- , no')
  else concat('select * from t', cast(p_partkey as string), ' t1, u', cast(p_partkey as string), chr(10), ', v group by a, b') end as sql_text
from part"""


@query(
    "table_refs_lists",
    """select p_partkey, case p_partkey % 16 when 0 then 'a,b,c' when 1 then 'orders,part,nation,region' when 2 then 't_log,part' when 3 then 'customer,supplier,nation'
  when 4 then 'region' when 5 then 'x,y,z' when 6 then 'c1,c2,inner_a,inner_b'
  when 7 then concat('d', p_partkey::varchar, ',e,f') when 8 then 'a,b,c' when 9 then concat('y,x', p_partkey::varchar) when 10 then 'a,c,b' when 11 then 'a,b' when 12 then 'a,f,g'
  when 13 then concat('a', p_partkey::varchar, ',b') else concat('t', p_partkey::varchar, ',u', p_partkey::varchar, ',v') end as tables from part""",
)
def table_refs_lists(inp):
    return inp.sql(LISTS).select("p_partkey", F.array_join(tx.table_refs(F.col("sql_text")), ",").alias("tables"))


@query(
    "table_refs",
    "select stmt_id, unnest(range(len(refs))) as pos, unnest(refs) as table_ref from refs_of",
    REFS_OF,
)
def table_refs(inp):
    return referenced_now(inp).select("stmt_id", F.posexplode("table_refs").alias("pos", "table_ref"))


@query(
    "shard_to_base",
    "select table_ref, base_table, estimated_rows from resolved",
    {**REFS_OF, **RESOLVE},
)
def shard_to_base(inp):
    names = referenced_now(inp).select(F.explode("table_refs").alias("table_ref")).distinct()
    return md.resolve_names(names, inp.get("table_meta"))


META = "select table_name, estimated_rows, concat('CREATE TABLE ', table_name, ' (id bigint)') as ddl_text from table_meta"


def full_meta(inp: Inputs):
    """Table metadata with index statistics, collected once for a query as a catalog would be."""
    return inp.once("metadata", lambda: inp.sql(META).join(md.index_stats_text(stats_of(inp)), "table_name", "left"))


CONTEXT = {
    **REFS_OF,
    **RESOLVE,
    **STATS,
    "meta": f"select m.*, s.index_stats from ({META}) m left join stats_text s using (table_name)",
    "blocks": r"""
select r.stmt_id, r.pos, concat('### ', case when v.base_table <> r.table_ref then concat(r.table_ref, ' → base: ', v.base_table, '（分表）') else r.table_ref end,
  case when m.estimated_rows > 0 then concat('（约 ', format('{:,}', m.estimated_rows), ' 行）') else '' end,
  chr(10), '```sql', chr(10), regexp_replace(concat(case when m.estimated_rows > 0 then concat('-- Estimated Rows: ', m.estimated_rows::varchar, chr(10), chr(10)) else '' end,
    m.ddl_text, case when m.index_stats is not null then concat(chr(10), chr(10), m.index_stats) else '' end), '\s+$', ''), chr(10), '```') as block
from (select stmt_id, unnest(range(len(refs))) as pos, unnest(refs) as table_ref from refs_of) r
join resolved v on v.table_ref = r.table_ref join meta m on m.table_name = v.base_table
qualify row_number() over (partition by r.stmt_id, v.base_table order by r.pos) = 1""",
    "context": """
select f.stmt_id, coalesce(b.body, '') as ddl_context from fp f left join (
  select stmt_id, concat('## 相关表结构（自动检索）', chr(10), chr(10), string_agg(block, concat(chr(10), chr(10)) order by pos)) as body
  from blocks group by stmt_id) b using (stmt_id)""",
}


@query("ddl_context", "select stmt_id, ddl_context from context", CONTEXT)
def ddl_context(inp):
    return md.ddl_context(referenced(inp), full_meta(inp)).select("stmt_id", "ddl_context")


CHANGED_TABLES = """
select table_name from table_meta where estimated_rows > 10 and table_name in ('orders', 'part', 'region')
union all select concat('t_log_', cast(202400 + s_suppkey % 5 as string)) from supplier"""


@query(
    "affected_statements",
    """select stmt_id from refs_of r where project_id % 2 = 0
  and exists (select 1 from changed c where list_contains(r.refs, c.table_name))""",
    {**REFS_OF, "changed": CHANGED_TABLES},
)
def affected_statements(inp):
    active = referenced(inp).withColumn("status", F.when(F.col("project_id") % 2 == 0, 1).otherwise(0))
    return md.affected_statements(active, inp.sql(CHANGED_TABLES)).select("stmt_id")


@query(
    "shard_suffix",
    r"""select l_orderkey, l_linenumber, l_partkey, nullif(regexp_extract(concat('t_log_', (l_partkey * (l_linenumber % 3))::varchar), '^(.+?)(_\d{4,}|_\d{1,2})$', 1), '') as base
from lineitem""",
)
def shard_suffix(inp):
    name = F.concat(F.lit("t_log_"), (F.col("l_partkey") * (F.col("l_linenumber") % 3)).cast("string"))
    return inp.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.shard_base(name).alias("base"))
