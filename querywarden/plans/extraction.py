"""Queries that extract statements from file texts built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from querywarden.operators import inventory as inv
from querywarden.operators import javasource as js
from querywarden.operators import mapperxml as mx
from querywarden.operators import metadata as md
from querywarden.operators import wrappers as wr
from querywarden.plans.inputs import Inputs
from querywarden.plans.registry import query
from querywarden.session import cut_lineage, scratch_dir
from querywarden.sources import files as fs
from querywarden.streaming import file_log as fl
from querywarden.streaming.runner import drain

PATHS = """
select doc_id, concat(case doc_id % 7 when 0 then 'src/main/' when 1 then 'src/test/' when 2 then 'target/x/' when 3 then 'a/Build/' when 4 then 'src/Tests/' when 5 then '.idea/' else '' end,
  case when doc_id % 11 = 0 then 'pom' else concat('f', cast(doc_id as string)) end, case when doc_id % 2 = 0 then '.xml' when doc_id % 3 = 0 then '.sql' else '.java' end) as path
from documents"""


@query(
    "scanned_path",
    r"""select doc_id, path,
  ends_with(path, '.xml') and not regexp_matches(concat('/', path), '/(\.git|node_modules|target|build)/') and not regexp_matches(lower(concat('/', path)), '/test/|/pom\.xml|/target/|/build/') as as_xml,
  ends_with(path, '.java') and not regexp_matches(concat('/', path), '/(\.git|node_modules|target|build|\.idea|\.mvn)/') and not regexp_matches(lower(concat('/', path)), '/test/|/tests/') as as_java
from paths""",
    {"paths": PATHS},
)
def scanned_path(inp):
    path = F.col("path")
    return inp.sql(PATHS).select("doc_id", "path", fs.is_scanned(path, "xml").alias("as_xml"), fs.is_scanned(path, "java").alias("as_java"))


# mapper files of 50 parts each; a second delivery changes every third and brings the odd ones
FILE = "cast(floor(p_partkey / 50) as bigint)"
MAPPER = """concat('<mapper namespace="com.acme.F', cast(f as {t}), '">', {selects}, '</mapper>')"""
ONE = """concat('<select id="q', cast(p_partkey as {t}), '">SELECT ', cast(p_size as {t}), ' FROM part_', cast(p_partkey % 7 as {t}), ', brand WHERE "n" = #{{a}}</select>')"""
TREE = {
    "mapper_files": f"""
select f, count(*) as n, {MAPPER.format(t="varchar", selects="string_agg(one, '' order by p_partkey)")} as content
from (select p_partkey, {FILE} as f, {ONE.format(t="varchar")} as one from part) group by f""",
    "second_files": "select f, case when f % 3 = 0 then concat(content, '<!-- new -->') else content end as content from mapper_files",
}


def mapper_files(inp: Inputs):
    """(f, content), stored once for a query; a file has 50 statements at most."""
    rows = inp.table("part").selectExpr("p_partkey", f"{FILE} as f", f"{ONE.format(t='string')} as one")
    selects = "array_join(transform(array_sort(collect_list(struct(p_partkey, one))), x -> x.one), '')"
    built = rows.groupBy("f").agg(F.expr(selects).alias("s")).selectExpr("f", f"{MAPPER.format(t='string', selects='s')} as content")
    return inp.once("mapper_files", lambda: built)


def deliver(files, root: str, prefix: str = "F") -> None:
    fs.source_tree_write(files.select(F.concat(F.lit(prefix), F.col("f").cast("string")).alias("folder"), "content"), root)


def folder_of(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


@query(
    "source_tree_scan",
    """select concat('src/main/mapper/folder=F', f::varchar) as folder, concat(content, chr(10)) as content from mapper_files""",
    TREE,
)
def source_tree_scan(inp):
    """A tree of mapper files is written, with tests, build results and other kinds beside them, and read back."""
    root, files = scratch_dir(inp.spark, "tree"), mapper_files(inp)
    for place in ("src/main/mapper", "src/test/mapper", "target/classes", "a/Build/x", "node_modules/m"):
        deliver(files, f"{root}/{place}")
    files.select("content").write.mode("append").text(f"{root}/src/main/notes")
    return fs.source_tree_scan(inp.spark, root, "xml").select(folder_of(F.col("path")).alias("folder"), "content")


@query(
    "source_tree_stream",
    """select concat('src/main/folder=F', s.f::varchar) as folder, sha256(concat(s.content, chr(10))) as content_hash,
  case when s.f % 2 = 1 then 'ADD' when s.f % 3 = 0 then 'MODIFY' else 'ADD' end as change from second_files s""",
    TREE,
)
def source_tree_stream(inp):
    """Even files arrive first; then all do, of which every third has changed and the others are known or new."""
    root, mark, log = (scratch_dir(inp.spark, f"tree-{x}") for x in ("in", "mark", "log"))
    files = mapper_files(inp)
    second = files.withColumn("content", F.when(F.col("f") % 3 == 0, F.concat("content", F.lit("<!-- new -->"))).otherwise(F.col("content")))
    for delivery in (files.filter("f % 2 = 0"), second):
        deliver(delivery, f"{root}/src/main")
        stream = fs.source_tree_stream(inp.spark, root, "xml", 100_000).withColumn("path", folder_of(F.col("path")))
        drain(stream, mark, lambda df, n: fl.apply_batch(df, n, log))
    return fl.latest(fl.file_changes(inp.spark, log)).withColumnRenamed("path", "folder")


INVENTORY = (
    "id long, project_id long, sql_hash string, sql_text string, source_file string, source_location string, "
    "status int, first_scan_id long, last_scan_id long, sql_normalized string, tables string"
)


@query(
    "file_scan_pipeline",
    """select concat('com.acme.F', f::varchar, '.q', p_partkey::varchar) as source_location, concat('src/main/folder=F', f::varchar) as folder,
  concat('SELECT ', p_size::varchar, ' FROM part_', (p_partkey % 7)::varchar, ', brand WHERE "n" = ?') as sql_normalized,
  concat('part_', (p_partkey % 7)::varchar, ',brand') as tables, 1 as status, 'new' as change
from (select *, floor(p_partkey / 50)::bigint as f from part) qualify row_number() over (partition by p_size, p_partkey % 7
  order by concat('src/main/folder=F', f::varchar), concat('com.acme.F', f::varchar, '.q', p_partkey::varchar)) = 1""",
)
def file_scan_pipeline(inp):
    """From files to inventory: scan the tree, extract, normalise and fingerprint, keep first occurrences, upsert."""
    root = scratch_dir(inp.spark, "scan-tree")
    deliver(mapper_files(inp), f"{root}/src/main")
    files = fs.source_tree_scan(inp.spark, root, "xml").withColumn("path", folder_of(F.col("path")))
    found = inv.with_fingerprint(mx.mapper_statement_extract(files))
    numbered = found.withColumn("project_id", F.lit(1).cast("long")).withColumn("stmt_id", F.xxhash64("source_file", "source_location", "sql_text"))
    named = md.with_table_refs(inv.first_occurrence(numbered)).withColumn("tables", F.array_join("table_refs", ",")).drop("table_refs")
    out = inv.full_scan_upsert(inp.spark.createDataFrame([], INVENTORY), cut_lineage(named, "scan"), 1)
    return out.select("source_location", F.col("source_file").alias("folder"), "sql_normalized", "tables", "status", "change")


def exported(inp: Inputs) -> str:
    """Folder with one exported table file per supplier."""
    tables = inp.sql(
        """select concat('tab', cast(s_suppkey as string)) as table_name, s_suppkey as estimated_rows,
  concat('CREATE TABLE tab', cast(s_suppkey as string), ' (', chr(10), s_name, ')') as ddl from supplier"""
    )
    root = scratch_dir(inp.spark, "ddl-export")
    fs.ddl_export(tables, root)
    return root


@query(
    "ddl_export_load",
    """select concat('tab', s_suppkey::varchar) as table_name, concat('-- Estimated Rows: ', s_suppkey::varchar, chr(10), chr(10), 'CREATE TABLE tab', s_suppkey::varchar, ' (', chr(10), s_name, ')', chr(10)) as content from supplier""",
)
def ddl_export_load(inp):
    return fs.ddl_directory_load(inp.spark, exported(inp))


@query(
    "ddl_export",
    """select concat('tab', s_suppkey::varchar) as table_name, unnest([concat('-- Estimated Rows: ', s_suppkey::varchar), '', concat('CREATE TABLE tab', s_suppkey::varchar, ' ('), concat(s_name, ')')]) as line from supplier""",
)
def ddl_export(inp):
    schema = "value string, table_name string"
    return inp.spark.read.schema(schema).text(exported(inp)).select("table_name", F.col("value").alias("line"))


@query(
    "ddl_directory_load",
    """select concat('tab', s_suppkey::varchar) as table_name, s_suppkey as estimated_rows, concat('CREATE TABLE tab', s_suppkey::varchar, ' (', chr(10), s_name, ')') as ddl_text from supplier""",
)
def ddl_directory_load(inp):
    files = fs.ddl_directory_load(inp.spark, exported(inp))
    return md.ddl_file_parse(files).drop("index_stats")


@query(
    "mapper_statement_extract",
    """select concat('src/main/P', p_partkey::varchar, '.xml') as source_file, concat('com.acme.P', (p_partkey % 50)::varchar, '.q', p_partkey::varchar) as source_location,
  'SELECT' as sql_type, true as has_dynamic, unnest(['SELECT p_name, p_size FROM part WHERE p_size = ? AND p_brand = ?', 'SELECT p_name, p_size FROM part']) as sql_text from part""",
)
def mapper_statement_extract(inp):
    out = mx.mapper_statement_extract(inp.get("mapper_xml", spread=True))
    return out.select("source_file", "source_location", "sql_type", "has_dynamic", "sql_text")


DYNAMIC_XML = """
select concat('P', cast(p_partkey as string), '.xml') as path,
  case when p_partkey % 10 = 9 then '<mapper><select>' when p_partkey % 10 = 8 then '<beans/>' else concat('<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "-//x//EN" "http://x/y.dtd"><mapper namespace="n"><!-- ', p_name, ' -->',
  case p_partkey % 8
    when 0 then concat('<update id="u">UPDATE part<set><if test="a">p_name = #{a},</if> p_size = ', cast(p_size as string), ',</set> WHERE p_partkey = ', chr(36), '{k}</update>')
    when 1 then '<select id="c">SELECT 1 <choose><when test="x">FROM a</when><when test="y">FROM b</when><otherwise>FROM c</otherwise></choose></select>'
    when 2 then '<delete id="d">DELETE FROM part WHERE id IN <foreach collection="l" item="i" open="(" separator="," close=")">#{i}</foreach></delete>'
    when 3 then '<select id="t">SELECT * FROM part <trim prefix="WHERE" prefixOverrides="AND |OR"><if test="z">OR</if> order_id &lt; 3 </trim></select>'
    when 4 then '<insert id="i">INSERT INTO part <bind name="b" value="1"/>VALUES <![CDATA[(1 < 2)]]></insert>'
    when 5 then '<sql id="f"><if test="q">AND q = 1</if></sql><select id="s">SELECT 5 FROM t WHERE 1=1 <include refid="f"/></select>'
    when 6 then '<sql id="r">x <include refid="r"/></sql><select id="y">SELECT <include refid="r"/><include refid="none"/> FROM t</select>'
    else '<select id="w">SELECT 7 FROM t<where><if test="a">and a = 1</if></where></select><select id="e"><if test="a"> </if></select>' end, '</mapper>') end as content
from part"""


@query(
    "dynamic_sql_expand",
    """select concat('P', p_partkey::varchar, '.xml') as source_file, unnest(case p_partkey % 8
    when 0 then [concat('UPDATE part SET p_name = ?, p_size = ', p_size::varchar, ' WHERE p_partkey = ?'), concat('UPDATE part SET p_size = ', p_size::varchar, ' WHERE p_partkey = ?')]
    when 1 then ['SELECT 1 FROM a', 'SELECT 1 FROM c']
    when 2 then ['DELETE FROM part WHERE id IN (?, ?, ?)']
    when 3 then ['SELECT * FROM part WHERE order_id < 3']
    when 4 then ['INSERT INTO part VALUES (1 < 2)']
    when 5 then ['SELECT 5 FROM t WHERE 1=1 AND q = 1', 'SELECT 5 FROM t WHERE 1=1']
    when 6 then ['SELECT x FROM t']
    else ['SELECT 7 FROM t WHERE a = 1', 'SELECT 7 FROM t'] end) as sql_text,
  p_partkey % 8 not in (4, 6) as has_dynamic
from part where p_partkey % 10 not in (8, 9)""",
)
def dynamic_sql_expand(inp):
    return mx.mapper_statement_extract(inp.sql(DYNAMIC_XML, spread=True)).select("source_file", "sql_text", "has_dynamic")


@query("mapper_rejects", "select concat('P', p_partkey::varchar, '.xml') as path from part where p_partkey % 10 = 9")
def mapper_rejects(inp):
    return mx.mapper_rejects(inp.sql(DYNAMIC_XML, spread=True)).select("path")


ANNOTATED = r"""
select concat('src/A', cast(p_partkey as string), '.java') as path,
  concat('package x; // class Nope', chr(10), '/* @Select("no") int no(); */ public interface A', cast(p_partkey % 30 as string), ' {', chr(10),
   '@Select("SELECT * FROM part -- http://h WHERE p_partkey = #{id} and n = ', p_name, '") @Options(useCache = false) java.util.List<Part> find', cast(p_partkey as string), '(int id);', chr(10),
   '@Update({"UPDATE part", " SET p_size = ', cast(p_size as string), '", "WHERE a = " + "1"})', chr(10), ' int up(@Param("x") int x);', chr(10),
   '@Delete(value = "DELETE FROM part WHERE b = " + CONST + "2", databaseId = "my") int del(); }', chr(10),
   'class B { @Insert("', '""', chr(10), '  INSERT INTO part', chr(10), '  VALUES (#{v})', chr(10), '""', '") void ins(); }') as content
from part"""


@query(
    "annotation_sql_extract",
    """select source_file, unnest(r, recursive := true) from (select concat('src/A', p_partkey::varchar, '.java') as source_file, [
  {sql_type: 'SELECT', source_location: concat('A', (p_partkey % 30)::varchar, '.find', p_partkey::varchar), sql_normalized: concat('SELECT * FROM part -- http://h WHERE p_partkey = ? and n = ', p_name)},
  {sql_type: 'UPDATE', source_location: concat('A', (p_partkey % 30)::varchar, '.up'), sql_normalized: concat('UPDATE part SET p_size = ', p_size::varchar, ' WHERE a = 1')},
  {sql_type: 'DELETE', source_location: concat('A', (p_partkey % 30)::varchar, '.del'), sql_normalized: 'DELETE FROM part WHERE b = 2'},
  {sql_type: 'INSERT', source_location: 'B.ins', sql_normalized: 'INSERT INTO part VALUES (?)'}] as r from part)""",
)
def annotation_sql_extract(inp):
    return js.annotation_sql_extract(inp.sql(ANNOTATED, spread=True)).select("source_file", "sql_type", "source_location", "sql_normalized")


ENTITIES = """
select concat('src/E', cast(p_partkey as string), '.java') as path,
  concat(case when p_partkey % 3 = 0 then '@TableName("t_part_' when p_partkey % 3 = 1 then '@TableName(schema = "s", value = "t_part_' else '@Other("t_part_' end, cast(p_partkey as string), '")', chr(10), '@Data public class Part', cast(p_partkey % 500 as string), ' { }') as content
from part"""


@query(
    "entity_table_map",
    """select concat('Part', (p_partkey % 500)::varchar) as entity, arg_max(concat('t_part_', p_partkey::varchar), concat('src/E', p_partkey::varchar, '.java')) as table_name
from part where p_partkey % 3 <> 2 group by 1""",
)
def entity_table_map(inp):
    return js.entity_table_map(inp.sql(ENTITIES, spread=True))


BUILDERS = r"""
select concat('src/S', cast(p_partkey as string), '.java') as path,
  concat('import x.y; @TableName("t_part_x") class PartX { }', chr(10), 'class Svc', cast(p_partkey % 40 as string), ' {', chr(10),
   ' List<P> load', cast(p_partkey as string), '(String a, int b) {', chr(10),
   '  QueryWrapper<PartX> qw = new QueryWrapper<>(); // qw.eq("no", 1);', chr(10),
   '  qw.eq(PartX.P_BRAND, a).like(b > 1, "p_name", f(a, b));', chr(10),
   '  if (b > ', cast(p_size as string), ') { qw.orderByDesc("p_size;x"); }', chr(10),
   '  return mapper.selectList(qw.last("limit ', cast(p_size as string), '"));', chr(10), ' }', chr(10),
   ' void save(Long id) { mapper.update(null, new LambdaUpdateWrapper<Supplier>().set(Supplier::getAcctBal, ', cast(p_size as string), ').eq(Supplier::getSuppKey, id)); }', chr(10),
   ' int none() { QueryWrapper<PartX> empty = new QueryWrapper<>(); return 1; }', chr(10), '}') as content
from part"""


def builder_calls(inp: Inputs):
    return js.wrapper_call_extract(inp.sql(BUILDERS, spread=True))


@query(
    "wrapper_call_extract",
    """select path, unnest(r, recursive := true) from (select concat('src/S', p_partkey::varchar, '.java') as path, [
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: concat('load', p_partkey::varchar), wrapper_type: 'QueryWrapper', declared_entity: 'PartX', seq: 1::bigint, call_name: 'eq', args: 'PartX.P_BRAND|a'},
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: concat('load', p_partkey::varchar), wrapper_type: 'QueryWrapper', declared_entity: 'PartX', seq: 2, call_name: 'like', args: 'b > 1|"p_name"|f(a, b)'},
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: concat('load', p_partkey::varchar), wrapper_type: 'QueryWrapper', declared_entity: 'PartX', seq: 3, call_name: 'orderByDesc', args: '"p_size;x"'},
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: concat('load', p_partkey::varchar), wrapper_type: 'QueryWrapper', declared_entity: 'PartX', seq: 4, call_name: 'last', args: concat('"limit ', p_size::varchar, '"')},
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: 'save', wrapper_type: 'LambdaUpdateWrapper', declared_entity: 'Supplier', seq: 1, call_name: 'set', args: concat('Supplier::getAcctBal|', p_size::varchar)},
  {cls: concat('Svc', (p_partkey % 40)::varchar), method: 'save', wrapper_type: 'LambdaUpdateWrapper', declared_entity: 'Supplier', seq: 2, call_name: 'eq', args: 'Supplier::getSuppKey|id'}] as r from part)""",
)
def wrapper_call_extract(inp):
    return builder_calls(inp).select(
        "path", "cls", "method", "wrapper_type", "declared_entity", "seq", "call_name", F.array_join("args", "|").alias("args")
    )


@query(
    "wrapper_statements",
    """select concat('src/S', p_partkey::varchar, '.java') as source_file, concat('Svc', (p_partkey % 40)::varchar, '.load', p_partkey::varchar) as source_location, 'QUERY_WRAPPER' as source_type, 'SELECT' as sql_type,
  concat('SELECT * FROM t_part_x WHERE p_brand = ? AND p_name LIKE CONCAT(''%'', ?, ''%'') ORDER BY p_size;x DESC limit ', p_size::varchar) as sql_text from part
union all select concat('src/S', p_partkey::varchar, '.java'), concat('Svc', (p_partkey % 40)::varchar, '.save'), 'LAMBDA_WRAPPER', 'UPDATE',
  'UPDATE t_supplier SET acct_bal = ? WHERE supp_key = ?' from part""",
)
def wrapper_statements(inp):
    files = inp.sql(BUILDERS, spread=True)
    scanned = inp.once("java", lambda: js.scan_java(files, "entity", "call"))
    out = wr.wrapper_statements(js.wrapper_call_extract(files, scanned), js.entity_table_map(files, scanned))
    return out.select("source_file", "source_location", "source_type", "sql_type", "sql_text")


SCOPES = r"""
select concat('src/C', cast(p_partkey as string), '.java') as path, concat('class A {', chr(10), case p_partkey % 7
  when 0 then ' void m() { QueryWrapper<User> q = new QueryWrapper<>(); q.eq("a", f(g(h(i(j(k(l(1)))))))).eq("b", 2); }'
  when 1 then ' void m() { QueryWrapper<User> q = new QueryWrapper<>(); dao.a(x.b(y.c(q.eq("z", 1)))); }'
  when 2 then ' void m() { QueryWrapper<User> q = new QueryWrapper<>(); run(new Runnable() { public void run() { go(); } }); q.eq("a", 1); }'
  when 3 then ' static class B { void n() { } } void m() { QueryWrapper<User> q = new QueryWrapper<>(); q.eq("a", 1); }'
  when 4 then concat(' void m() { QueryWrapper<User> q = new QueryWrapper<>(); q.eq("a", ', chr(39), ')', chr(39), ').eq("b", 2); }')
  when 5 then ' void m() { QueryWrapper<User> q = new QueryWrapper<>(); q.eq("a", 1).and(w -> { w.x(); }).eq("b", 2); }'
  else ' A() { dao.x(new QueryWrapper<User>().eq("no", 1)); } void m() { QueryWrapper<User> q; q = new QueryWrapper<>(); q.eq("c", 1); }' end,
  chr(10), '}') as content from part"""


@query(
    "wrapper_scopes",
    """select concat('src/C', p_partkey::varchar, '.java') as source_file, 'A.m' as source_location,
  concat('SELECT * FROM t_user WHERE ', case p_partkey % 7 when 0 then 'a = ? AND b = ?' when 1 then 'z = ?' when 2 then 'a = ?' when 3 then 'a = ?'
    when 4 then 'a = ? AND b = ?' when 5 then 'a = ? AND b = ?' else 'c = ?' end) as sql_text from part""",
)
def wrapper_scopes(inp):
    files = inp.sql(SCOPES, spread=True)
    scanned = inp.once("java", lambda: js.scan_java(files, "entity", "call"))
    out = wr.wrapper_statements(js.wrapper_call_extract(files, scanned), js.entity_table_map(files, scanned))
    return out.select("source_file", "source_location", "sql_text")


@query("java_rejects", "select concat('src/R', p_partkey::varchar, '.java') as path from part where p_partkey % 3 = 1")
def java_rejects(inp):
    files = inp.sql("select concat('src/R', cast(p_partkey as string), '.java') as path, concat('class R { ', case when p_partkey % 3 = 1 then '{' else '' end, p_name, ' }') as content from part", spread=True)
    return js.java_rejects(files).select("path")


COL = "case arg0 when 'User::getUserName' then 'user_name' when 'COUNTRY_ID' then 'country_id' when 'maxTaskNum' then 'max_task_num' else 'status' end"
CLAUSES = {
    "clauses": f"""
select usage_id, seq, call_name, case call_name when 'eq' then 'condition' when 'like' then 'condition' when 'between' then 'condition' when 'in' then 'condition'
    when 'isNull' then 'condition' when 'orderByDesc' then 'order' when 'groupBy' then 'group' else 'select' end as kind,
  case call_name when 'eq' then concat(c, ' = ?') when 'like' then concat(c, ' LIKE CONCAT(''%'', ?, ''%'')') when 'between' then concat(c, ' BETWEEN ? AND ?')
    when 'in' then concat(c, ' IN (?, ?, ?)') when 'isNull' then concat(c, ' IS NULL') when 'orderByDesc' then concat(c, ' DESC') else c end as fragment, c
from (select *, {COL} as c from wrapper_calls)"""
}



def single_arg_calls(inp: Inputs):
    return inp.get("wrapper_calls", spread=True).withColumn("args", F.array("arg0"))


@query("wrapper_clause_map", "select usage_id, seq, kind, fragment from clauses", CLAUSES)
def wrapper_clause_map(inp):
    out = wr.wrapper_clause_map(single_arg_calls(inp))
    return out.select("usage_id", "seq", "kind", F.array_join("fragments", "|").alias("fragment"))


ALL_CALLS = ["eq", "ne", "gt", "ge", "lt", "le", "like", "likeLeft", "likeRight", "notLike", "between", "notBetween", "in", "notIn", "isNull", "isNotNull"]


@query(
    "wrapper_conditions_all",
    """select p_partkey, concat(lower(p_brand), '_x', case p_partkey % 20 when 0 then ' = ?' when 1 then ' <> ?' when 2 then ' > ?' when 3 then ' >= ?' when 4 then ' < ?' when 5 then ' <= ?'
  when 6 then ' LIKE CONCAT(''%'', ?, ''%'')' when 7 then ' LIKE CONCAT(''%'', ?)' when 8 then ' LIKE CONCAT(?, ''%'')' when 9 then ' NOT LIKE CONCAT(''%'', ?, ''%'')' when 10 then ' BETWEEN ? AND ?'
  when 11 then ' NOT BETWEEN ? AND ?' when 12 then ' IN (?, ?, ?)' when 13 then ' NOT IN (?, ?, ?)' when 14 then ' IS NULL' when 15 then ' IS NOT NULL' end) as fragment
from part where p_partkey % 20 < 16
union all select p_partkey, case p_partkey % 20 when 16 then 'EXISTS (select ?)' when 17 then 'NOT EXISTS (?)' when 18 then 'a > ? and b' else 'n = n + 1' end from part where p_partkey % 20 >= 16""",
)
def wrapper_conditions_all(inp):
    names = F.array(*[F.lit(n) for n in ALL_CALLS + ["exists", "notExists", "apply", "setSql"]])
    n = (F.col("p_partkey") % 20).cast("int")
    arg = (
        F.when(n < 16, F.concat(F.lit('"'), F.lower("p_brand"), F.lit('_x"')))
        .when(n == 16, '"select {0}"').when(n == 17, "sub(x)").when(n == 18, '"a > {0} and b"').otherwise('"n = n + 1"')
    )
    calls = inp.table("part").select("p_partkey", F.element_at(names, n + 1).alias("call_name"), F.array(arg).alias("args"))
    return wr.wrapper_clause_map(calls).select("p_partkey", F.array_join("fragments", "|").alias("fragment"))


@query(
    "bool_prefix_strip",
    """select usage_id, seq, case seq % 6 when 0 then 'true' when 1 then 'a != null' when 2 then '!flag' when 3 then '(a)' when 4 then 'ok(a)' else 'flag' end as dropped, arg0 as first_arg,
  case when seq % 6 < 4 then true else seq % 2 = 1 or seq % 6 = 4 end as is_dynamic from wrapper_calls where call_name in ('eq', 'like', 'between', 'in', 'isNull')
union all select usage_id, seq, '', case seq % 6 when 0 then 'true' when 1 then 'a != null' when 2 then '!flag' when 3 then '(a)' when 4 then 'ok(a)' else 'flag' end, false from wrapper_calls where call_name not in ('eq', 'like', 'between', 'in', 'isNull')""",
)
def bool_prefix_strip(inp):
    six = F.array(*[F.lit(x) for x in ("true", "a != null", "!flag", "(a)", "ok(a)", "flag")])
    lead = F.element_at(six, (F.col("seq") % 6).cast("int") + 1)
    calls = inp.get("wrapper_calls", spread=True).withColumn("lead", lead).withColumn("args", F.array("lead", "arg0", F.lit("v")))
    return wr.bool_prefix_strip(calls).select(
        "usage_id", "seq", F.when(F.col("is_dynamic"), F.col("lead")).otherwise("").alias("dropped"),
        F.element_at("args", 1).alias("first_arg"), "is_dynamic",
    )


@query("column_name_resolve", f"select usage_id, seq, {COL} as col from wrapper_calls")
def column_name_resolve(inp):
    return inp.get("wrapper_calls", spread=True).select("usage_id", "seq", wr.resolve_column(F.col("arg0")).alias("col"))


USAGE_ENTITIES = """
select usage_id, case min(seq * 10 + l) % 10 when 0 then 'Order' when 1 then 'HTTPServer' when 2 then 'userCollector' else null end as entity
from (select usage_id, seq, length(arg0) % 4 as l from wrapper_calls) x group by usage_id"""
ENTITY_MAP = "select case when s_suppkey % 2 = 0 then 'Order' else concat('E', cast(s_suppkey as string)) end as entity, max(concat('tab_', cast(s_suppkey % 2 as string))) as table_name from supplier group by 1"


@query(
    "entity_infer",
    """select usage_id, coalesce(max(case when usage_id % 5 = 0 then 'Declared' end), case when usage_id % 2 = 0 then arg_min('User', seq) filter (where arg0 = 'User::getUserName') end,
  arg_min(concat('Const', (seq % 3)::varchar), seq) filter (where arg0 = 'COUNTRY_ID')) as entity from wrapper_calls group by usage_id""",
)
def entity_infer(inp):
    constant = F.concat(F.lit("Const"), (F.col("seq") % 3).cast("string"), F.lit(".COUNTRY_ID"))
    arg = F.when(F.col("arg0") == "COUNTRY_ID", constant).otherwise(F.col("arg0"))
    calls = (
        inp.get("wrapper_calls", spread=True)
        .withColumn("declared_entity", F.when(F.col("usage_id") % 5 == 0, "Declared"))
        .withColumn("wrapper_type", F.when(F.col("usage_id") % 2 == 0, "LambdaQueryWrapper").otherwise("QueryWrapper"))
        .withColumn("args", F.array(F.lit("Objects.X"), arg))
    )
    return wr.entity_infer(calls)


@query(
    "table_name_resolve",
    """select u.usage_id, u.entity, case when m.table_name is not null then m.table_name when u.entity is null then '_unknown'
  else concat('t_', lower(regexp_replace(u.entity, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))) end as table_name
from ue u left join em m on m.entity = u.entity""",
    {"ue": USAGE_ENTITIES, "em": ENTITY_MAP},
)
def table_name_resolve(inp):
    return wr.table_name_resolve(inp.sql(USAGE_ENTITIES), inp.sql(ENTITY_MAP)).select("usage_id", "entity", "table_name")


@query(
    "pseudo_sql_assemble",
    """select usage_id, case when usage_id % 3 = 0 then 'UPDATE' else 'SELECT' end as sql_type,
  concat(case when usage_id % 3 = 0 then 'UPDATE tab SET _col = ?' else concat('SELECT ', coalesce(string_agg(c, ', ' order by seq) filter (where kind = 'select'), '*'), ' FROM tab') end,
   coalesce(concat(' WHERE ' || (string_agg(fragment, ' AND ' order by seq) filter (where kind = 'condition'))), ''),
   coalesce(' GROUP BY ' || (string_agg(fragment, ', ' order by seq) filter (where kind = 'group')), ''),
   coalesce(' ORDER BY ' || (string_agg(fragment, ', ' order by seq) filter (where kind = 'order')), '')) as sql_text
from clauses group by usage_id""",
    CLAUSES,
)
def pseudo_sql_assemble(inp):
    calls = single_arg_calls(inp)
    kind = F.when(F.col("usage_id") % 3 == 0, "UpdateWrapper").otherwise("QueryWrapper")
    usages = calls.select("usage_id").distinct().select("usage_id", kind.alias("wrapper_type"), F.lit("tab").alias("table_name"))
    return wr.pseudo_sql_assemble(wr.wrapper_clause_map(calls), usages)
