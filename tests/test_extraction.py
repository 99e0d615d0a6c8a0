import os

from conftest import rows

from querywarden.operators import javasource as js
from querywarden.operators import mapperxml as mx
from querywarden.operators import wrappers as wr
from querywarden.sources import files as fs


def statements(table, *sources):
    df = table([(f"F{i}.java", s) for i, s in enumerate(sources)], "path string, content string")
    return [tuple(r) for r in wr.wrapper_statements(js.wrapper_call_extract(df), js.entity_table_map(df)).select("sql_text", "sql_type").collect()]


def test_creation_and_later_call_make_one_statement(table):
    out = statements(
        table,
        """@TableName("t_halt") class Halt { static final String ID = "id"; }
        class Svc { int count(List<Long> ids) {
            QueryWrapper w = new QueryWrapper<Halt>().in(Halt.ID, ids);
            w.eq(Halt.STATE, Halt.STATE_GONE);
            return dao.count(w);
        } }""",
    )
    assert out == [("SELECT * FROM t_halt WHERE id IN (?, ?, ?) AND state = ?", "SELECT")]


def test_exists_keeps_its_sub_query(table):
    out = statements(
        table,
        """class Svc { void f(boolean on, Long role) {
            dao.list(new QueryWrapper<Member>().eq("s", 1).exists(on, "SELECT 1 FROM r WHERE r.id = {0}; -- x", role).notExists(sub(role)));
        } }""",
    )
    assert out == [("SELECT * FROM t_member WHERE s = ? AND EXISTS (SELECT 1 FROM r WHERE r.id = ?; -- x) AND NOT EXISTS (?)", "SELECT")]


def test_raw_builder_with_constants(table):
    out = statements(
        table,
        """class Svc { void f(String p) {
            QueryWrapper w = new QueryWrapper();
            w.likeRight(NAME, p); w.orderByDesc(RANK); w.last("limit 3");
        } }""",
    )
    assert out == [("SELECT * FROM _unknown WHERE name LIKE CONCAT(?, '%') ORDER BY rank DESC limit 3", "SELECT")]


def test_factory_update_in_source_order(table):
    out = statements(
        table,
        """class Svc { void f(Long id) {
            LambdaUpdateWrapper<TeamSeat> w = Wrappers.lambdaUpdate();
            w.set(TeamSeat::getStartAt, "a").set(TeamSeat::isOpen, 1)
             .setSql("n = n + {0}", 1).eq(TeamSeat::getId, id);
        } }""",
    )
    assert out == [("UPDATE t_team_seat SET start_at = ?, open = ?, n = n + ? WHERE id = ?", "UPDATE")]


def test_boolean_prefix_and_constant_columns(table):
    out = statements(
        table,
        """class Svc { void f(List<Long> l, boolean on) {
            dao.list(new LambdaQueryWrapper<>().eq(l != null, Buyer::getAge, 3).between(AMOUNT, 1, 9).in(on, "c", l).ge(!on, "d", 1)
              .groupBy(Objects.X, Buyer::getKind).having("sum(x) > {0}", 1).select(Buyer::getKind).apply("e = {0}", 2));
        } }""",
    )
    assert out == [
        ("SELECT kind FROM t_buyer WHERE age = ? AND amount BETWEEN ? AND ? AND c IN (?, ?, ?) AND d >= ? AND e = ? GROUP BY x, kind HAVING sum(x) > ?", "SELECT")
    ]


def test_variables_are_kept_apart(table):
    out = statements(
        table,
        """class A { void f() { QueryWrapper<X> w = new QueryWrapper<>(); w.eq("a", 1); }
                     void g() { QueryWrapper<Y> w = new QueryWrapper<>(); if (true) { w.eq("b", 1); } }
                     void h() { QueryWrapper<Z> w = new QueryWrapper<>(); } }""",
        """class B { void f() { QueryWrapper<V> w = new QueryWrapper<>(); w.eq("c", 1); w = new QueryWrapper<V>().eq("d", 2); } }""",
    )
    assert sorted(out) == [
        ("SELECT * FROM t_v WHERE c = ?", "SELECT"), ("SELECT * FROM t_v WHERE d = ?", "SELECT"),
        ("SELECT * FROM t_x WHERE a = ?", "SELECT"), ("SELECT * FROM t_y WHERE b = ?", "SELECT"),
    ]


def test_annotations(table):
    source = '''
    interface M {
      // @Select("no") int a();
      @Select("select 'it''s' /* not a comment */ from t -- \\"q\\"") int one();
      @Update("update a") @Delete({"delete", "from b"}) int two(@Param("x") int x);
      @Insert(value = {"insert into t", TABLE, " values (#{a})"}, id = "z") @Deprecated public abstract int three();
      @Select("") int four(); @Select(SQL) int five();
    }
    class N { @Select("""
        select 2
        from u""") Map<String, List<int[]>> six(int a, int b); }
    '''
    out = js.annotation_sql_extract(table([("M.java", source)], "path string, content string"))
    assert rows(out, "source_location", "sql_type", "sql_normalized") == [
        ("M.one", "SELECT", "select 'it''s' /* not a comment */ from t -- \\\"q\\\""),
        ("M.three", "INSERT", "insert into t values (?)"),
        ("M.two", "DELETE", "delete from b"),
        ("M.two", "UPDATE", "update a"),
        ("N.six", "SELECT", "select 2 from u"),
    ]


def test_long_literals_do_not_overflow(table):
    source = 'class A { @Select("' + "a\\\"b " * 20_000 + '") int f(); /* ' + "x" * 100_000 + " */ }"
    out = js.annotation_sql_extract(table([("A.java", source)], "path string, content string"))
    assert out.count() == 1


def xml(table, *bodies):
    files = table([(f"m{i}.xml", b) for i, b in enumerate(bodies)], "path string, content string")
    return rows(mx.mapper_statement_extract(files), "source_location", "sql_text", "has_dynamic")


def test_mapper_forms(table):
    body = """<mapper namespace="n"><sql id="w"><where><if test="a">and a = #{a}</if></where></sql>
      <select id="s">select * from t <include refid="w"/></select>
      <update id="u">update t <trim prefix="set" suffixOverrides=","><if test="b">b = 1,</if></trim></update>
      <delete id="d">delete from t <trim prefix="where" prefixOverrides="and|or">or order_id = 1 or</trim></delete>
      <select id="loop"><include refid="self"/> x</select><sql id="self">y <include refid="self"/></sql></mapper>"""
    assert xml(table, body) == [
        # an override does not eat the start of order_id
        ("n.d", "delete from t where order_id = 1 or", True),
        ("n.loop", "y x", False),
        # dynamic content inside an included fragment counts
        ("n.s", "select * from t", True),
        ("n.s", "select * from t WHERE a = ?", True),
        ("n.u", "update t", True),
        ("n.u", "update t set b = 1", True),
    ]
    assert xml(table, "<beans/>", "<mapper") == []


def test_source_tree(spark, tmp_path):
    kept = {"src/main/A.xml": "<a/>", "src/my dir/B+C.xml": "<b>\n</b>"}
    dropped = ["src/test/T.xml", "target/X.xml", "pom.xml", "a/node_modules/y.xml", "a/Build/z.xml"]
    for path, text in [*kept.items(), *[(d, "no") for d in dropped], ("src/A.java", "class A {}"), ("src/tests/B.java", "no")]:
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    assert rows(fs.source_tree_scan(spark, str(tmp_path), "xml")) == sorted(kept.items())
    assert rows(fs.source_tree_scan(spark, str(tmp_path), "java")) == [("src/A.java", "class A {}")]


def test_table_files(spark, tmp_path, table):
    (tmp_path / "t_a.sql").write_text("CREATE TABLE t_a ()\n")
    (tmp_path / "readme.txt").write_text("no")
    assert rows(fs.ddl_directory_load(spark, str(tmp_path))) == [("t_a", "CREATE TABLE t_a ()\n")]
    out = str(tmp_path / "out")
    fs.ddl_export(table([("00 x", 3, "CREATE\n()")], "table_name string, estimated_rows long, ddl string"), out)
    assert rows(fs.ddl_directory_load(spark, out)) == [("00 x", "-- Estimated Rows: 3\n\nCREATE\n()\n")]


def test_builders_at_any_depth_and_scopes_that_close(table):
    deep = statements(table, "class A { void m(){ QueryWrapper<User> q = new QueryWrapper<>(); q.eq(\"a\", f(g(h(i(j(k(l(1)))))))).eq(\"b\", 2); } }")
    assert deep == [("SELECT * FROM t_user WHERE a = ? AND b = ?", "SELECT")]
    nested = statements(table, "class A { void m(){ QueryWrapper<User> q = new QueryWrapper<>(); dao.a(x.b(y.c(q.eq(\"z\", 1)))); } }")
    assert nested == [("SELECT * FROM t_user WHERE z = ?", "SELECT")]
    source = """class A { void m(){ QueryWrapper<User> q = new QueryWrapper<>(); run(new Runnable(){ public void run(){ go(); q.eq("r", 1); } });
        q.eq("a", ')').and(w -> { w.x(); }).eq("b", 2); } A(){ dao.x(new QueryWrapper<User>().eq("no", 1)); }
        static class B { void n(){} } void o(){ QueryWrapper<User> s; s = new QueryWrapper<>(); s.eq("c", 1); } }"""
    df = table([("A.java", source)], "path string, content string")
    out = wr.wrapper_statements(js.wrapper_call_extract(df), js.entity_table_map(df))
    assert rows(out, "source_location", "sql_text") == [
        ("A.m", "SELECT * FROM t_user WHERE r = ? AND a = ? AND b = ?"),
        ("A.o", "SELECT * FROM t_user WHERE c = ?"),
    ]
    after = "class A { static class B { int x() { return 1; } } @Select(\"select 1 from t\") int m(); enum E { P { void q() {} }, Q } @Delete(\"delete from t\") void d() throws X; }"
    out = js.annotation_sql_extract(table([("A.java", after)], "path string, content string"))
    assert rows(out, "source_location") == [("A.d",), ("A.m",)]


def test_files_that_do_not_balance_are_reported(table):
    files = table([("a", "class A { void m() { }"), ("b", "class B { int x[) }"), ("c", None), ("d", "class D { char c = '{'; }")], "path string, content string")
    assert [r[0] for r in rows(js.java_rejects(files), "path")] == ["a", "b"]
    assert js.wrapper_call_extract(files).count() == 0


def test_heavy_tables_are_spread_without_a_setting(spark, tmp_path):
    from querywarden.plans.inputs import Inputs
    from querywarden.sources import tables as tb

    spark.range(100).selectExpr("id as p_partkey", "'n' as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cores = spark.sparkContext.defaultParallelism
    spread = Inputs(spark, str(tmp_path)).table("part", spread=True)
    assert spread.rdd.getNumPartitions() == cores > 1
    assert sorted(r.p_partkey for r in spread.collect()) == list(range(100))
    assert tb.parts_for(spark.range(1000), 10) == 100


def test_statement_query_cuts_each_java_file_once(spark, sf_dir):
    from querywarden.plans.catalog import QUERIES

    plan = QUERIES["wrapper_statements"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "/java-" in plan


def test_stored_scan_gives_the_same_statements(table):
    df = table([("A.java", '@TableName("t_x") class X { } class S { void m() { d.a(new QueryWrapper<X>().eq("a", 1)); } }')], "path string, content string")
    scanned = js.scan_java(df, "entity", "call")
    assert rows(js.wrapper_call_extract(df, scanned)) == rows(js.wrapper_call_extract(df))
    assert rows(js.entity_table_map(df, scanned)) == rows(js.entity_table_map(df)) == [("X", "t_x")]


def tasks_that_wrote(root, ext):
    """Numbers of the tasks in the names of the files below ``root``."""
    return {name.split("-")[1] for _, _, names in os.walk(root) for name in names if name.endswith(f".{ext}")}


def test_table_files_are_written_on_every_core(spark, tmp_path):
    tables = spark.range(40).coalesce(1).selectExpr("concat('t', id) as table_name", "id as estimated_rows", "'CREATE' as ddl")
    fs.ddl_export(tables.unionByName(tables.filter("table_name = 't7'")).coalesce(1), str(tmp_path / "ddl"))
    assert len(tasks_that_wrote(tmp_path / "ddl", "txt")) == spark.sparkContext.defaultParallelism > 1
    found = {r.table_name: r.content for r in fs.ddl_directory_load(spark, str(tmp_path / "ddl")).collect()}
    one = lambda n: f"-- Estimated Rows: {n}\n\nCREATE\n"
    assert found == {f"t{n}": one(n) * (2 if n == 7 else 1) for n in range(40)}


def test_tree_files_are_written_on_every_core(spark, tmp_path):
    files = spark.range(40).coalesce(1).selectExpr("concat('F', id) as folder", "concat('<m>', id, '</m>') as content")
    fs.source_tree_write(files, str(tmp_path / "tree"))
    assert len(tasks_that_wrote(tmp_path / "tree", "xml")) == spark.sparkContext.defaultParallelism > 1
    assert len(rows(fs.source_tree_scan(spark, str(tmp_path / "tree"), "xml"))) == 40
