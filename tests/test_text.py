from conftest import rows
from pyspark.sql import functions as F

from querywarden.functions import ddltext as dt
from querywarden.functions import text as tx


def apply(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_normalize_and_fingerprint(spark):
    out = apply(spark, ["SELECT\n\t a = #{x, jdbcType=INT}  AND ${y}", "  \t", None], tx.normalize_sql)
    assert out == ["SELECT a = ? AND ?", "", ""]
    a, b, blank, null = apply(spark, ["Select 1", " select 1 ", "", None], tx.fingerprint)
    assert a == b and len(a) == 64 and blank == null == ""


def test_table_refs(spark):
    texts = [
        "select * from A a JOIN `db`.`B` b on 1 = 1 where x in (select y from c)",
        "insert into t1 (a) select 1 from _unknown",
        "update t_log_202401 set a = 1",
        "select 1 from (select 2 from deep) q",
        None,
        "from",
    ]
    assert apply(spark, texts, tx.table_refs) == [["a", "b", "c"], ["t1"], ["t_log_202401"], ["deep"], [], []]


def test_table_refs_at_any_depth(spark):
    cases = {
        "select * from a join b on f(g(h(1))) = 2, c": "a b c",
        "select * from a join b on (((a.x=b.x) and (a.y=b.y))), c": "a b c",
        "select * from (select 1 from x) t, y": "y x",
        "select * from a, (select 2 from b) s, c": "a c b",
        "select * from a force index (i), b use index for order by (j, k), c": "a b c",
        "select * from a left join lateral (select 1 from e0) e on true, f": "a f e0",
        "select ',x from zz' from a": "a",
        "select 'it''s from q', \"b\" from a -- from b\n, c /* , d */, e": "a c e",
        "select * from (a, b x), c": "a b c",
        "select * from ((a join b on a.i = b.i) left join (c join d using (k, l)) on (1 = 1)), e": "e a b c d",
        "select extract(year from d1), trim(both 'x' from d2) from t": "t",
        "select * from a where x in (select y from b where z = (select max(w) from c, d)) and exists (select 1 from e)": "a b c d e",
        "select * from a, (b join c on b.i = c.i), (select 1 from d where f(1, (2))) x": "a d b c",
        "insert into t(a, b) select x, y from (select * from (select * from deep) p) q, r": "t r deep",
        "select * from a join b on left(a.x, 2) = case when a.y = 1 then b.y end, c": "a b c",
        "merge into t using s on t.i = s.i when matched then update set x = 1, y = 2": "t set",
        "select * from t partition (p0, p1) v, u as w (m, n), x": "t u x",
        "select * from a where (x in (select y from b": "a b",
        "select * from ((((((((select 1 from z))))))))": "z",
        "delete from a where b = 'x (y' and c in (1, (2), ((3)))": "a",
    }
    got = apply(spark, list(cases), tx.table_refs)
    assert {q: " ".join(g) for q, g in zip(cases, got, strict=True)} == cases


def test_shard_base(spark):
    names = ["t_log_202603", "t_log_123", "t_2026_03", "t_1", "plain", None]
    assert apply(spark, names, tx.shard_base) == ["t_log", None, "t_2026", "t", None, None]


def test_truncate(spark):
    assert apply(spark, ["abcd", "abc", None], lambda c: tx.truncate_ellipsis(c, 3)) == ["abc...", "abc", None]
    assert apply(spark, [None], lambda c: tx.truncate_ellipsis(c, 3, "")) == [""]


def test_urls(spark):
    urls = ["https://Git.Example.com/A/b.git", "git@git.example.com:a/b.git", "http://git.example.com/a/b/", None]
    assert apply(spark, urls, tx.git_url_key) == ["git.example.com/a/b"] * 3 + [""]
    names = apply(spark, urls + [""], lambda c: tx.repo_name(c, F.lit("my proj")))
    assert names == ["b", "b", "b", "my_proj", "my_proj"]
    assert apply(spark, ["http://h/p?a=1&code=x%20y", "http://h/p"], lambda c: tx.query_param(c, "code")) == ["x y", None]


def test_times_and_durations(spark):
    assert apply(spark, [5, 999, 1000, 61_500, None], tx.duration_text, "x long") == ["5ms", "999ms", "1s", "1m 1s", None]
    assert apply(spark, [5, 1500, None], tx.duration_decimal, "x long") == ["5ms", "1.5s", "-"]


def test_high_risk_takes_only_known_levels(spark):
    # a plain string comparison would let HIGH pass
    assert apply(spark, ["P0", "P2", "P3", "HIGH", None], tx.high_risk) == [True, True, False, False, False]


def test_suggestions(spark):
    out = apply(spark, ['["a", "b"]', "[]", "text", '["broken', "", None], tx.suggestion_text)
    assert out == ["a\n\nb", "", "text", '["broken', "暂无", "暂无"]


def test_location_parts(spark):
    assert apply(spark, ["a.b.C.m", "m", ""], tx.source_class) == ["a.b.C", "", ""]
    assert apply(spark, ["a.b.C.m", "m"], tx.source_method) == ["m", "m"]


def test_table_file_round_trip(spark):
    df = spark.createDataFrame([(7, "CREATE TABLE t (\n a int\n)")], "n long, ddl string")
    text = dt.table_file(F.col("n"), F.col("ddl"))
    whole = F.concat(text, F.lit(f"\n{dt.INDEX_MARKER}\n-- Table Rows: 7\n"))
    got = df.select(dt.estimated_rows(whole), dt.bare_ddl(whole), dt.index_section(whole), dt.index_section(text)).first()
    assert tuple(got) == (7, "CREATE TABLE t (\n a int\n)", f"{dt.INDEX_MARKER}\n-- Table Rows: 7", None)
    assert rows(df.select(dt.estimated_rows(F.lit("no header")).alias("n"))) == [(0,)]
