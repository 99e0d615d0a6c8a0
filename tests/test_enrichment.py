import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from querywarden.functions import ddltext as dt
from querywarden.operators import assessment as am
from querywarden.operators import exemptions as ex
from querywarden.operators import knowledge as kn
from querywarden.operators import metadata as md
from querywarden.operators import vector_index as vi
from querywarden.operators.lookups import heavy_lookup, spread_heavy

RULES = "id long, rule_type string, pattern string, project_id long, status int"
STMTS = "stmt_id long, project_id long, source_location string, sql_normalized string, table_refs array<string>"


def test_heavy_keys_are_spread_and_others_copied_once(spark, table):
    rows_in = table([(i, "hot" if i % 3 == 0 else f"k{i % 500}", i % 2) for i in range(6000)] + [(9999, None, 0)], "i long, k string, p int")
    known = table([("hot", 0, "H"), ("hot", 1, "I")] + [(f"k{j}", j % 2, f"v{j}") for j in range(400)], "k string, p int, v string")
    spread = spread_heavy(rows_in, ["k"], "i", part=100)
    of = {r.k: (r.n, r.least) for r in spread.groupBy("k").agg(F.countDistinct("_salt").alias("n"), F.count("*").alias("least")).collect()}
    assert of["hot"][0] > 15 and all(n == 1 for k, (n, _) in of.items() if k != "hot")
    load = [r["count"] for r in spread.groupBy("k", "_salt").count().collect()]
    assert max(load) <= 2 * 100
    got = rows(heavy_lookup(rows_in, known, ["k", "p"], "i", part=100), "i", "v")
    values = {(r.k, r.p): r.v for r in known.collect()}
    assert got == sorted(((r.i, values.get((r.k, r.p))) for r in rows_in.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
    assert heavy_lookup(rows_in.limit(0), known, ["k", "p"], "i").count() == 0


def test_exemption_rules_on_a_hot_prefix(table):
    stmts = table([(i, i % 2, f"com.a{i}.C{i}.m", f"s{i}", [f"t{i % 3}"]) for i in range(900)], STMTS)
    rules = table([(1, "SOURCE_CLASS", "com", 1, 1), (2, "SOURCE_CLASS", "com.a4", None, 1), (3, "SOURCE_CLASS", "C6", None, 1), (4, "TABLE_NAME", "T1", 0, 1), (5, "SOURCE_CLASS", "com", None, 0)], RULES)
    got = {r.stmt_id: r.rule_id for r in ex.exemption_match(stmts, rules).collect()}
    want = {i: min([r for r, hit in ((1, i % 2 == 1), (2, i == 4), (3, i == 6), (4, i % 3 == 1 and i % 2 == 0)) if hit], default=None) for i in range(900)}
    assert got == want


def test_exemption_rules(table):
    stmts = table(
        [
            (1, 1, "com.a.OrderMapper.find", "select 1 from t_x", ["t_x"]),
            (2, 1, "OrderMapper.find", "select 1 from t_x_2", ["t_x_2"]),
            (3, 2, "com.a.Order.find", "select 1 from T_X", ["t_x"]),
            (4, 1, "noclass", "select 1", []),
        ],
        STMTS,
    )
    rules = table(
        [
            (10, "SOURCE_CLASS", "OrderMapper", None, 1),
            (11, "TABLE_NAME", "T_X", 2, 1),
            (9, "SOURCE_CLASS", "com.a.OrderMapper", 1, 1),
            (1, "SOURCE_CLASS", "com.a.Order", None, 0),
            (2, "SOURCE_CLASS", "rder", None, 1),
            (3, "SOURCE_CLASS", "a", None, 1),
        ],
        RULES,
    )
    # lowest rule; a middle segment such as "a" and a part of a name such as "rder" match nothing
    assert rows(ex.exemption_match(stmts, rules), "stmt_id", "rule_id") == [(1, 9), (2, 10), (3, 11), (4, None)]
    assert rows(ex.drop_exempt(stmts, rules), "stmt_id") == [(4,)]


def test_preview_matches_substrings_but_matching_does_not(table):
    recs = table(
        [(1, 1, "A.m", "select 1 from t_x_2", "SELECT", 1), (2, 1, "A.m", "select 1 from t_x", "SELECT", 0)],
        "id long, project_id long, source_location string, sql_normalized string, sql_type string, status int",
    )
    assert rows(ex.exemption_preview(recs, "TABLE_NAME", "T_X"), "id") == [(1,)]
    assert rows(ex.exemption_preview_counts(recs, "TABLE_NAME", "t_x", 1)) == [(1, 1)]
    stmts = table([(1, 1, "A.m", "select 1 from t_x_2", ["t_x_2"])], STMTS)
    assert rows(ex.table_rule(stmts, table([(1, "TABLE_NAME", "t_x", None, 1)], RULES))) == []


def test_index_stats_take_the_last_column(table):
    idx = table(
        [("t", "i", 2, "b", 1, 84, "BTREE"), ("t", "i", 1, "a", 1, 5, "BTREE"), ("t", "n", 1, "c", 0, None, None), ("u", "x", 1, "c", 0, 3, "HASH")],
        "table_name string, index_name string, seq int, column_name string, non_unique int, cardinality long, index_type string",
    )
    meta = table([("t", 188)], "table_name string, estimated_rows long")
    stats = md.index_stats(idx, meta)
    assert rows(stats, "table_name", "index_name", "columns", "cardinality", "is_unique", "selectivity") == [
        ("t", "i", "a, b", 84, False, 0.4468), ("t", "n", "c", None, True, 0.0), ("u", "x", "c", 3, True, 0.0),
    ]
    text = {r.table_name: r.index_stats for r in md.index_stats_text(stats).collect()}
    assert text["t"].splitlines() == [
        dt.INDEX_MARKER,
        "-- Table Rows: 188",
        "-- Index: i | Columns: a, b | Cardinality: 84 | Unique: NO | Type: BTREE | Selectivity: 0.4468",
        "-- Index: n | Columns: c | Cardinality: N/A | Unique: YES | Type: N/A | Selectivity: 0.0000",
    ]


def test_drift_ignores_row_growth_and_the_index_section(table):
    body = f"-- Estimated Rows: 5\n\nCREATE TABLE a (x int)\n\n{dt.INDEX_MARKER}\n-- Table Rows: 5\n"
    local = table([("a", body), ("gone", "CREATE TABLE gone ()")], "table_name string, content string")
    remote = table([("a", 9, "CREATE TABLE a (x int)"), ("new", 1, "CREATE TABLE new ()")], "table_name string, rows long, ddl string")
    assert rows(md.ddl_drift(local, remote)) == [("a", "same", True), ("gone", "deleted", False), ("new", "new", False)]
    assert rows(md.collect_all_diff(local, remote)) == [("a", "unchanged"), ("new", "changed")]
    out = {r.table_name: (r.outcome, r.content) for r in md.ddl_refresh(local, remote).collect()}
    assert out["a"] == ("unchanged", f"-- Estimated Rows: 9\n\nCREATE TABLE a (x int)\n\n{dt.INDEX_MARKER}\n-- Table Rows: 5")
    assert out["gone"][0] == "failed"
    assert rows(md.ddl_refresh(local, remote, limit=1), "table_name") == [("a",)]
    idx = table([("a", f"{dt.INDEX_MARKER}\n-- Table Rows: 5\n")], "table_name string, index_stats string")
    assert rows(md.index_stats_refresh(local, idx), "table_name", "changed") == [("a", False), ("gone", False)]


def test_context_names_a_base_table_once(table):
    stmts = md.with_table_refs(
        table(
            [(1, "select 1 from t_log_202401 join t_log_202402"), (2, "select 1 from nowhere"), (3, "select 1 from T_LOG")],
            "stmt_id long, sql_normalized string",
        )
    )
    meta = table([("t_log", 1234, "CREATE TABLE t_log ()", None)], "table_name string, estimated_rows long, ddl_text string, index_stats string")
    out = {r.stmt_id: r.ddl_context for r in md.ddl_context(stmts, meta).collect()}
    block = "```sql\n-- Estimated Rows: 1234\n\nCREATE TABLE t_log ()\n```"
    assert out[1] == f"{md.CONTEXT_TITLE}\n\n### t_log_202401 → base: t_log（分表）（约 1,234 行）\n{block}"
    assert out[2] == ""
    assert out[3] == f"{md.CONTEXT_TITLE}\n\n### t_log（约 1,234 行）\n{block}"


def test_affected_statements(table):
    stmts = md.with_table_refs(
        table([(1, "select 1 from a", 1), (2, "select 1 from a", 0), (3, "select 1 from b", 1)], "id long, sql_normalized string, status int")
    )
    assert rows(md.affected_statements(stmts, table([("A",)], "table_name string")), "id") == [(1,)]


def brute_topk(queries, corpus, k, least):
    out = []
    for qid, q in queries:
        scored = sorted((-(np.dot(q, c) / np.linalg.norm(q) / np.linalg.norm(c)), cid) for cid, c in corpus)
        out += [(qid, cid, rank) for rank, (s, cid) in enumerate(scored[:k], 1) if -s >= least]
    return sorted(out)


def test_vector_topk_equals_brute_force(table):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    # one cell holds most vectors, so that it is cut into many blocks
    make = lambda n, ids: [(i, (centres[0 if i % 3 else i % 6] + rng.normal(scale=0.4, size=16)).astype("float32").tolist()) for i in ids[:n]]
    corpus, queries = make(400, range(1000, 1400)), make(60, range(60))
    schema = "id long, embedding array<float>"
    out = vi.vector_topk(table(queries, schema), table(corpus, schema), k=4, min_similarity=0.9, pivots=8, block_rows=25)
    got = sorted((r.query_id, r.entry_id, r.rank) for r in out.collect())
    want = brute_topk([(i, np.array(v)) for i, v in queries], [(i, np.array(v)) for i, v in corpus], 4, 0.9)
    assert got == want and len(want) > 50


def test_vector_topk_with_itself_ties_and_odd_vectors(table):
    rng = np.random.default_rng(8)
    vecs = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(80)]
    vecs += [(100 + i, vecs[3][1]) for i in range(150)] + [(300, None), (301, [0.0] * 6)]
    df = table(vecs, "id long, embedding array<float>")
    some = [(i, np.array(v)) for i, v in vecs if v and any(v)]
    for floor in (0.8, 0.0, -0.5):
        got = sorted((r.query_id, r.entry_id, r.rank) for r in vi.vector_topk(df, df, k=3, min_similarity=floor, pivots=9, block_rows=20, skip_self=True).collect() if 301 not in (r.query_id, r.entry_id))
        if floor > 0:
            want = []
            for i, v in some:
                near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in some if j != i)
                want += [(i, j, n + 1) for n, (c, j) in enumerate(near[:3]) if -c >= floor]
            assert got == sorted(want)
        else:
            assert {(q, r) for q, _, r in got} >= {(i, 1) for i, _ in some}


@pytest.mark.parametrize(("floor", "share"), [(0.9, 0.5), (0.7, 0.5), (-1.0, None)])
def test_blocks_of_clustered_vectors_are_skipped(table, floor, share):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    vecs = table([(i, (centres[i % 40] + rng.normal(scale=0.05, size=24)).astype("float32").tolist()) for i in range(2000)], "id long, embedding array<float>")
    pivots = vi._unit(vecs.limit(64).toPandas()["embedding"])
    rows_, n = vi.blocked(vi.placed(vecs, pivots), 25)
    of = vi.ranges(rows_, n, vi.BOUNDS)
    pairs = vi.near_blocks(of, of, math.acos(floor) + vi.SLACK).count()
    assert n >= 80 and (pairs <= share * n * n if share else pairs == n * n)


def test_blocks_have_bounded_rows():
    counts = [(0, 1, 3), (0, 2, 1000), (0, 5, 4), (1, 0, 5), (1, 1, 1), (2, 9, 10)]
    rings, blocks = vi.layout(counts, 10)
    filled = {}
    for (_, _, n), (_, _, start, pieces) in zip(sorted(counts), rings, strict=True):
        for b in range(start, start + pieces):
            filled[b] = filled.get(b, 0) + n / pieces
    assert sorted(filled) == list(range(blocks)) and max(filled.values()) <= 10


def test_vector_topk_without_entries(table):
    schema = "id long, embedding array<float>"
    assert vi.vector_topk(table([(1, [1.0])], schema), table([], schema)).count() == 0


def test_retrieve_context_lists_an_entry_once(table):
    cols = "id long, knowledge_type string, title string, content string, related_tables string, embedded int, status int"
    entries = table(
        [(1, "T", "one", "x" * 600, "A, b", 1, 1), (2, "T", "two", "c2", None, 1, 1), (3, "T", "off", "c3", "a", 1, 0)], cols
    )
    stmts = table([(7, ["a"]), (8, ["z"])], "stmt_id long, table_refs array<string>")
    hits = table([(7, 1, 1), (7, 2, 2)], "query_id long, entry_id long, rank int")
    out = {r.stmt_id: r.knowledge_context for r in kn.retrieve_context(stmts, entries, hits).collect()}
    assert out[8] == ""
    assert out[7].split("\n\n") == [
        kn.CONTEXT_TITLE, f"- **[T] one** (表: A, b): {'x' * 500}...", "- **[T] two**: [T] two\nc2",
    ]
    assert rows(kn.reembed_selection(entries), "id") == []
    assert rows(kn.reembed_selection(entries, force_all=True), "id") == [(1,), (2,)]


def test_prompt_uses_active_template_or_default(table):
    cols = "sql_type string, source_location string, sql_normalized string, ddl_context string, knowledge_context string"
    stmts = table([("SELECT", "A.m", "select 100%s", "ddl", None)], cols)
    templates = table([("K", "%s|%s|%s|%s|%s!", 1), ("OFF", "x", 0)], "template_key string, content string, status int")
    assert rows(am.prompt_assemble(stmts, templates, "K", "d"), "prompt") == [("SELECT|A.m|select 100%s|ddl|!",)]
    assert rows(am.prompt_assemble(stmts, templates, "OFF", "d %s"), "prompt") == [("d SELECT",)]


def test_assessment_parse_reports_malformed_bodies(table):
    body = '```json\n{"riskLevel":"P1","issues":["a"],"unknown":1,"explanation":" "}\n```'
    df = am.assessment_parse(table([(1, "m", body), (2, "m", "sorry"), (3, "m", '{"riskLevel":')], "id long, model string, response string"))
    assert rows(df, "id", F.col("assessment.riskLevel")) == [(1, "P1"), (2, None), (3, None)]
    assert rows(am.response_quality(df)) == [("m", 1, 2, 1, 1, 0, 0, "WARNING")]
    assert am.assessment_to_analysis(df).count() == 1


def test_rules_and_scorer_agree(table):
    texts = [
        ("select * from t", False), ("update t set a = 1", True), ("select a from t where b like '%x'", False),
        ("select a from t where year(b) = 1", False), ("select a from t where b = 1 limit 100000, 10", False),
        ("select a from t join b on 1 join c on 1 join d on 1 where a = 1", False), ("insert into t values (1)", True),
    ]
    data = [(10 * i + j, q, d, n, s) for i, (q, d) in enumerate(texts) for j, (n, s) in enumerate([(0, None), (1_000, 0.5), (20_000, 0.001), (1_000_000, 0.9)])]
    df = am.rule_issues(table(data, "stmt_id long, sql_normalized string, has_dynamic boolean, table_rows long, best_selectivity double"))
    issues = {r.sql_normalized: r.issues for r in df.collect()}
    assert issues["select * from t"] == ["no_where", "select_star"]
    assert issues["update t set a = 1"] == ["no_where", "all_conditions_optional"]
    assert [issues[q][0] if issues[q] else None for q, _ in texts[2:]] == ["leading_wildcard", "function_on_column", "deep_paging", "many_joins", None]
    by_rule = rows(am.rule_risk_level(df), "stmt_id", "rule_risk_level")
    assert by_rule == rows(am.batch_score(df), "stmt_id", "risk_level")
    assert dict(by_rule)[3] == "P0" and dict(by_rule)[60] == "P4" and dict(by_rule)[62] == "P3"


def test_failure_streaks_equal_the_running_count(table):
    base, rng = datetime(2024, 1, 1), np.random.default_rng(1)
    data, t = [], base
    for i in range(400):
        t += timedelta(seconds=int(rng.integers(0, 1200)))
        data.append((i, t, int(rng.integers(0, 2)), int(rng.random() < 0.4)))
    out = am.failure_streaks(table(data, "event_id long, ts timestamp_ntz, provider long, ok int"), cooldown=timedelta(minutes=10))
    got = {r.event_id: (r.streak, r.cooling) for r in out.collect()}
    run, last = {}, {}
    for i, t, p, ok in sorted(data, key=lambda d: (d[1], d[0])):
        cooling = run.get(p, 0) >= 3 and t - last[p] < timedelta(minutes=10)
        run[p] = 0 if ok else run.get(p, 0) + 1
        last[p] = last.get(p) if ok else t
        assert got[i] == (run[p], cooling), i


def test_streaks_of_one_minute_are_spread_over_ranges(spark, table):
    base, rng = datetime(2024, 1, 1), np.random.default_rng(4)
    ok = (rng.random(6000) < 0.05).astype(int).tolist()
    data = [(i, base + timedelta(milliseconds=i * 10), 7, ok[i]) for i in range(6000)] + [(9000, base, None, 0), (9001, base, None, 0)]
    calls = table(data, "event_id long, ts timestamp_ntz, provider long, ok int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = [r["count"] for r in calls.repartitionByRange("provider", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()]
        got = {r.event_id: r.streak for r in am.failure_streaks(calls).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run, want = 0, {9000: 1, 9001: 2}
    for i in range(6000):
        run = 0 if ok[i] else run + 1
        want[i] = run
    assert got == want and len(ranges) == 4 and max(ranges) < 2 * sorted(ranges)[2]


def test_prompt_keeps_all_of_its_template(spark):
    from querywarden.operators import assessment as am

    rows_in = spark.createDataFrame([("SELECT", "l", "q", "d", "k")], "sql_type string, source_location string, sql_normalized string, ddl_context string, knowledge_context string")
    templates = spark.createDataFrame([], "template_key string, status int, content string")
    got = am.prompt_assemble(rows_in, templates, "x", "a%sb%sc%sd%se%sf%sTAIL").first().prompt
    assert got == "aSELECTblcqddekf%sTAIL"


def test_reuse_expires_exactly_at_its_time(spark):
    from datetime import datetime, timedelta

    from querywarden.operators import inventory as inv

    start = datetime(2024, 1, 1, 10, 50)
    at = [0, 10, 19, 60, 60 * 24 + 60, 60 * 24 + 61]
    data = [(k, start + timedelta(minutes=m)) for m in at for k in ("a", None)] + [("n", None)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz")
    short = {(r.k, r.ts): r.reused for r in inv.seen_within_ttl(df, "k", "ts", timedelta(minutes=10)).collect()}
    day = {(r.k, r.ts): r.reused for r in inv.seen_within_ttl(df, "k", "ts").collect()}
    for k in ("a", None):
        assert [short[k, start + timedelta(minutes=m)] for m in at] == [False, False, True, False, False, True]
        assert [day[k, start + timedelta(minutes=m)] for m in at] == [False, True, True, True, False, True]
    assert short["n", None] is False and len(short) == 13


def test_statements_that_cannot_differ_share_a_context(table):
    cols = "id long, knowledge_type string, title string, content string, related_tables string, embedded int, status int"
    entries = table([(1, "T", "one", "c1", "a", 1, 1), (2, "T", "two", "c2", None, 1, 1)], cols)
    stmts = table([(7, ["a"]), (7, ["a"]), (8, ["a"]), (9, ["a"]), (None, ["a"]), (10, None), (11, ["z"]), (12, ["z"])], "stmt_id long, table_refs array<string>")
    hits = table([(7, 2, 1), (12, 2, 1)], "query_id long, entry_id long, rank int")
    each, kinds = kn.alike(stmts, table([(7,), (12,), (99,), (7,), (None,)], "vec_id long"), ["table_refs"])
    assert rows(kinds, "_own", "stmt_id", "table_refs") == [(None, 10, None), (None, 11, ["z"]), (None, 8, ["a"]), (12, 12, ["z"]), (7, 7, ["a"])]
    made = kn.retrieve_context(kinds, entries, hits, stmts)
    got = rows(kn.shared(each, made.select("_own", "table_refs", "knowledge_context"), ["table_refs"]), "stmt_id", "knowledge_context")
    assert got == rows(kn.retrieve_context(stmts, entries, hits), "stmt_id", "knowledge_context") and len(got) == 8


def test_context_texts_are_not_shuffled(spark, sf_dir):
    from querywarden.plans.catalog import QUERIES

    for name in ("retrieve_context", "prompt_assemble"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        # the sets' texts meet the statements in the last join below the one that hands the digests out
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert "_own" in joins[0] and "_own" in joins[1] and "_salt" in joins[2], joins[:3]


TEMPLATES_OF = ["T %s at %s: %s / %s / %s end", "%s%s%s%s%s", "no mark", "%s %s %s %s", "a%sb%sc%sd%se%sf%sg%s", "%s%s%s%s%s tail %s"]


@pytest.mark.parametrize("template", TEMPLATES_OF)
def test_prompts_of_a_row_are_digested_like_whole_ones(spark, table, template):
    import hashlib

    cols = ["sql_type", "source_location", "sql_normalized", "table_refs"]
    stmts = table(
        [(i, "S", "l", "q", ["a"]) for i in range(40)] + [(i, "S", None, "ü", ["z"]) for i in range(40, 46)] + [(46, None, "l", "q", None), (None, "S", "l", "q", ["a"])],
        "stmt_id long, sql_type string, source_location string, sql_normalized string, table_refs array<string>",
    ).withColumn("ddl_context", F.lit("ddl"))
    entries = table(
        [(i, "T", f"e{i}", "Text ß" * i, "a, b" if i % 2 else None, 1, 1) for i in range(8)],
        "id long, knowledge_type string, title string, content string, related_tables string, embedded int, status int",
    )
    hits = table([(i, i % 8, 1) for i in range(0, 46, 3)] + [(9, 2, 2)], "query_id long, entry_id long, rank int")
    none = table([], "template_key string, status int, content string")
    whole = am.prompt_assemble(kn.retrieve_context(stmts, entries, hits), none, "K", template)
    want = sorted((r.stmt_id, hashlib.md5(r.prompt.encode()).hexdigest()) for r in whole.collect() if r.stmt_id is not None)
    each, kinds = kn.alike(stmts.drop("ddl_context"), table([(i,) for i in range(46)], "vec_id long"), cols)
    near = kn.near_context(stmts, kn.knowledge_by_table(stmts, entries), entries, hits)
    # texts are made for a few rows, not for each statement that has a vector
    groups = kn.gathered(kinds, near, cols, 16).withColumn("ddl_context", F.lit("ddl"))
    assert groups.count() < 8 and sorted(len(r.asks) for r in groups.collect())[-1] > 5
    out = am.prompt_assemble(kn.retrieve_context(groups, entries, None, stmts), none, "K", template, apart=True)
    got = rows(kn.shared(each, am.prompt_digests(out, cols, "md5"), cols).filter("stmt_id is not null"), "stmt_id", "md5")
    assert sorted(got) == want and len({m for _, m in want}) > (5 if template.count("%s") > 4 else 0)


def test_statements_are_not_broadcast_for_their_hits(spark, tmp_path, table):
    stmts = table([(i, ["a"]) for i in range(100)], "stmt_id long, table_refs array<string>")
    stmts.write.parquet(str(tmp_path / "s"))
    entries = table([(1, "T", "one", "c", "a", 1, 1)], "id long, knowledge_type string, title string, content string, related_tables string, embedded int, status int")
    hits = table([(i, 1, 1) for i in range(200)], "query_id long, entry_id long, rank int")
    pairs = table([(["z"], 1)], "table_refs array<string>, entry_id long")
    near = kn.near_context(spark.read.parquet(str(tmp_path / "s")), pairs, entries, hits)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in line and "stmt_id" in line for line in plan.splitlines()), plan
    assert near.count() == 100


@pytest.mark.parametrize("kind", ["random", "ties", "nan", "few"])
def test_hopeful_values_hold_the_largest(kind):
    rng = np.random.default_rng(1)
    cos = rng.uniform(-1, 1, (40, 5 if kind == "few" else 1007))
    if kind == "ties":
        cos = np.round(cos, 1)
    if kind == "nan":
        cos[3:9, 500], cos[7, -1] = np.nan, np.nan
    for k, least in ((3, 0.2), (3, 0.9999), (31, -2.0), (40, 0.0)):
        floor = np.full(len(cos), least)
        if cos.shape[1] > k:
            floor = np.maximum(floor, np.partition(cos, -k, axis=1)[:, -k])
        must = set(zip(*np.nonzero(cos >= floor[:, None]), strict=True))
        row, col = vi._hopeful(cos, k, least)
        got = set(zip(row, col, strict=True))
        assert len(got) == len(row) and must <= got and (cos[row, col] >= least).all() and len(got) <= len(must) + 40 * 40
