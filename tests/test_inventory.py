import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from querywarden.operators import changes as ch
from querywarden.operators import expiry as ttl
from querywarden.operators import inventory as inv
from querywarden.operators.ranking import number_by_hash, top_n

INV = (
    "id long, project_id long, sql_hash string, sql_text string, source_file string, source_location string, "
    "status int, first_scan_id long, last_scan_id long"
)
SCAN = "project_id long, sql_hash string, sql_text string, source_file string, source_location string"


def record(i, h, file="a.xml", status=1, project=1):
    return (i, project, h, f"sql {h}", file, "L.m", status, 1, 1)


def scanned(h, file="a.xml", project=1):
    return (project, h, f"sql {h}", file, "L.m")


def test_first_occurrence_prefers_scan_order_then_path(table):
    cols = "stmt_id long, project_id long, source_type string, source_file string, source_location string, sql_text string"
    st = inv.with_fingerprint(
        table(
            [
                (1, 1, "QUERY_WRAPPER", "a", "l", "select 1"),
                (2, 1, "MAPPER_XML", "z", "l", "SELECT  1"),
                (3, 1, "MAPPER_XML", "y", "l", "select 1 "),
                (4, 1, "ANNOTATION", "a", "l", " \n"),
                (5, 2, "ANNOTATION", "a", "l", "select 1"),
            ],
            cols,
        )
    )
    assert rows(inv.first_occurrence(st), "stmt_id") == [(3,), (5,)]


def test_delta_parts_are_disjoint_and_cover_both_sides(table):
    cur = table([(1, "a"), (1, "b"), (2, "a")], "project_id long, sql_hash string")
    old = table([(1, "b"), (1, "c"), (1, "c")], "project_id long, sql_hash string")
    assert rows(inv.statement_delta(cur, old)) == [(1, "a", "new"), (1, "b", "unchanged"), (1, "c", "removed"), (2, "a", "new")]


def test_full_scan(table):
    old = table([record(1, "a"), record(2, "b"), record(3, "c", status=0), record(9, "a", project=2)], INV)
    scan = table([scanned("a", "new.xml"), scanned("c"), scanned("d")], SCAN)
    out = inv.full_scan_upsert(old, scan, 5, projects=table([(1,)], "project_id long"))
    got = rows(out, "id", "sql_hash", "source_file", "status", "first_scan_id", "last_scan_id", "change")
    assert got == [
        (1, "a", "new.xml", 1, 1, 5, "refreshed"),
        # a retired statement that reappears becomes a new record
        (10, "c", "a.xml", 1, 5, 5, "new"),
        (11, "d", "a.xml", 1, 5, 5, "new"),
        (2, "b", "a.xml", 0, 1, 1, "retired"),
        (3, "c", "a.xml", 0, 1, 1, "kept"),
        (9, "a", "a.xml", 1, 1, 1, "kept"),
    ]


def test_full_scan_is_idempotent(table):
    old = table([record(1, "a"), record(2, "b")], INV)
    scan = table([scanned("a"), scanned("d")], SCAN)
    once = inv.full_scan_upsert(old, scan, 5).drop("change")
    twice = inv.full_scan_upsert(once, scan, 5).drop("change")
    assert rows(once) == rows(twice)


def test_incremental_rename_keeps_the_statement(table):
    # the statement moves from old.java to new.java: order of files must not lose it
    old = table([record(1, "h", "old.java"), record(2, "k", "other.java")], INV)
    changes = table([(1, "old.java", "DELETE"), (1, "new.java", "ADD")], "project_id long, source_file string, change_type string")
    out = inv.incremental_scan_upsert(old, table([scanned("h", "new.java")], SCAN), changes, 7)
    assert rows(out, "id", "source_file", "status", "change") == [
        (1, "old.java", 0, "retired"), (2, "other.java", 1, "kept"), (3, "new.java", 1, "new"),
    ]


def test_incremental_file_without_statements_retires_its_records(table):
    old = table([record(1, "h", "a.java"), record(2, "k", "b.java")], INV)
    changes = table([(1, "a.java", "MODIFY")], "project_id long, source_file string, change_type string")
    out = inv.incremental_scan_upsert(old, table([], SCAN), changes, 7)
    assert rows(out, "id", "status") == [(1, 0), (2, 1)]


def test_incremental_refreshes_hash_active_elsewhere(table):
    old = table([record(1, "h", "a.java")], INV)
    changes = table([(1, "b.java", "ADD")], "project_id long, source_file string, change_type string")
    out = inv.incremental_scan_upsert(old, table([scanned("h", "b.java")], SCAN), changes, 7)
    assert rows(out, "id", "source_file", "last_scan_id", "change") == [(1, "a.java", 7, "refreshed")]


def test_summary_counts_each_statement_once(table):
    up = table([(1, 1, "new"), (2, 1, "refreshed"), (3, 1, "retired"), (4, 1, "kept")], "id long, project_id long, change string")
    latest = table([(1, "P1"), (2, "P4"), (3, "P0")], "sql_record_id long, final_risk_level string")
    assert rows(inv.scan_batch_summary(up, latest)) == [(1, 2, 1, 0, 1, 1)]


def test_cleanup(table):
    cols = "id long, project_id long, sql_hash string, sql_text string, status int"
    recs = table([(1, 1, "a", "x", 1), (2, 1, "a", "x", 1), (3, 1, "a", "x from _unknown", 1), (4, 2, "a", None, 1), (5, 1, "a", "x", 0)], cols)
    clean = inv.retire_unknown(recs).drop("retired_now")
    assert rows(inv.retire_duplicates(clean), "id", "status") == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]


def test_reuse_prior(table):
    recs = table([(1, "h", 1), (2, "h", 1), (3, "h", 1), (4, "k", 1), (5, "h", 0)], "id long, sql_hash string, status int")
    ana = table(
        [(10, 2, datetime(2024, 1, 1), "P2", "m"), (11, 2, datetime(2024, 1, 2), "P1", "m"), (12, 3, datetime(2024, 1, 1), "P4", "m")],
        "id long, sql_record_id long, create_time timestamp_ntz, final_risk_level string, ai_model string",
    )
    out = inv.reuse_prior_analysis(recs, ana)
    assert rows(out, "sql_record_id", "prior_record_id", "final_risk_level") == [(1, 2, "P1")]


def greedy(times, ttl):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= ttl:
            kept.append(t)
    return kept


def test_ttl_fold_equals_the_sequential_cache(spark, table):
    base = datetime(2024, 1, 1)
    hours = {"a": [0, 5, 23, 24, 30, 47, 48, 49, 90, 200], "b": [1, 30, 55, 80], "c": [100]}
    data = [(k, base + timedelta(hours=h)) for k, hs in hours.items() for h in hs]
    out = ttl.assess_with_ttl(table(data, "k string, ts timestamp_ntz"), "k", "ts")
    want = sorted((k, t) for k in hours for t in greedy([x for kk, x in data if kk == k], timedelta(hours=24)))
    assert sorted(tuple(r) for r in out.collect()) == want


@pytest.mark.parametrize("span", [timedelta(microseconds=1), timedelta(minutes=10), timedelta(days=40)])
def test_expiry_at_any_time_to_live(spark, table, span):
    rng, base = random.Random(7), datetime(2024, 1, 1)
    data = [(rng.choice(["a", "a", "b", "null", None]), base + timedelta(microseconds=rng.choice([1, 10**6, 10**9]) * rng.randint(0, 3000))) for _ in range(700)]
    data += [("c", None), (None, None), ("d", base), ("d", base)] + data[:40]
    df, half = table(data, "k string, ts timestamp_ntz"), base + timedelta(seconds=1500)
    want = sorted(((k, t) for k in {k for k, _ in data} for t in greedy({x for kk, x in data if kk == k and x}, span)), key=str)
    assert sorted((tuple(r) for r in ttl.assess_with_ttl(df, "k", "ts", span).collect()), key=str) == want
    first = ttl.assess_with_ttl(df.filter(F.col("ts") < F.lit(half)), "k", "ts", span).collect()
    state = table([tuple(r) for r in first], "k string, assessed_at timestamp_ntz").groupBy("k").agg(F.max("assessed_at").alias("assessed_at"))
    rest = ttl.assess_with_ttl(df.filter(F.col("ts") >= F.lit(half)), "k", "ts", span, state).collect()
    assert sorted((tuple(r) for r in [*first, *rest]), key=str) == want
    assert ttl.assess_with_ttl(df.limit(0), "k", "ts", span).count() == 0


def test_jobs_of_expiry_grow_with_the_logarithm_of_time(spark, table):
    def jobs(days):
        spark.sparkContext.setJobGroup(f"expiry-{days}", "")
        data = [("a", datetime(2024, 1, 1) + timedelta(days=d)) for d in (*range(5), days)]
        assert ttl.assess_with_ttl(table(data, "k string, ts timestamp_ntz"), "k", "ts").count() == 6
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"expiry-{days}"))
        spark.sparkContext.setJobGroup("tests", "")
        return n

    assert jobs(700) <= jobs(7)


def test_ttl_window_counts_any_earlier_occurrence(table):
    base = datetime(2024, 1, 1)
    data = [(i, "a", base + timedelta(hours=h)) for i, h in enumerate([0, 0, 1, 25, 49.5, 74])]
    out = inv.seen_within_ttl(table(data, "i long, k string, ts timestamp_ntz"), "k", "ts")
    assert rows(out, "i", "reused") == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False)]


def test_budget_and_top_n_keep_exact_ranks(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    out = top_n(df, ["g"], [F.col("v")], 5, "id")
    assert rows(out, "v", "rank") == [(i, i + 1) for i in range(5)]


def test_numbers_are_consecutive_in_hash_order(spark):
    df = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    out = [tuple(r) for r in number_by_hash(df, "h", ["id"], F.lit(50), "n").select("h", "n").collect()]
    assert [n for _, n in sorted(out)] == list(range(51, 351))


def test_upsert_by_key(table):
    old, new = table([("a", 1), ("b", 2)], "k string, v long"), table([("b", 3), ("c", 4)], "k string, v long")
    assert rows(inv.upsert_by_key(old, new, "k")) == [("a", 1, "kept"), ("b", 3, "updated"), ("c", 4, "created")]


def test_file_delta(table):
    before = table([("a.xml", "1"), ("b.java", "1"), ("src/test/t.java", "1"), ("same.java", "9")], "path string, content_hash string")
    after = table([("a.xml", "2"), ("c.java", "1"), ("same.java", "9"), ("x/test/n.xml", "1"), ("n.txt", "1")], "path string, content_hash string")
    delta = ch.file_snapshot_delta(before, after)
    # b.java to c.java is a rename: delete plus add; test folders count for neither side
    assert rows(ch.delta_path_filter(delta)) == [("a.xml", "MODIFY", "XML"), ("b.java", "DELETE", "JAVA"), ("c.java", "ADD", "JAVA")]
    assert rows(ch.delta_summary(delta)) == [(1, 1, 0, 1, 6, True)]
    assert rows(ch.delta_summary(delta.limit(0))) == [(0, 0, 0, 0, 0, False)]


def test_patch_lines(table):
    df = table(
        [("a", "--- a\n+++ b\n+x\n+y\n-z\n same", True, False, False), ("b", None, False, True, True)],
        "path string, diff string, new_file boolean, deleted_file boolean, renamed_file boolean",
    )
    assert rows(ch.patch_line_stats(df)) == [("a", "added", 2, 1), ("b", "deleted", 0, 0)]
