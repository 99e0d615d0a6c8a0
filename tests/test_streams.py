from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from querywarden.sources.files import source_tree_stream
from querywarden.streaming import assessments as at
from querywarden.streaming import file_log as fl
from querywarden.streaming import health as hl
from querywarden.streaming import inventory_log as il
from querywarden.streaming.compaction import newest
from querywarden.streaming.push import route_push_events
from querywarden.streaming.runner import drain, drain_to_parquet

STMT = "stmt_id long, project_id long, source_file string, source_location string, source_type string, sql_text string"


def test_inventory_log(spark, tmp_path, table):
    root = str(tmp_path / "log")
    first = table([(1, 1, "a", "l", "ANNOTATION", "select 1"), (2, 1, "a", "l", "ANNOTATION", "select 2"), (3, 1, "b", "l", "ANNOTATION", "select 3")], STMT)
    second = table([(4, 1, "a", "l", "ANNOTATION", "select 2"), (5, 1, "c", "l", "ANNOTATION", "select 3"), (6, 1, "b", None, None, None)], STMT)
    want = [("select 1", "a", 0, 0, 0), ("select 2", "a", 0, 1, 1), ("select 3", "c", 0, 1, 1)]
    cols = ["sql_text", "source_file", "first_scan_id", "last_scan_id", "status"]
    for n, batch in [(0, first), (1, second), (1, second)]:  # the last one is a replay
        il.apply_batch(batch, n, root, compact_every=2)
    assert rows(il.current_inventory(spark, root), *cols) == want
    assert newest(spark, f"{root}/seen") == 1 and newest(spark, f"{root}/files", 1) is None
    il.apply_batch(first, 2, root, compact_every=2)
    assert [r[0] for r in rows(il.current_inventory(spark, root), "sql_text") if r] == ["select 1", "select 2", "select 3"]
    il.apply_batch(table([(7, 1, "d", "l", "ANNOTATION", "select 4")], STMT), 3, root, compact_every=2)
    assert newest(spark, f"{root}/seen") == 3 and il.current_inventory(spark, root).filter("status = 1").count() == 4


def test_assessments_continue_across_batches(spark, tmp_path, table):
    base, schema = datetime(2024, 1, 1), "k string, assessed_at timestamp_ntz"
    root = str(tmp_path / "ttl")
    hours = [[0, 3], [20, 25], [26, 48, 49, 60], [90]]
    for n, part in enumerate(hours):
        df = table([("a", base + timedelta(hours=h)) for h in part], "k string, ts timestamp_ntz")
        at.apply_batch(df, n, root, "k", "ts", schema)
        at.apply_batch(df, n, root, "k", "ts", schema)
    got = sorted((r.assessed_at - base).total_seconds() / 3600 for r in at.assessments(spark, root, schema).collect())
    assert got == [0, 25, 49, 90]


def test_file_log_of_a_source_tree(spark, tmp_path):
    tree, mark, log = (str(tmp_path / x) for x in ("tree", "mark", "log"))
    steps = [{"a/X.xml": "one", "test/T.xml": "no", "a/Y.xml": "same"}, {"b/Z.xml": "new"}, {"a/W.xml": "more"}]
    for step in steps:
        for path, text in step.items():
            (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "tree" / path).write_text(text)
        drain(source_tree_stream(spark, tree, "xml", 1), mark, lambda df, n: fl.apply_batch(df, n, log))
    assert rows(fl.latest(fl.file_changes(spark, log)), "path", "change") == [("a/W.xml", "ADD"), ("a/X.xml", "ADD"), ("a/Y.xml", "ADD"), ("b/Z.xml", "ADD")]
    files = lambda *r: spark.createDataFrame(r, "path string, content string")
    n = fl.file_changes(spark, log).agg(F.max("batch")).first()[0] + 1
    for _ in range(2):  # the second is a replay
        fl.apply_batch(files(("a/X.xml", "two"), ("a/Y.xml", "same"), ("N.xml", None)), n, log)
    got = fl.file_changes(spark, log).filter(F.col("batch") == n)
    assert rows(got, "path", "change") == [("N.xml", "ADD"), ("a/X.xml", "MODIFY")]


def test_provider_health_batches(spark, tmp_path, table):
    base = datetime(2024, 1, 1)
    oks = {1: [1, 0, 0, 0, 0, 1, 0], 2: [0, 0, 0, 0], 3: [0, 1]}
    calls = [(p * 100 + i, base + timedelta(seconds=i), p, ok) for p, seq in oks.items() for i, ok in enumerate(seq)]
    for n, (lo, hi) in enumerate([(0, 3), (3, 6), (6, 9)]):
        part = [c for c in calls if lo <= (c[1] - base).seconds < hi]
        hl.apply_batch(table(part, "event_id long, ts timestamp_ntz, provider long, ok int"), n, str(tmp_path), compact_every=2)
    out = hl.provider_health(spark, str(tmp_path), F.lit(base + timedelta(seconds=30)).cast("timestamp_ntz"))
    assert rows(out, "provider", "streak", "cooling") == [(1, 1, False), (2, 4, True), (3, 0, False)]


def test_push_routing(table):
    events = table(
        [
            (1, "push", "refs/heads/master", "git@h.com:a/b.git", "https://h.com/a/b"),
            (2, "ping", "refs/heads/master", "git@h.com:a/b.git", None),
            (3, "push", "refs/heads/dev", "git@h.com:a/b.git", None),
            (4, "push", None, "git@h.com:a/b.git", None),
        ],
        "event_id long, kind string, ref string, ssh_url string, http_url string",
    )
    projects = table(
        [(10, "HTTPS://H.com/a/B.git", None, 1), (11, "https://h.com/a/b/", "dev", 1), (12, "https://h.com/a/b", None, 0), (13, None, None, 1)],
        "id long, git_remote_url string, git_branch string, status int",
    )
    assert rows(route_push_events(events, projects)) == [(1, 10), (3, 11)]


def test_watermark_dedup(spark, tmp_path, table):
    base = datetime(2024, 1, 1)
    source, sink, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))
    schema = "k string, ts timestamp"
    # 'b' at 60 still meets its state, since the watermark moves only after its batch; at 70 it is expired;
    # 'c' at 2 is late
    for part in ([("a", 0), ("a", 5), ("b", 1)], [("b", 60)], [("b", 70)], [("a", 72), ("c", 2)], [("a", 73)]):
        table([(k, base + timedelta(hours=h)) for k, h in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drain_to_parquet(at.dedup_within_watermark(stream, "k", "ts"), mark, sink)
    out = [(r.k, (r.ts - base).total_seconds() / 3600) for r in spark.read.schema(schema).parquet(sink).collect()]
    assert sorted(out)[1:] == [("a", 72.0), ("b", 1.0), ("b", 70.0)] and sorted(out)[0] in (("a", 0.0), ("a", 5.0))
