"""Stream queries: the given tables arrive in slices, the result equals that of a batch on all of them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.plans.inputs import Inputs
from querywarden.plans.oracle_parts import FP
from querywarden.plans.registry import query
from querywarden.session import scratch_dir
from querywarden.streaming import assessments as at
from querywarden.streaming import health as hl
from querywarden.streaming import inventory_log as il
from querywarden.streaming import push
from querywarden.streaming.runner import drain, drain_to_parquet

ROUTED = {
    "routed": r"""
select e.event_id, p.id as project_id from (
  select event_id, replace(ref, 'refs/heads/', '') as branch, regexp_replace(regexp_replace(replace(regexp_replace(lower(ssh_url), '^(https?://|git@)', ''), ':', '/'), '\.git$', ''), '/$', '') as k1,
    regexp_replace(regexp_replace(replace(regexp_replace(lower(http_url), '^(https?://|git@)', ''), ':', '/'), '\.git$', ''), '/$', '') as k2
  from push_events where kind = 'push') e
join (select *, regexp_replace(regexp_replace(replace(regexp_replace(lower(git_remote_url), '^(https?://|git@)', ''), ':', '/'), '\.git$', ''), '/$', '') as k
  from projects where status = 1) p on (p.k = e.k1 or p.k = e.k2) and coalesce(p.git_branch, 'master') = e.branch"""
}


@query("push_event_route", "select event_id, project_id from routed", ROUTED)
def push_event_route(inp):
    return push.route_push_events(inp.get("push_events"), inp.get("projects"))


@query("push_event_route_stream", "select event_id, project_id from routed", ROUTED)
def push_event_route_stream(inp):
    source, sink, mark = (scratch_dir(inp.spark, f"push-{part}") for part in ("in", "out", "mark"))
    events = inp.get("push_events").select("event_id", "kind", "ref", "ssh_url", "http_url")
    events.write.json(source)
    stream = inp.spark.readStream.schema(events.schema).json(source)
    drain_to_parquet(push.route_push_events(stream, inp.get("projects")), mark, sink)
    return inp.spark.read.schema("event_id long, project_id long").parquet(sink)


def arrive(inp: Inputs, slices: list[DataFrame], label: str, on_batch) -> str:
    """Let slices arrive one after the other at a folder and drain the stream after each."""
    source, mark = scratch_dir(inp.spark, f"{label}-in"), scratch_dir(inp.spark, f"{label}-mark")
    root = scratch_dir(inp.spark, f"{label}-log")
    for part in slices:
        part.write.mode("append").parquet(source)
        stream = inp.spark.readStream.schema(part.schema).parquet(source)
        drain(stream, mark, lambda df, n: on_batch(df, n, root))
    return root


SCANS = 3


@query(
    "stream_incremental_upsert",
    """select m.project_id, m.sql_hash, m.source_file, m.source_location, m.first_scan_id, m.last_scan_id,
  case when f.last_file > m.last_scan_id then 0 else 1 end as status
from merged m join (select project_id, source_file, max(o_custkey % 3) as last_file from fp group by 1, 2) f using (project_id, source_file)""",
    {
        **FP,
        "per_batch": """select *, o_custkey % 3 as b from fp where sql_hash <> ''
qualify row_number() over (partition by project_id, sql_hash, o_custkey % 3 order by scan_ord, source_file, source_location, stmt_id) = 1""",
        "merged": """select *, min(b) over (partition by project_id, sql_hash) as first_scan_id, b as last_scan_id from per_batch
qualify row_number() over (partition by project_id, sql_hash order by b desc) = 1""",
    },
)
def stream_incremental_upsert(inp):
    statements = inp.get("statements")
    slices = [statements.filter(F.col("o_custkey") % SCANS == b) for b in range(SCANS)]
    root = arrive(inp, slices, "inventory", lambda df, n, root: il.apply_batch(df, n, root, compact_every=2))
    return il.current_inventory(inp.spark, root).drop("sql_text")


def in_time_order(df: DataFrame) -> list[DataFrame]:
    """Three slices of the rows, the first ten days of the month first."""
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    return [df.filter(third == n) for n in range(3)]


@query(
    "stream_dedup_ttl",
    "select user_id, assessed_at from chain",
    {
        "chain": """
select user_id, min(ts) as assessed_at from events group by user_id
union all
select c.user_id, (select min(e.ts) from events e where e.user_id = c.user_id and e.ts >= c.assessed_at + interval 24 hours)
from chain c where exists (select 1 from events e where e.user_id = c.user_id and e.ts >= c.assessed_at + interval 24 hours)"""
    },
)
def stream_dedup_ttl(inp):
    schema = "user_id long, assessed_at timestamp_ntz"
    slices = in_time_order(inp.table("events").select("user_id", "ts"))
    root = arrive(inp, slices, "ttl", lambda df, n, root: at.apply_batch(df, n, root, "user_id", "ts", schema))
    return at.assessments(inp.spark, root, schema).drop("batch")


@query(
    "stream_provider_health",
    """select provider, cast(count(*) filter (where ok = 0 and (ok_ts is null or ts > ok_ts)) as bigint) as streak, max(ts) filter (where ok = 0 and (ok_ts is null or ts > ok_ts)) as last_failure,
  count(*) filter (where ok = 0 and (ok_ts is null or ts > ok_ts)) >= 3 and timestamp '2024-01-31 00:00:00' - max(ts) filter (where ok = 0 and (ok_ts is null or ts > ok_ts)) < interval 5 day as cooling
from (select *, max(ts) filter (where ok = 1) over (partition by provider) as ok_ts from call_log) group by provider""",
)
def stream_provider_health(inp):
    slices = in_time_order(inp.get("call_log").select("event_id", "ts", "provider", "ok"))
    root = arrive(inp, slices, "health", lambda df, n, root: hl.apply_batch(df, n, root, compact_every=2))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return hl.provider_health(inp.spark, root, as_of, cooldown=timedelta(days=5))
