"""Queries that apply the column functions, and payload decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from querywarden.functions import text as tx
from querywarden.operators import payloads as pl
from querywarden.plans.registry import query


@query(
    "truncate_ellipsis",
    "select doc_id, "
    + ", ".join(
        f"case when length(text) > {n} then concat(left(text, {n}), '...') else text end as t{n}" for n in (120, 200, 300, 500)
    )
    + ", case when lang = 'en' then '' when length(text) > 9 then concat(left(text, 9), '...') else text end as blanked from documents",
)
def truncate_ellipsis(inp):
    docs, text = inp.table("documents"), F.col("text")
    some = F.when(F.col("lang") != "en", text)
    return docs.select(
        "doc_id",
        *[tx.truncate_ellipsis(text, n).alias(f"t{n}") for n in (120, 200, 300, 500)],
        tx.truncate_ellipsis(some, 9, "").alias("blanked"),
    )


@query(
    "repo_name",
    r"""select page_id, regexp_replace(case when trim(last) = '' then concat('page.', page_id::varchar) else last end, '[^A-Za-z0-9_-]', '_', 'g') as repo
from (select page_id, regexp_extract(regexp_replace(regexp_replace(trim(u), '\.git$', ''), '/$', ''), '([^/]*)$', 1) as last
  from (select page_id, case when page_id % 3 = 0 then concat(url, '.git') when page_id % 3 = 1 then concat(url, '/') when page_id % 5 = 0 then '' else url end as u from pages))""",
)
def repo_name(inp):
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".git")))
        .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/")))
        .when(F.col("page_id") % 5 == 0, "")
        .otherwise(F.col("url"))
    )
    fallback = F.concat(F.lit("page."), F.col("page_id").cast("string"))
    return inp.table("pages").select("page_id", tx.repo_name(url, fallback).alias("repo"))


@query("short_id", "select doc_id, left(md5(text), 8) as short_id from documents")
def short_id(inp):
    return inp.table("documents").select("doc_id", tx.short_id(F.md5("text")).alias("short_id"))


@query("first_line", "select doc_id, split_part(text, chr(10), 1) as title from documents")
def first_line(inp):
    return inp.table("documents").select("doc_id", tx.first_line(F.col("text")).alias("title"))


@query(
    "format_timestamp",
    "select event_id, case when event_type = 'error' then '' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as shown from events",
)
def format_timestamp(inp):
    ts = F.when(F.col("event_type") != "error", F.col("ts"))
    return inp.table("events").select("event_id", tx.format_timestamp(ts).alias("shown"))


@query(
    "query_param",
    r"""select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page_no, case when contains(url, 'ref=') then regexp_extract(url, '[?&]ref=([^&#]*)', 1) end as ref,
  concat('a b', chr(38), page_id::varchar) as code from pages""",
)
def query_param(inp):
    made = F.concat(F.lit("http://h/p?x=1&code=a%20b%26"), F.col("page_id").cast("string"))
    url = F.col("url")
    return inp.table("pages").select(
        "page_id",
        tx.query_param(url, "page").alias("page_no"),
        tx.query_param(url, "ref").alias("ref"),
        tx.query_param(made, "code").alias("code"),
    )


@query(
    "source_class_split",
    r"""select id, regexp_extract(source_location, '^(.+)\.[^.]*$', 1) as class_part, regexp_extract(source_location, '([^.]*)$', 1) as method_part from sql_records""",
)
def source_class_split(inp):
    loc = F.col("source_location")
    return inp.get("sql_records").select("id", tx.source_class(loc).alias("class_part"), tx.source_method(loc).alias("method_part"))


@query("json_path", r"select event_id, regexp_extract(props, '\d+') as k, cast(null as varchar) as missing from events")
def json_path(inp):
    rows = inp.table("events").select("event_id", F.concat(F.lit('{"a": '), F.col("props"), F.lit("}")).alias("body"))
    return pl.json_path(rows, {"k": "a.k", "missing": "a.b.c"}).drop("body")


@query(
    "suggestion_text",
    """select doc_id, case doc_id % 4 when 0 then '暂无' when 1 then concat('add ', source, chr(10), chr(10), 'drop ', lang) when 2 then concat('plain ', source) else concat('[broken "', lang) end as shown from documents""",
)
def suggestion_text(inp):
    stored = F.expr(
        """case doc_id % 4 when 0 then null when 1 then concat('["add ', source, '","drop ', lang, '"]') when 2 then concat('plain ', source) else concat('[broken "', lang) end"""
    )
    return inp.table("documents").select("doc_id", tx.suggestion_text(stored).alias("shown"))


@query(
    "git_url_normalize",
    r"""select event_id, regexp_replace(regexp_replace(replace(regexp_replace(lower(ssh_url), '^(https?://|git@)', ''), ':', '/'), '\.git$', ''), '/$', '') as ssh_key,
  regexp_replace(regexp_replace(replace(regexp_replace(lower(http_url), '^(https?://|git@)', ''), ':', '/'), '\.git$', ''), '/$', '') as http_key from push_events""",
)
def git_url_normalize(inp):
    return inp.get("push_events").select(
        "event_id", tx.git_url_key(F.col("ssh_url")).alias("ssh_key"), tx.git_url_key(F.col("http_url")).alias("http_key")
    )


COMMITS = """
select event_id, concat('[{"sha":"', md5(cast(event_id as string)), '","commit":{"message":"fix ', event_type, '\\\\nmore","author":{"name":"dev', cast(user_id as string), '","date":"2024-01-01T00:00:00Z"}},"parents":[{"sha":"',
  md5(cast(event_id + 1 as string)), '"},{"sha":"p2"}]},{"sha":"s', cast(event_id as string), '","commit":{"message":"one","author":{"name":"x","date":"d"}},"parents":[]}]') as body
from events"""


@query(
    "commit_payload_flatten",
    """select event_id, md5(event_id::varchar) as commit_id, left(md5(event_id::varchar), 8) as short_id, concat('fix ', event_type) as title, concat('dev', user_id::varchar) as author,
  '2024-01-01T00:00:00Z' as created_at, concat(md5((event_id + 1)::varchar), ',p2') as parents from events
union all select event_id, concat('s', event_id::varchar), left(concat('s', event_id::varchar), 8), 'one', 'x', 'd', '' from events""",
)
def commit_payload_flatten(inp):
    out = pl.commit_payload_flatten(inp.sql(COMMITS))
    return out.withColumn("parents", F.array_join("parent_ids", ",")).drop("parent_ids")


@query(
    "string_rows_decode",
    "select n_nationkey as k, concat('tab', n_nationkey::varchar) as TABLE_NAME, (n_nationkey * 10)::varchar as TABLE_ROWS, cast(null as varchar) as ABSENT from nation "
    "union all select n_nationkey, n_name, null, null from nation",
)
def string_rows_decode(inp):
    rows = inp.sql(
        """select n_nationkey as k, array('TABLE_NAME', 'TABLE_ROWS') as headers,
  array(concat('["tab', cast(n_nationkey as string), '", ', cast(n_nationkey * 10 as string), ']'), concat('["', n_name, '", null]')) as rows from nation"""
    )
    return pl.string_rows_decode(rows, ["TABLE_NAME", "TABLE_ROWS", "ABSENT"])
