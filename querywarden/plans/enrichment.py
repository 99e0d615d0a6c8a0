"""Queries on exemptions and knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from querywarden.operators import exemptions as ex
from querywarden.operators import knowledge as kn
from querywarden.operators import vector_index as vi
from querywarden.plans.inputs import Inputs
from querywarden.plans.metadata import REFS_OF, referenced
from querywarden.plans.registry import query

RULED = {
    **REFS_OF,
    "ruled": r"""
select s.stmt_id, min(r.id) as rule_id from refs_of s join fp f on f.stmt_id = s.stmt_id
join exemption_rules r on r.status = 1 and (r.project_id is null or r.project_id = s.project_id) and (
  (r.rule_type = 'SOURCE_CLASS' and (starts_with(f.source_location, concat(r.pattern, '.'))
    or regexp_extract(f.source_location, '^(.+)\.[^.]*$', 1) = r.pattern
    or ends_with(regexp_extract(f.source_location, '^(.+)\.[^.]*$', 1), concat('.', r.pattern))))
  or (r.rule_type = 'TABLE_NAME' and list_contains(s.refs, lower(r.pattern))))
group by s.stmt_id""",
}


@query("exemption_match", "select f.stmt_id, r.rule_id from fp f left join ruled r using (stmt_id)", RULED)
def exemption_match(inp):
    return ex.exemption_match(referenced(inp), inp.get("exemption_rules")).select("stmt_id", "rule_id")


@query("drop_exempt", "select f.stmt_id from fp f anti join ruled r using (stmt_id)", RULED)
def drop_exempt(inp):
    return ex.drop_exempt(referenced(inp), inp.get("exemption_rules")).select("stmt_id")


@query(
    "exempt_source_class",
    r"""select l.source_location, l.project_id, min(r.id) as rule_id from (select distinct source_location, project_id from statements) l
join exemption_rules r on r.status = 1 and r.rule_type = 'SOURCE_CLASS' and (r.project_id is null or r.project_id = l.project_id)
 and (starts_with(l.source_location, concat(r.pattern, '.')) or ends_with(concat('.', regexp_extract(l.source_location, '^(.+)\.[^.]*$', 1)), concat('.', r.pattern)))
group by 1, 2""",
)
def exempt_source_class(inp):
    return ex.class_rule(inp.get("statements"), inp.get("exemption_rules")).withColumnRenamed("_rule", "rule_id")


@query(
    "exempt_table_name",
    """select array_to_string(refs, ',') as tables, s.project_id, min(r.id) as rule_id from refs_of s
join exemption_rules r on r.status = 1 and r.rule_type = 'TABLE_NAME' and (r.project_id is null or r.project_id = s.project_id)
 and list_contains(refs, lower(r.pattern)) group by 1, 2""",
    REFS_OF,
)
def exempt_table_name(inp):
    out = ex.table_rule(referenced(inp), inp.get("exemption_rules"))
    return out.select(F.array_join("table_refs", ",").alias("tables"), "project_id", F.col("_rule").alias("rule_id"))


def preview_records(inp: Inputs):
    return inp.get("sql_records").withColumnRenamed("sql_text", "sql_normalized")


PREVIEW_TABLE = "status = 1 and project_id % 1 = 0 and contains(lower(sql_text), 't_log')"


@query(
    "exemption_preview",
    f"""select id, source_location, sql_type, case when length(sql_text) > 120 then concat(left(sql_text, 120), '...') else sql_text end as sql_normalized
from sql_records where {PREVIEW_TABLE} order by id limit 50""",
)
def exemption_preview(inp):
    return ex.exemption_preview(preview_records(inp), "TABLE_NAME", "T_LOG")


@query(
    "exemption_preview_counts",
    r"""select count(*) filter (where ends_with(concat('.', regexp_extract(source_location, '^(.+)\.[^.]*$', 1)), '.Mapper7')) as matched_count,
  count(*) as total_records from sql_records where status = 1""",
)
def exemption_preview_counts(inp):
    return ex.exemption_preview_counts(preview_records(inp), "SOURCE_CLASS", "Mapper7")


DOC = """concat('[', knowledge_type, '] ', title, chr(10), case when related_tables is not null then concat('相关表: ', related_tables, chr(10)) else '' end, content)"""


@query("knowledge_document", f"select id, {DOC} as document from knowledge_entries")
def knowledge_document(inp):
    return kn.knowledge_document(inp.get("knowledge_entries"))


@query("reembed_selection", "select id from knowledge_entries where status = 1 and embedded = 0")
def reembed_selection(inp):
    return kn.reembed_selection(inp.get("knowledge_entries")).select("id")


PAIRS = {
    **REFS_OF,
    "pairs": r"""
select distinct s.refs, e.id as entry_id from (select distinct refs from refs_of) s
join (select id, unnest(list_transform(string_split(related_tables, ','), lambda t: lower(trim(t)))) as table_ref
  from knowledge_entries where status = 1 and related_tables is not null) e on list_contains(s.refs, e.table_ref)""",
}


@query("knowledge_by_table", "select array_to_string(refs, ',') as tables, entry_id from pairs", PAIRS)
def knowledge_by_table(inp):
    out = kn.knowledge_by_table(referenced(inp), inp.get("knowledge_entries"))
    return out.select(F.array_join("table_refs", ",").alias("tables"), "entry_id")


HITS = {
    "hits": """
select q.vec_id as query_id, c.vec_id as entry_id, list_inner_product(q.embedding::double[], c.embedding::double[])
    / sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_inner_product(c.embedding::double[], c.embedding::double[])) as similarity
from embeddings q, embeddings c where q.vec_id <> c.vec_id
  and list_inner_product(q.embedding::double[], c.embedding::double[]) > 0.15""",
    "topk": """
select *, row_number() over (partition by query_id order by similarity desc, entry_id) as rank from hits where similarity >= 0.2
qualify rank <= 3""",
}


def top_hits(inp: Inputs):
    """Each vector stands for a statement and for an entry, and asks for the others."""
    vecs = inp.table("embeddings").withColumnRenamed("vec_id", "id")
    return vi.vector_topk(vecs, vecs, k=3, min_similarity=0.2, skip_self=True)


@query(
    "vector_topk",
    "select query_id, entry_id, round(similarity, 6) as similarity, cast(rank as bigint) as rank from topk",
    HITS,
)
def vector_topk(inp):
    hits = top_hits(inp)
    return hits.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


RETRIEVED = {
        **PAIRS,
        **HITS,
        "parts": f"""
select s.stmt_id, 0 as kind, p.entry_id as ord, concat('- **[', knowledge_type, '] ', title, '** (表: ', related_tables, '): ',
  case when length(content) > 500 then concat(left(content, 500), '...') else content end) as part
from refs_of s join pairs p on p.refs = s.refs join knowledge_entries e on e.id = p.entry_id
union all
select s.stmt_id, 1, t.rank, concat('- **[', knowledge_type, '] ', title, '**: ',
  case when length({DOC}) > 500 then concat(left({DOC}, 500), '...') else {DOC} end)
from topk t join refs_of s on s.stmt_id = t.query_id join knowledge_entries e on e.id = t.entry_id
where not exists (select 1 from pairs p where p.refs = s.refs and p.entry_id = t.entry_id)""",
        "bodies": "select stmt_id, string_agg(part, concat(chr(10), chr(10)) order by kind, ord) as body from parts group by stmt_id",
    }


@query(
    "retrieve_context",
    """select f.stmt_id, md5(case when b.body is null then '' else concat('## 相关业务知识（RAG 检索）', chr(10), chr(10), b.body) end) as context_md5 from fp f left join bodies b using (stmt_id)""",
    RETRIEVED,
)
def retrieve_context(inp):
    """The context of statements that cannot differ in it is made once: only ids with a vector can have hits of their own."""
    base = referenced(inp)
    rows, kinds = kn.alike(base, inp.table("embeddings").select("vec_id"), ["table_refs"])
    out = kn.retrieve_context(kinds, inp.get("knowledge_entries"), top_hits(inp), base)
    made = out.select("_own", "table_refs", F.md5("knowledge_context").alias("context_md5"))
    return kn.shared(rows, made, ["table_refs"]).select("stmt_id", "context_md5")
