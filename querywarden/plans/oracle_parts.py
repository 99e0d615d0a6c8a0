"""Common table expressions used by several oracles (DuckDB dialect)."""

NORM = r"trim(regexp_replace(regexp_replace(sql_text, '[#$]\{[^}]*\}', '?', 'g'), '\s+', ' ', 'g'))"

FP = {
    "fp": f"""
select *, {NORM} as sql_normalized,
  case when {NORM} = '' then '' else sha256(lower({NORM})) end as sql_hash,
  case source_type when 'MAPPER_XML' then 0 when 'ANNOTATION' then 1 else 2 end as scan_ord
from statements"""
}


def first_of(where: str = "true") -> str:
    return f"""
select * from fp where sql_hash <> '' and {where}
qualify row_number() over (partition by project_id, sql_hash order by scan_ord, source_file, source_location, stmt_id) = 1"""


# existing inventory and current scan
SCANS = {
    **FP,
    "inv": f"""
select stmt_id as id, project_id, sql_hash, sql_text, source_file, source_location,
  1 as status, 1 as first_scan_id, 1 as last_scan_id from ({first_of('o_custkey % 7 <> 0')})""",
    "scan": first_of("o_custkey % 5 <> 0"),
}

# raw references of a column `q` (normalised SQL); list keeps first occurrences in order
REFS = r"""
list_filter(list_transform(regexp_extract_all(q, '(?i)(?:^|\s)(?:from|join|into|update)\s+(\S+)', 1),
  lambda t: regexp_replace(lower(regexp_replace(t, '[`,;()]+', '', 'g')), '^.*\.', '')),
  lambda n: n <> '' and not starts_with(n, 'select') and not starts_with(n, '_'))"""

# name -> base table of the metadata, exact name first, then without one shard suffix
RESOLVE = {
    "names": "select distinct t.table_ref from (select unnest(refs) as table_ref from refs_of) t",
    "resolved": r"""
select n.table_ref, coalesce(m1.table_name, m2.table_name) as base_table,
  coalesce(m1.estimated_rows, m2.estimated_rows) as estimated_rows
from names n left join table_meta m1 on m1.table_name = n.table_ref
left join table_meta m2 on m2.table_name = nullif(regexp_extract(n.table_ref, '^(.+?)(_\d{4,}|_\d{1,2})$', 1), '')""",
}

LATEST = {
    "latest": """
select * from analyses qualify row_number() over (partition by sql_record_id order by create_time desc, id desc) = 1"""
}
