"""DuckDB SQL of the corpus queries that SQL can express.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from querywarden.llm import line_rules

NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


EXACT = f"""
    with norm as (select doc_id, {NORMAL} as t from documents),
    groups as (select t, max(doc_id) as keep_id, count(*) as group_size from norm group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
    from norm join groups using (t)
"""

#: repeated windows of 35 words: each word in one goes
SPANS = f"""
    with docs as (select doc_id, {WORDS} as w from documents),
    windows as (
        select doc_id, unnest(range(1, greatest(len(w) - 33, 1))) as pos, w from docs where len(w) >= 35
    ),
    keyed as (select doc_id, pos, sha256(array_to_string(w[pos:pos + 34], ' ')) as k from windows),
    hot as (select k from keyed group by k having count(*) > 1),
    gone as (
        select distinct doc_id, unnest(range(pos, pos + 35)) as pos from keyed where k in (from hot)
    ),
    gone_of as (select doc_id, count(*) as n, list(pos) as positions from gone group by doc_id),
    kept as (
        select doc_id, string_agg(w[pos], ' ' order by pos) as t
        from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from docs) as p anti join gone using (doc_id, pos)
        group by doc_id
    )
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
    from docs as d left join gone_of as g using (doc_id) left join kept as k using (doc_id)
"""

#: pairs with Jaccard >= 0.8 on runs of five words, found by shared runs; classes by least reachable id
NEAR = f"""
    with recursive docs as (select doc_id, {WORDS} as w from documents),
    sets as (
        select distinct doc_id, array_to_string(w[pos:pos + 4], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as pos from docs where len(w) > 0)
    ),
    sizes as (select doc_id, count(*) as n from sets group by doc_id),
    pairs as (
        select a.doc_id as a, b.doc_id as b, count(*) as shared
        from sets as a join sets as b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
    ),
    links as (
        select a, b from pairs join sizes as x on x.doc_id = a join sizes as y on y.doc_id = b
        where 5 * shared >= 4 * (x.n + y.n - shared)
    ),
    ties as (select a, b from links union all select b, a from links),
    reach(node, least) as (
        select doc_id, doc_id from docs
        union
        select t.b, r.least from reach as r join ties as t on t.a = r.node where r.least < t.b
    ),
    degree as (select a as doc_id, count(*) as n from ties group by a)
    select d.doc_id, min(r.least) as class_id, coalesce(any_value(g.n), 0)::bigint as n_links, coalesce(any_value(s.n), 0)::bigint as n_tokens
    from docs as d join reach as r on r.node = d.doc_id left join degree as g using (doc_id) left join sizes as s using (doc_id)
    group by d.doc_id
"""

#: the measures of a text, and the verdict of the line rules by each line's words
RULES = rf"""
    with docs as (select doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
    lines as (
        select doc_id, line, regexp_extract_all(line, '{WORD}') as lw
        from (select doc_id, unnest(string_split(t, chr(10))) as line from docs)
        where regexp_matches(line, '{WORD}')
    ),
    judged as (
        select doc_id, line, len(array_to_string(lw, '')) as chars,
            length(line) - length(replace(line, ' ', '')) + 1 as n,
            len(list_filter(lw, lambda x: list_contains(['|', '»', '›', '>', '::', '•', '·', '/'], x))) as seps,
            len(list_filter(lw, lambda x: regexp_matches(x, '(?:[#*$%&<>^~_=\\]{{2,}}|[!?]{{2,}})[.,]?$'))) as odd,
            regexp_matches(line, '[\pL\pN]') as lettered,
            len(regexp_extract_all(line, '(?i){_quoted(line_rules.BOILERPLATE.pattern)}')) as phrases
        from lines
    ),
    failed as (
        select *, (seps >= {line_rules.MIN_SEPARATORS} and n <= {line_rules.WORDS_PER_SEPARATOR + 1} * seps)
            or odd > {line_rules.MAX_ODD}::double * n or not lettered
            or (phrases > 0 and n <= {line_rules.WORDS_PER_PHRASE} * phrases) as bad
        from judged
    ),
    by_doc as (
        select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) filter (bad) as n_bad_lines,
            coalesce(sum(chars) filter (bad), 0) as lost_chars
        from failed group by doc_id
    ),
    windows as (
        select doc_id, pos, array_to_string(w[pos:pos + 7], ' ') as k
        from (select doc_id, w, unnest(range(1, len(w) - 6)) as pos from docs where len(w) >= 8)
    ),
    hot as (select doc_id, k from windows group by doc_id, k having count(*) > 1),
    repepositions as (
        select doc_id, count(*) as n
        from (select distinct doc_id, unnest(range(pos, pos + 8)) as pos from windows semi join hot using (doc_id, k))
        group by doc_id
    ),
    measured as (
        select doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
            coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
            coalesce(n_bad_lines, 0)::bigint as n_bad_lines, coalesce(lost_chars, 0)::bigint as lost_chars
        from docs left join by_doc using (doc_id) left join repepositions as r using (doc_id)
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_bad_lines, lost_chars,
        not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost_chars <= {line_rules.MAX_LOST}::double * word_chars as kept
    from measured
"""

def _crc32(text: str) -> str:
    """Unsigned CRC-32 (reversed polynomial 0xEDB88320) of a text's UTF-8, byte by byte; ``crc_table`` must be joined."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::int + 1, 2))::bigint)"
    step = "xor(acc >> 8, crc_t[(xor(acc, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda acc, b: {step}), 4294967295)"


CRC_TABLE = """crc_table as (
        select list(c order by i) as crc_t from (
            select i, list_reduce(list_concat([i], range(8)), lambda x, _: xor(x >> 1, (x & 1) * 3988292384)) as c
            from (select unnest(range(256)) as i)
        )
    )"""

#: words one edit apart share what is left without one letter; roots by following the forms
VARIANTS = f"""
    with recursive {CRC_TABLE},
    runs as (
        select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({NORMAL}, '[A-Za-z\u00C0-\u00FF]+')) as run from documents
    ),
    counted as (select id, run, count(*) as n from runs group by id, run),
    hashed as (select *, id || ':' || run as k from counted),
    thinned as (
        select n, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
        from (select run, n, {_crc32("k")} as h from hashed, crc_table)
    ),
    words as (
        select word, sum(n)::bigint as n from thinned where length(word) >= 5 group by word having sum(n) >= 3
    ),
    less as (
        select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)
    ),
    pairs as (
        select a.word as word, b.word as near, b.n as m from less as a join less as b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select a.word, b.word, b.n from less as a join words as b on a.rest = b.word
        union select b.word, a.word, a.n from less as a join words as b on a.rest = b.word
    ),
    best as (select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from pairs group by word),
    found as (
        select w.word, case when m >= 2 * n then near end as form, n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then m end as form_n
        from words as w left join best as b using (word)
    ),
    way(word, top, steps) as (
        select word, word, 0 from words union all select y.word, f.form, steps + 1 from way as y join found as f on f.word = y.top where f.form is not null
    )
    select f.word, form, (select arg_max(top, steps) from way as y where y.word = f.word) as root, n, n_near, form_n from found as f
"""

#: strings of 200 bytes, in hexadecimal digits, that start twice: each byte in one goes
BYTES = """
    with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
    blocks as (
        select doc_id, 500 * block as first, least(500, length(x) // 2 - 199 - 500 * block) as n, substr(x, 1000 * block + 1, 1398) as y
        from (select doc_id, x, unnest(range((length(x) // 2 + 300) // 500)) as block from docs where length(x) >= 400)
    ),
    starts as (
        select doc_id, first + nth as pos, md5(substr(y, 2 * nth + 1, 400)) as k from (select *, unnest(range(n)) as nth from blocks)
    ),
    hot as (select k from starts group by k having count(*) > 1),
    repeated as (select doc_id, pos from starts where k in (from hot)),
    fresh as (
        select doc_id, pos, case when pos - lag(pos) over (partition by doc_id order by pos) <= 200 then 0 else 1 end as opens from repeated
    ),
    numbered as (select doc_id, pos, sum(opens) over (partition by doc_id order by pos) as span from fresh),
    spans as (select doc_id, span, min(pos) as a, max(pos) + 200 as b from numbered group by doc_id, span),
    bounds as (select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a)::bigint as n, count(*) as m from spans group by doc_id),
    kept as (
        select doc_id, x, n, m, case when m is null then x else array_to_string(list_transform(range(m + 1), lambda i:
            substr(x, (2 * (case when i = 0 then 0 else b[i] end) + 1)::bigint,
                (2 * ((case when i = m then length(x) // 2 else a[i + 1] end) - (case when i = 0 then 0 else b[i] end)))::bigint)), '') end as left_over
        from docs left join bounds using (doc_id)
    )
    select doc_id, length(x) // 2 as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(m, 0)::bigint as n_spans, sha256(unhex(left_over)) as kept_sha256
    from kept
"""

#: nodes by their paths (role, text); a text's length keeps the two apart
TRIE = f"""
    with {CRC_TABLE},
    turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
    ),
    own as (
        select conv_id, list(length(role) || ':' || role || text order by turn nulls first, sha256(length(role) || ':' || role || text)) as ids from turns group by conv_id
    ),
    words as (
        select length(role) || ':' || role || text as id, any_value(len(regexp_extract_all(text, '{WORD}'))) as w from turns group by 1
    ),
    borrowing as (select conv_id, ids, {_crc32("conv_id::varchar")} % 4 as h from own, crc_table),
    paths as (
        select b.conv_id, list_concat(coalesce(s.ids, [])[1:b.h], b.ids[b.h + 1:]) as path
        from borrowing as b left join own as s on s.conv_id = b.conv_id - b.conv_id % 20
    ),
    steps as (select conv_id, path, unnest(range(len(path) + 1)) as d from paths),
    nodes as (select path[1:d] as node, d, min(conv_id) as conv_id, count(*) as n_convs from steps group by all),
    kids as (select node[1:d - 1] as node, count(*) as n_children from nodes where d > 0 group by 1),
    known as (
        select n.*, coalesce(k.n_children, 0) as n_children, coalesce((n.n_convs - 1) * w.w, 0) as own_saved
        from nodes as n left join kids as k using (node) left join words as w on w.id = n.node[n.d]
    ),
    above as (select node, n_children, own_saved, unnest(range(d + 1)) as u from known),
    sums as (select node[1:u] as node, sum((n_children = 0)::int) as n_leaves, sum(own_saved) as saved_tokens from above group by 1),
    ends as (select path as node, string_agg(conv_id::varchar, ',' order by conv_id) as ids from paths group by path)
    select k.conv_id, k.d as depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens,
        sha256(coalesce(e.ids, '')) as ends_sha256
    from known as k join sums using (node) left join known as p on k.d > 0 and p.node = k.node[1:k.d - 1] left join ends as e on e.node = k.node
"""

ORACLES: dict[str, str] = {
    "op6_chosen_path": NEAR,
    "op8_debruijn_spans": SPANS,
    "op9_exact_dedup": EXACT,
    "op10_line_rules": RULES,
    "op11_burst_trie": TRIE,
    "op12_pivotal_grams": VARIANTS,
    "op13_suffix_buckets": BYTES,
}
