"""Personal data: base spans against plain patterns, and what the method adds."""

import re

from querywarden.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in x) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


ODD = [
    None, "", "a@b.c@d.e", "a@b.c_x@d.e.f", "@x.y", "x@y", "é.a+b%c@d-e.f.g.", "..@-.-", "x" * 3000 + "@" + "y." * 900 + "z", "🙂 1.2.3.4 🙂 a@b.cc",
    "1.2.3.4.5.6.7.8", "300.1.1.1", "01.002.0003.255", "1.2.3", "9" * 4000 + ".1.1.1", "1.2.3.4.", "256.1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111111 5", "5 4111111111111111", "5  4111111111111111", "4111111111111112",
    "6011000990139424 4111111111111111", "1-4111111111111111", "0" * 13, "0" * 19, "0" * 20, "0 " * 15, "1 " * 20_000,
    "+1 (459) 555-9246", "+12345678", "+123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "+1234567890123456", "+1 (800) 555-0000+1 (800) 555-0001", "+(1) 234", "+1" + " " * 900 + "23456789.",
    "call (415) 555-2671 now", "jane (at) mail dot com, joe [at] site [dot] org", 'token = "908038b7daaf91e730d2f64001c52934d9336" of', "version 1.2.3.4 of",
]


def spans(rows):
    return [[(s.kind, s.start, s.end) for s in r.spans if s.base] for r in rows]


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, spans string, kind int").coalesce(1)
    got = pii.personal_data(docs).select("doc_id", "spans")
    rows = sorted(map(str, spans(got.collect())))
    assert rows == sorted(str(plain(t)) for t in ODD)
    added = [s for r in got.collect() for s in r.spans if not s.base]
    assert {s.kind for s in added} <= set(pii.KINDS[4:]) and any(s.kind == "secret" for s in added)


def test_base_spans_of_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert {r.doc_id: s for r, s in zip(rows, spans(rows), strict=True)} == want and any(want.values())
    for r in rows:
        assert [(pii.KINDS.index(s.kind), s.start) for s in r.spans] == sorted((pii.KINDS.index(s.kind), s.start) for s in r.spans)


def test_empty_and_clean_tables(spark):
    schema = "doc_id long, text string"
    assert pii.personal_data(spark.createDataFrame([], schema)).count() == 0
    clean = pii.personal_data(spark.createDataFrame([(1, "nothing here"), (1, "nothing here")], schema)).collect()
    assert [r.spans for r in clean] == [[], []]


def test_reliable_labelers_outweigh_others():
    counts = [(0, (1, 1, 0, 0, 1), 900), (0, (1, 1, 0, 1, 1), 300), (0, (-1, -1, 0, 0, 1), 500), (0, (-1, -1, 0, 0, -1), 300), (0, (1, 1, 0, 0, -1), 5)]
    p = pii.reliabilities(counts)
    assert p[0, (1, 1, 0, 0, 1)] > 0.9 > 0.1 > p[0, (-1, -1, 0, 0, 1)] and p[0, (1, 1, 0, 0, -1)] > 0.5


def test_no_python_on_the_executors(spark, sf_dir):
    plan = pii.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_spans_of_any_length(spark):
    secret, name, host = "aZ9/" * 250, "n" * 300, "h" * 200
    texts = [f"api_key = {secret} end", f"write {name} (at) {host}.a.b.c.d.e.example [dot] com now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert spans[0] == [f"api_key = {secret}"]
    assert spans[1] == [f"{name} (at) {host}.a.b.c.d.e.example [dot] com"]
