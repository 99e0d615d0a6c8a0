"""The pipeline against plain versions of its stages."""

from collections import Counter, defaultdict

import pytest
from test_mix_shard import plain_targets
from test_near import plain as plain_links
from test_text_ops import SPEC, plain_measures
from tokenizers import Tokenizer

import corpus_pipeline
from querywarden.llm import chosen_path, line_rules, pii, stream_dedup
from querywarden.llm.packs import stored


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.collect()
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if stage is not corpus_pipeline.encode:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = stored(out, name)
        steps.append((docs if stage is not corpus_pipeline.encode else out).collect())
    clean, exact, near, mixed, tokens = steps

    def cleaned(text):
        good = [x for x in text.split("\n") if not x.strip(line_rules.SPACE) or not line_rules.failed_rule(x)]
        lost = plain_measures(text)[1] - plain_measures("\n".join(good))[1]
        return "\n".join(good), lost <= line_rules.MAX_LOST * plain_measures(text)[1]

    want = {r.doc_id: cleaned(r.text)[0] for r in raw if not plain_measures(r.text)[-1] and cleaned(r.text)[1]}
    assert {r.doc_id: r.text for r in clean} == want and all(r.n_chars == len(r.text) for r in clean)
    keep = {}
    for r in clean:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        keep[norm] = max(keep.get(norm, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(keep.values())
    classes = {i: c for i, c, _ in plain_links([(r.doc_id, r.text) for r in exact])}
    assert sorted(classes[r.doc_id] for r in near) == sorted(set(classes.values()))
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in mixed)
    size = {r.doc_id: len(r.text.encode().split()) for r in near}
    source = {r.doc_id: r.source for r in near}
    for i, n in size.items():
        sizes[source[i]] += n
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    for s, t in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(size.values())
    assert max(times.values()) <= 3
    t = Tokenizer.from_str(SPEC)
    text = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in tokens) == times and all(r.lossless for r in tokens)
    for r in tokens:
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in t.encode(text[r.doc_id], add_special_tokens=False).ids)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(tokens)


def test_pipeline_of_nothing_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(None, text, None, None, None), (None, text, None, None, None), (1, None, "en", "a", 0)], schema)
    for rows, left in ((docs, 1), (docs.limit(0), 0)):
        now = stored(rows, "test")
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, ""), name)
        assert now.count() == left


def test_pipeline_leaves_foreign_columns_alone(spark):
    extra = ["_querywarden_row", "_querywarden_row_", "kept", "n_words", "row", "chunk", "_doc", "digest"]
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30)) + ".", "a", *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = stored(spark.createDataFrame(rows, ["doc_id", "text", "source", *extra]), "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = stored(out, name)
    got = docs.collect()
    assert {r.doc_id // 2 for r in got} == {0, 1, 2}
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra)


@pytest.mark.parametrize("step", ["exact", "near", "spans"])
def test_files_cut_anew_between_scans(spark, monkeypatch, step):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30)) + f" a{i // 2}@b.com") for i in range(80)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id"), "test")
    module, name = {"exact": (stream_dedup, "exact_dedup"), "near": (chosen_path, "jaccard_join"), "spans": (pii, "find_spans")}[step]
    real = getattr(module, name)

    def then_cut(*args, **named):
        out = stored(real(*args, **named), "test")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        return out

    monkeypatch.setattr(module, name, then_cut)
    try:
        if step == "spans":
            got = pii.personal_data(docs).join(docs, "doc_id").collect()
            assert len(got) == 80 and all([r.text[s.start : s.end] for s in r.spans if s.base] == [r.text.split()[-1]] for r in got)
            return
        stage = stream_dedup.kept_documents(docs) if step == "exact" else corpus_pipeline.near_dedup(spark, docs, "")
        assert sorted(r.doc_id // 2 for r in stage.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_encoder_and_decoder_do_not_share_a_task(spark):
    texts = ["a b", None, "", "word " * 5000, "é中 \U0001f600"]
    docs = stored(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"), "test")
    out = corpus_pipeline.encode(spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan
    t = Tokenizer.from_str(SPEC)
    want = {i: b"".join(n.to_bytes(4, "little") for n in t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert {r.doc_id: bytes(r.ids) for r in out.collect()} == want
    assert all(r.lossless and r.n_tokens == len(r.ids) // 4 for r in out.collect())
