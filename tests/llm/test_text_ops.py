"""Encoding, cleaning and exact deduplication against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from querywarden.llm import bpe, line_rules, stream_dedup
from querywarden.llm.words import give_back

SPEC = bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, ids string, _text string, kept string"
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "I'll we've 's 'll ''ll l'l", "<|endoftext|>", "x<|endoftext|>y <|endo", "é" * 40, "  a   b \t\n c",
    "日本語のテキスト" * 9, "🙂🙂 🙃" * 7, "a" * 500, " " * 300 + "b" + " " * 70, "thequickbrownfox" * 60, "!?" * 200, "1234567890" * 30,
    "x" * 90 + "'" + "ll" * 40, "   x" * 20, "Ünïcode wörds ñandú " * 20, "tab\tsep\x0b\x0c\r\nend" * 12,
]


def odd_rows():
    rows = [(i, t, "en", "z", "y", "k") for i, t in enumerate(ODD_TEXTS)]
    return rows + [(None, "no id", None, None, None, None), (3, "\n\n", "en", "z", "y", "k")] + rows[4:6]


@pytest.mark.parametrize("leaf", [7, 33, 64, 100_000])
def test_bpe_equals_the_library_for_any_leaf(spark, leaf):
    rng = random.Random(leaf)
    letters = ["a", "b", "the", " ", "  ", "'", "'s", "'ll", "l", "é", "日", "🙂", "\n", "<|endoftext|>", "<|", "9", "!", " ", "zzzz"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(60)] + ["".join(rng.choices("abcdeth", k=900)) for _ in range(12)]
    docs = spark.createDataFrame(odd_rows() + [(100 + i, t, "", "", "", "") for i, t in enumerate(texts)], SCHEMA)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, SPEC, keep_text=True, leaf=leaf), SPEC)
    assert set(out.columns) == {*docs.columns, "decoded"}
    t = Tokenizer.from_str(SPEC)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        got = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert got == want, (leaf, r.text)
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_long_run_of_letters_is_joined_by_windows(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("etaoinshrdlu", k=17 * 4096))
    coder = bpe.Coder(SPEC)
    calls = []
    plain = coder.marked
    coder.marked = lambda texts: calls.extend(map(len, texts)) or plain(texts)
    leaves = plain([text[i : i + 4096] for i in range(0, len(text), 4096)])
    whole = coder.tree(leaves)
    assert [int(x) for x in whole & ~bpe.FIRST] == Tokenizer.from_str(SPEC).encode(text, add_special_tokens=False).ids
    assert max(calls) < 1000


def test_other_operators_drop_the_coder_of_a_worker():
    first = bpe._coder(SPEC)
    assert bpe._coder(SPEC) is first
    give_back()
    assert not bpe._coder.cache_info().currsize and not bpe._load.cache_info().currsize
    assert bpe._coder(SPEC).plain(["a b"]) == first.plain(["a b"])


def test_bpe_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.bpe_decode(bpe.bpe_encode(docs, SPEC), SPEC).count() == 0


WS = "\t\n\x0b\x0c\r "


def plain_words(text):
    return [w for w in (text or "").translate({ord(c): " " for c in WS}).split(" ") if w]


def plain_measures(text):
    text = text or ""
    words = plain_words(text)
    lines = [x for x in text.split("\n") if x.strip(WS)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeat = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), failed


def test_measures_of_documents_and_odd_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text")
    for r in line_rules.line_rules(docs.union(odd)).collect():
        own = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert own == plain_measures(r.text), r.text
        assert not (r.base_failed and r.kept)


def test_lines_are_removed_and_columns_kept(spark):
    good = "one two three four five six seven eight nine ten and so on it goes here."
    other = "Quite another line with words of its own and a full stop at its end."
    text = "\n".join([good, "home | news | shop | about", other, "All rights reserved.", "buy!! now!! cheap!!"])
    docs = spark.createDataFrame([(1, text, 7), (2, "a | b | c | d | e | f " * 6, 8), (3, None, 9)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    assert got[1].clean_text == good + "\n" + other and got[1].kept and got[1].n_bad_lines == 3
    assert not got[2].kept and not got[3].kept
    assert line_rules.line_rules(docs.limit(0)).count() == 0


def test_exact_dedup_against_plain_groups(spark):
    texts = ["Ab", "ab", "aB", "É", "é", "", None, "x", "x", "Ab c"]
    rows = [(i * 3 % 10, t) for i, t in enumerate(texts)] + [(None, "solo"), (50, "AB"), (50, "ab"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = stream_dedup.scratch_dir(spark, "test")
    docs.repartition(5).write.parquet(path)
    got = stream_dedup.exact_dedup(spark.read.parquet(path), files_per_batch=2).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sha = lambda t: hashlib.sha256(norm(t).encode()).hexdigest()
    keep = {}
    for i, t in rows:
        keep[sha(t)] = max(keep.get(sha(t), -1), -1 if i is None else i)
    size = Counter(sha(t) for _, t in rows)
    assert len(got) == len(rows)
    assert Counter(r.text_sha256 for r in got) == size
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(size.keys())
    for r in got:
        assert (-1 if r.keep_id is None else r.keep_id) == keep[r.text_sha256] and r.group_size == size[r.text_sha256]


def test_equal_digests_of_different_bytes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(1, "aa"), (2, "aa"), (3, "ab"), (4, "c"), (5, "ac")]
    path = stream_dedup.scratch_dir(spark, "test")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)

    def weak(docs, text="text", key="doc_id"):
        first = F.substring(stream_dedup.normal_text(text), 1, 1).cast("binary")
        return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), first.alias("digest"))

    monkeypatch.setattr(stream_dedup, "digests", weak)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_dedup(spark.read.parquet(path)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), 5: (5, 1, True)}


def test_exact_dedup_of_nothing(spark):
    path = stream_dedup.scratch_dir(spark, "test")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert stream_dedup.exact_dedup(spark.read.parquet(path)).count() == 0


def test_row_numbers_of_long_texts_are_used_in_one_scan(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "lang", "text")
    plan = bpe.bpe_encode(docs, SPEC, keep_text=True, leaf=33)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("monotonically_increasing_id()") == 1 and "Join" not in plan


def test_a_phrase_in_a_long_line_is_no_boilerplate(spark):
    clean = " ".join(f"word{i}" for i in range(3000))
    texts = [f"{clean} read more {clean.replace("word", "other")}", "Read more", "\n".join(["read more about it"] * 3 + [clean])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bad_lines, r.kept) for r in line_rules.line_rules(docs).collect()}
    assert got == {0: (0, True), 1: (1, False), 2: (3, True)}
