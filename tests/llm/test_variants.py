"""Spelling variants against plain edit distances."""

import random
import zlib
from collections import Counter

import pytest

from querywarden.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if one_edit(w, x)]
        m, form = min(near, default=(0, None))
        out[w] = (form if -m >= 2 * n else None, n, len(near), -m if -m >= 2 * n else None)
    rows = set()
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, *rest))
    return rows


@pytest.mark.parametrize(("letters", "length"), [("ab", 5), ("abé", 6), ("aabcdefgß", 7)])
def test_pairs_of_words_like_each_other(spark, letters, length):
    rng = random.Random(length)
    words = {"".join(rng.choices(letters, k=rng.randint(5, length + 2))) for _ in range(250)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "abababab", "bababab"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(3)
    got = [tuple(r) for r in variants.near_pairs(df).collect()]
    want = {(min(a, b), max(a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_documents_with_odd_rows(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé", k=6)) for _ in range(12)]
    texts = [None, "", "12 !?", "x" * 5000, "Ünders ünders ÜNDERS"]
    for _ in range(150):
        words = [rng.choice(base) for _ in range(rng.randint(1, 30))]
        words = [w[:2] + rng.choice("xyz") + w[3:] if rng.random() < 0.2 else w for w in words]
        texts.append(rng.choice([" ", "-", "7"]).join(w.title() if rng.random() < 0.3 else w for w in words))
    rows = [(None if i % 9 == 0 else i // 2, t, "w", 1) for i, t in enumerate(texts + texts[5:15])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4)
    counts, runs = Counter(), 0
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = [tuple(r) for r in variants.spelling_variants(docs, drop=5).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


def test_roots_of_long_chains_and_empty_tables(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r.root for r in variants.roots(chain).collect()} == {"w37"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(none).count() == 0
    with pytest.raises(ValueError, match="too few"):
        variants.spelling_variants(none, min_length=4)


def test_no_join_broadcasts_what_a_file_of_words_hides(spark, monkeypatch):
    stored, plans = variants.stored, []

    def watched(df, label):
        plans.append(df)
        return stored(df, label)

    monkeypatch.setattr(variants, "stored", watched)
    docs = spark.createDataFrame([(1, "abcdefg abcdefg abcdefg abcdefg abcdefg abcdefg abcdefh abcdefh abcdefh")], "doc_id long, text string")
    out = variants.spelling_variants(docs, drop=10**9)
    assert {(r.word, r.root) for r in out.collect()} == {("abcdefg", "abcdefg"), ("abcdefh", "abcdefg")}
    joins = [line for df in [*plans, out] for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert len(joins) >= 5 and all("SortMergeJoin" in line for line in joins), joins
