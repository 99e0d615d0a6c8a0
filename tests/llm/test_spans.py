"""Removal of repeated passages against a plain count of windows."""

import random
from collections import Counter

import pytest

from querywarden.llm import debruijn
from querywarden.llm.words import Words


def plain(texts, k):
    docs = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1))
    out = []
    for d in docs:
        gone = {i + j for i in range(len(d) - k + 1) if times[tuple(d[i : i + k])] > 1 for j in range(k)}
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "anchor", "vocabulary"), [(35, 12, 400), (35, 12, 2), (5, 2, 4), (3, 1, 3)])
def test_against_plain_windows(spark, window, anchor, vocabulary):
    rng = random.Random(window * vocabulary)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randint(window - 1, 3 * window)) for _ in range(6)]
    texts = [None, "", " \n", "one", "same words " * 30, "same words " * 30]
    for _ in range(60):
        parts = [p for _ in range(rng.randint(0, 3)) for p in (rng.choice(passages), rng.choices(words, k=rng.randint(0, window)))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, kept string, path string")
    got = debruijn.repeated_spans(docs.repartition(5), window=window, anchor=anchor).collect()
    assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == Counter(plain(texts, window))
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans)


def test_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.orderBy("doc_id").collect()
    want = {r.doc_id: p for r, p in zip(texts, plain([r.text for r in texts], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in debruijn.repeated_spans(docs).collect()}
    assert got == want and any(p[1] for p in want.values())
    assert debruijn.repeated_spans(docs.limit(0)).count() == 0


def test_false_paths_are_vetoed(spark, monkeypatch):
    a, b, c = ([f"{x}{i}" for i in range(50)] for x in "abc")
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(c))], "doc_id long, text string").coalesce(1)
    real = debruijn._unverified
    state = {}

    def once(found):
        if state.setdefault("calls", 0):
            return real(found)
        state["calls"] = 1
        return found.filter("path is not null").select("chunk", "path").distinct()

    monkeypatch.setattr(debruijn, "_unverified", once)
    assert {r.doc_id: r.n_removed for r in debruijn.repeated_spans(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_branches_between_words_alike_in_16_bits(spark):
    words = [f"v{i}" for i in range(3000)]
    by_bits = {}
    for w, h in zip(words, Words([" ".join(words).encode()]).hashes().tolist(), strict=True):
        by_bits.setdefault((h >> 40) % 65534, []).append(w)
    a, b = next(v for v in by_bits.values() if len(v) > 1)[:2]
    passage = " ".join(f"p{i}" for i in range(8))
    texts = [f"one {passage} {a} tail", f"two {passage} {a} end", f"three {passage} {b} rest", f"{a} {passage} x", f"{b} {passage} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for some in (texts[:3], texts):
        got = debruijn.repeated_spans(docs.filter(f"doc_id < {len(some)}"), window=5, anchor=2).collect()
        assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == Counter(plain(some, 5))
