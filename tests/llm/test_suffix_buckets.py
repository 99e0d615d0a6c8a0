"""Removal of repeated byte strings against a plain count."""

import random
from collections import Counter

import numpy as np
import pytest

from querywarden.llm import suffix_buckets as sb


def plain(texts, width):
    docs = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + width] for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if times[d[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = [len(s) for s in bytes(gone).split(b"\x00") if s]
        out.append((len(d), sum(gone), len(spans), bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def texts_of(rng, width, letters, n=60):
    passages = ["".join(rng.choices(letters, k=rng.randint(width - 2, 3 * width))) for _ in range(6)]
    out = [None, "", "a", "a" * (width - 1), "a" * 3 * width, "é" * width, "ab" * width, "ab" * width]
    for _ in range(n):
        out.append("".join(p for _ in range(rng.randint(0, 3)) for p in (rng.choice(passages), "".join(rng.choices(letters, k=rng.randint(0, width))))))
    # parts of passages, so that runs of one bucket differ in extent
    out += [p[a : a + rng.randint(width, 2 * width)] for p in passages for a in range(0, len(p), max(1, width // 3))]
    return out


@pytest.mark.parametrize(("width", "gram", "letters"), [(200, 32, "abcdeé ñ"), (200, 32, "ab"), (20, 8, "abc"), (7, 2, "ab"), (5, 5, "abcd"), (30, 30, "xyz")])
def test_against_plain_strings(spark, monkeypatch, width, gram, letters):
    rng = random.Random(width * len(letters))
    texts = texts_of(rng, width, letters)
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, kept binary")
    got = sb.repeated_bytes(docs.repartition(5), width=width, gram=gram, range_bytes=2000).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(plain(texts, width))
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and len(r.spans) == r.n_spans


def test_slices_of_a_long_text(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(sb, "SLICE", 700)
    width, text = 50, bytes(rng.choices(b"ab", k=400)) * 3 + bytes(rng.choices(b"abcdef", k=9000))
    whole = sb.Chunk([text, b"short", text[:130]], width, 16)
    flags = sb.sort_buckets(whole.grams, whole.load)
    keys, times = np.unique(whole.strings(whole.sent(flags))[1], return_counts=True)
    row = {"doc_id": [1, 2, 3]}
    got = sb._removed(row, whole, flags, sb.sort_strings(keys, (times > 1).astype(np.uint8))).to_pylist()
    want = plain([text.decode(), "short", text[:130].decode()], width)
    assert [(g["n_bytes"], g["n_removed"], g["n_spans"], g["kept"]) for g in got] == want


def test_removal_makes_the_strings_identifiers_once(monkeypatch):
    passage = random.Random(3).choices("abcdefgh", k=600)
    texts = ["".join(passage[a : a + 300 + a]).encode() for a in (0, 50, 120)]
    c = sb.Chunk(texts, 200, 32)
    flags = sb.sort_buckets(c.grams, c.load)
    assert (flags == sb.SPLIT).any()
    keys, times = np.unique(c.strings(c.sent(flags))[1], return_counts=True)
    calls, strings = [], sb.Chunk.strings
    monkeypatch.setattr(sb.Chunk, "strings", lambda self, picked: calls.append(1) or strings(self, picked))
    got = sb._removed({"doc_id": [1, 2, 3]}, c, flags, sb.sort_strings(keys, (times > 1).astype(np.uint8))).to_pylist()
    assert [(g["n_bytes"], g["n_removed"], g["n_spans"], g["kept"]) for g in got] == plain([t.decode() for t in texts], 200)
    assert len(calls) == 1


def test_identifiers_depend_on_content_only():
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choices(b"ab", k=3000)), np.uint8)
    for depth in (1, 2, 7, 12):
        ids = sb.deeper(sb.LETTER[data], 1, depth)
        strings = [data[i : i + depth].tobytes() for i in range(len(data) - depth + 1)]
        assert len(ids) == len(strings) and len(set(zip(ids.tolist(), strings, strict=True))) == len(set(strings)) == len(set(ids.tolist()))


def test_copies_are_settled_by_one_run_each():
    text = bytes(random.Random(2).choices(b"abcdefgh", k=20_000))
    c = [sb.Chunk([text], 200, 32) for _ in range(5)]
    flags = sb.sort_buckets(np.concatenate([x.grams for x in c]), np.concatenate([x.load for x in c]))
    assert set(flags.tolist()) == {sb.WHOLE}


def test_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {r.doc_id: p for r, p in zip(rows, plain([r.text for r in rows], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sb.repeated_bytes(docs).collect()}
    assert got == want and any(p[1] for p in want.values())
    assert sb.repeated_bytes(docs.limit(0)).count() == 0
