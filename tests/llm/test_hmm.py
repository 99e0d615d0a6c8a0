"""Language-model scores: counts and base scores against plain ones, likelihoods against enumeration."""

import zlib
from collections import Counter
from itertools import product
from math import isclose, log10

import numpy as np

from querywarden.llm import hmm


def plain(rows):
    tok = lambda t: (t or "").encode().translate(hmm.LOWER).split() + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tok(t)
        base = sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)))
    return sorted(out, key=str)


def scores(docs, **more):
    return hmm.lm_scores(docs, **more).collect()


def test_counts_and_base_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "The of"), (900, None), (901, ""), (902, "ÉCOLE École the\x0bTHE"), (902, "same"), (902, "same")], "doc_id long, text string")
    docs = docs.union(odd)
    got = scores(docs, rounds=3)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == plain(
        [(r.doc_id, r.text) for r in docs.collect()]
    )
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_forward_recursion_is_the_sum_over_state_paths():
    rng = np.random.default_rng(2)
    m = hmm.first_model(rng.random(hmm.CLASSES))
    texts = [rng.integers(0, hmm.CLASSES, n) for n in (1, 3, 2)]
    got = hmm.likelihoods(np.concatenate(texts).astype(np.uint16), np.array([1, 3, 2]), m)
    for x, value in zip(texts, got, strict=True):
        p = sum(
            m.start[s[0]] * np.prod([m.emit[c, k] for c, k in zip(x, s, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(s, s[1:], strict=False)])
            for s in product(range(hmm.STATES), repeat=len(x))
        )
        assert isclose(value, log10(p), rel_tol=1e-9)


def test_windows_of_texts_give_the_likelihood_of_short_texts():
    rng = np.random.default_rng(3)
    m = hmm.first_model(rng.random(hmm.CLASSES))
    size = np.array([5, 200, 31, 1])
    codes = rng.integers(0, hmm.CLASSES, size.sum()).astype(np.uint16)
    starts, moves, emitted, log = hmm.expected(codes, np.cumsum(size) - size, size, m)
    assert isclose(log / np.log(10), hmm.likelihoods(codes, size, m).sum(), rel_tol=1e-4)
    assert isclose(starts.sum(), 4, rel_tol=1e-4) and isclose(moves.sum(), (size - 1).sum(), rel_tol=1e-3) and isclose(emitted.sum(), size.sum(), rel_tol=1e-4)
    assert np.allclose(emitted.sum(1), np.bincount(codes, minlength=hmm.CLASSES), rtol=1e-3)


def test_rounds_raise_the_likelihood_and_probabilities_add_up(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = sum(r.score for r in scores(docs, rounds=1) if not r.held_out)
    more = sum(r.score for r in scores(docs, rounds=5) if not r.held_out)
    assert more > few


def test_nothing_to_score_or_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scores(none) == []
    alone = scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"))
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0} and all(np.isfinite(r.score) for r in alone)


def test_counts_above_32_bits():
    import numpy as np
    import pyarrow as pa

    keys = np.array([3, 9], np.uint64).tobytes()
    load = np.array([(3_000_000_000, 1), (5, 2)], hmm.COUNT).tobytes()
    group = pa.table({"chunk": pa.array([0, 1], pa.int64()), "part": pa.array([0, 0], pa.int32()), "n": pa.array([2, 2], pa.int32()), "keys": pa.array([keys + load] * 2, pa.binary())})
    found = hmm._gather(group).to_pylist()
    assert [np.frombuffer(r["flags"], "<u8").tolist() for r in found] == [[6_000_000_000, 10]] * 2
