"""The near-duplicate join against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from querywarden.llm import chosen_path
from querywarden.llm.components import components
from querywarden.llm.packs import stored


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain(rows):
    """class id and number of links of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    holders = {}
    for i, s in enumerate(sets):
        near = Counter(j for t in s for j in holders.get(t, ()))
        for j, n in near.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for t in s:
            holders.setdefault(t, []).append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return [(k, least[root(i)], links[i]) for i, (k, _) in enumerate(rows)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("block, tokens", [(7, 1 << 19), (512, 400)])
def test_against_all_pairs(spark, monkeypatch, block, tokens):
    rng = random.Random(3)
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "TOKENS", tokens)
    monkeypatch.setattr(chosen_path, "PAIRS", 500)
    common = [f"c{i}" for i in range(40)]
    texts = [None, "", " ", "a b", "a  b", "b a", "one", "one", "p q r s t", "p q r s t u"]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 30 if g < 2 else 4)):
            texts += [edited(rng, base, rng.randint(0, 3))] * rng.randint(1, 2)
    for g in range(40):
        own = [f"o{rng.randrange(5000)}" for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(own[:10] + common + own[10:]))
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = chosen_path.jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(plain(rows))
    stays = [r for r in got if r.stays]
    assert len({r.class_id for r in got if r.class_id is not None}) <= len(stays) < len(got)


def test_links_between_bands_of_sizes(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in range(5, 400, 2)]
    places = {}
    for r in chosen_path.placed(spark.createDataFrame([(n, 1, 1, n - 4) for n, _ in rows], "row long, cluster long, copies long, size long")).collect():
        places.setdefault(r.band, set()).add((r.blocks, r.above, r.below))
    assert all(len(v) == 1 for v in places.values()) and len(places) > 10
    blocks = {band: next(iter(v))[0] for band, v in places.items()}
    assert all(v == {(blocks[band], blocks.get(band + 1, 0), blocks.get(band - 1, 0))} for band, v in places.items())
    got = chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(plain(rows))


@pytest.mark.parametrize("blocks", [20, 200])
def test_a_chunk_sends_each_set_once_in_slices(monkeypatch, blocks):
    monkeypatch.setattr(chosen_path, "SLICE", 1 << 12)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)).encode() for i in range(100)]
    raw = b"".join(texts)
    places = [dict(zip(chosen_path.PLACE, (7 << 20 | i, 1, 3, i % blocks, blocks, 0, 0, 1), strict=True)) for i in range(0, 100, 2)]
    row = {"size": [len(t) for t in texts], "raw": len(raw), "blob": pa.compress(raw, "zstd", asbytes=True), "places": places}
    out = list(chosen_path._sets(iter([pa.RecordBatch.from_pylist([row, row])])))
    assert sum(b.num_rows for b in out) == 2 * 50
    assert all(b.column("tokens").nbytes <= (1 << 12) + 8 * b.num_rows + 8 for b in out)
    assert [r for b in out[: len(out) // 2] for r in b.column("row").to_pylist()] == [p["row"] for p in places]


def test_sketches_lose_no_pair_at_the_threshold():
    rng, low = random.Random(11), 0
    for size in (9, 45, 450):
        for _ in range(200):
            both = [f"s{rng.random()}" for _ in range(size)]
            left, right = both[: size - size // 9], both[size // 9 :]
            hashes = [chosen_path.mix(np.array([hash(x) & (2**64 - 1) for x in side], np.uint64)) for side in (left, right)]
            s = chosen_path.Sets([])
            s.token, s.doc, s.size = np.concatenate(hashes), np.repeat([0, 1], [len(left), len(right)]), np.array([len(left), len(right)])
            one, two = (np.frombuffer(x, np.uint8)[None, :] for x in s.sketches())
            low += chosen_path.alike(one, two)[0] < chosen_path.LIKELY
    assert not low


def test_links_through_a_later_row(spark):
    base = [f"w{i}" for i in range(104)]
    swap = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(1, swap(20, 40)), (2, swap(60, 80)), (3, " ".join(base))]
    got = chosen_path.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == plain(rows) == [(1, 1, 1), (2, 1, 1), (3, 1, 2)]
    assert [r.stays for r in got].count(True) == 1


@pytest.mark.parametrize("block", [512, 16])
def test_buckets_large_to_the_last_round(spark, monkeypatch, block):
    rng = random.Random(5)
    monkeypatch.setattr(chosen_path, "ROUNDS", 0)
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    own = [rng.randbytes(chosen_path.BINS) for _ in range(100)]
    rows = [(i, bytearray(own[i - 1 if i in (41, 98) else i]), [7]) for i in range(100)]
    described = spark.createDataFrame(rows, "row long, sketch binary, keys array<long>")
    got = components(chosen_path.candidates(described, None)).collect()
    near = {(40, 41), (97, 98)}
    roots = {r.node: r.root for r in got}
    assert all(roots.get(a, a) == roots.get(b, b + 1000) for a, b in near)
    assert set(roots) == {40, 41, 97, 98}


@pytest.mark.parametrize("keys", [[7], []])
def test_candidates_need_no_second_kind_of_workers(spark, keys):
    rows = [(i, bytearray(b"a" * chosen_path.BINS), keys) for i in range(3)]
    described = stored(spark.createDataFrame(rows, "row long, sketch binary, keys array<long>"), "test")
    found = chosen_path.candidates(described, None)
    assert "RDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.root for r in components(found).collect()} == ({0: 0, 1: 0, 2: 0} if keys else {})


def test_sets_like_the_first_one_go_no_further(spark, monkeypatch):
    n, one, other = 100, bytes(range(1, 129)), bytes(range(128, 0, -1))
    keys = {r: [1, 2] if r < n else [3] for r in range(3 * n)}  # the last bucket: a third like its first set, two thirds not
    sketch = {r: one if r < n - 1 or r % 3 == 1 else other for r in range(3 * n)}
    rows = [(r, sketch[r], keys[r]) for r in range(3 * n)]
    described = spark.createDataFrame(rows, "row long, sketch binary, keys array<long>")
    counts, real = {}, chosen_path.stored

    def spy(df, label):
        out = real(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(chosen_path, "stored", spy)
    monkeypatch.setattr(chosen_path, "ROUNDS", 0)
    root = {r.node: r.root for r in components(chosen_path.candidates(described, None)).collect()}
    assert all(root[r] == 0 for r in range(n)) and all(root[r] == (100 if r % 3 == 1 else 101) for r in range(n, 3 * n))
    first_unlike = sum(sketch[r] == other for r in range(n, 3 * n))
    assert counts["buckets"] == 4 * n and max(v for k, v in counts.items() if k not in ("buckets", "near")) == 2 + first_unlike


def test_runs_reach_the_target_through_all_rounds():
    alive = chosen_path.survival(0.8, chosen_path.DEPTH * (chosen_path.ROUNDS + 1))
    assert 1 - (1 - alive) ** chosen_path.runs_for(chosen_path.RECALL) >= chosen_path.RECALL


def test_documents_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = chosen_path.jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(plain(rows))
    assert Counter(r.class_id for r in got if r.stays) == Counter({r.class_id for r in got})
    assert chosen_path.jaccard_join(docs.limit(0)).count() == 0


def test_runs_reach_the_target():
    assert chosen_path.runs_for(0.9995) > chosen_path.runs_for(0.99) > 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 140), 200], 100)}
