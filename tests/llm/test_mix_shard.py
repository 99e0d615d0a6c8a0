"""Mixes against plain targets, shards against their law."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from querywarden.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, value int, shard string"


def plain_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        share = {s: (total - sum(fixed.values())) * weight[s] / w for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: float(cap * sizes[s]) for s in over})


def odd_docs(spark):
    rows = [(i, "w " * (i % 50 + 1), ["b", "a", None, "é", "tiny", "z"][min(i % 11, 5)], "x", 1, "y") for i in range(600)]
    rows = [r if r[2] != "tiny" or r[0] < 20 else (*r[:2], "a", *r[3:]) for r in rows]
    rows += [(None, None, "b", None, None, None), (7, "", "b", "x", 1, "y"), (8, "same row", "b", "x", 1, "y"), (8, "same row", "b", "x", 1, "y")]
    rows += [(9000 + i, "empty source".replace("empty source", " "), "void", "x", 1, "y") for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.mark.parametrize("words", [40, 1 << 18])
def test_targets_and_taken_words(spark, words):
    docs = odd_docs(spark)
    rows = mixing.mix_sources(docs, block_words=words, shard_words=1500).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    want = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    assert len(rows) == docs.count()
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60, (s, taken[s], t)


def test_blocks_are_shared_out_evenly_and_reruns_agree(spark):
    docs = odd_docs(spark)
    mix = mixing.Mix(docs, block_words=40, shard_words=1500)
    assert mix.shards > 5
    draws = [(r.source, r.block, d.epoch, d.shard) for r in mix.blocks.collect() for d in r.draws or []]
    count = defaultdict(int)
    for *_, shard in draws:
        count[shard] += 1
    assert sorted(count) == list(range(mix.shards)) and max(count.values()) - min(count.values()) <= mix.shards.bit_length()
    one = mix.mixed(docs)
    assert one.columns == docs.columns
    odd = docs.withColumns({"block": F.lit(7), "order": F.col("doc_id"), "cut": F.lit("c"), "target": F.lit(1), "draws": F.lit("d")})
    kept = mixing.Mix(odd, block_words=40, shard_words=1500).mixed(odd)
    assert kept.columns == odd.columns and {(r.size, r.block, r.cut, r.target, r.draws) for r in kept.collect()} <= {("x", 7, "c", 1, "d"), (None, 7, "c", 1, "d")}
    two = mixing.Mix(docs.repartition(5), block_words=40, shard_words=1500).mixed(docs.repartition(5))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.count() == sum(len(r.draws) for r in mixing.mix_sources(docs, block_words=40, shard_words=1500).collect())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(odd_docs(spark).limit(0)).count() == 0


def test_no_python_in_the_mix(spark, sf_dir):
    plan = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def check_shards(docs, got, shards, slack):
    assert len(got) == docs.count()
    slots, size, home = defaultdict(list), defaultdict(int), {}
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert max(size.values()) - mean <= slack and mean - min(size.get(i, 0) for i in range(shards)) <= slack


def test_shards_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_shards(docs, sharding.kd_shards(docs).collect(), 8, 19_000)
    want = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in sharding.kd_shards(docs, shards=5).collect()) == want


def test_shards_of_odd_tables(spark):
    docs = odd_docs(spark)
    check_shards(docs, sharding.kd_shards(docs, shards=3).collect(), 3, 2500)
    assert sharding.kd_shards(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(30)], "doc_id long, text string")
    assert {r.shard for r in sharding.kd_shards(same).collect()} and len({r.shard for r in sharding.kd_shards(same).collect()}) == 1
