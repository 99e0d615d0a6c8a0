"""The prefix trie of conversations against a plain one."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from querywarden.llm import burst_trie


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[tuple(p)].append(c)
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len([w for w in p[-1][1].translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return Counter(tuple(r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, a string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def some(rng, convs, most, kinds):
    rows = []
    for c in rng.sample(range(0, 6 * convs), convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(kinds)))
    return rows


@pytest.mark.parametrize(("segment", "capacity"), [(64, 4096), (4, 3), (2, 1), (3, 2)])
def test_against_a_plain_trie(spark, segment, capacity):
    rng = random.Random(segment)
    rows = some(rng, 60, 9, ["a b", "a  b\tc", "", None, "é x y"])
    rows += [(c, t, "user", f"hello {t}") for c in (800, 801, 802, 803, 804, 819, 1000, 1001) for t in range(13)]  # equal and long
    rows += [(c, t, "user", f"hello {t}") for c in (900, 901) for t in range(rng.randint(14, 17))]
    rows += rows[:7]  # repeated rows
    rows += [(None, 0, "user", "lost"), (-40, 0, "user", "below"), (-20, 0, "user", "below"), (-33, 1, "user", "zero"), (-33, 1, "user", "zero"), (7001, 0, "user", "alone")]
    assert got(burst_trie.prefix_trie(table(spark, rows), segment, capacity)) == plain(rows)


def test_empty_table(spark):
    assert burst_trie.prefix_trie(table(spark, [])).count() == 0
    assert burst_trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_turns_of_one_conversation_are_spread(spark):
    rng = random.Random(1)
    rows = [(5, rng.randint(0, 50) if i % 3 else None, "user", f"t{i % 40}") for i in range(4000)] + [(6, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = burst_trie.own_turns(table(spark, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = [r.pos for r in turns.filter("conv_id = 5").collect()]
    assert sorted(at) == list(range(4000))
    assert turns.filter("conv_id = 5").select("part").distinct().count() > 1


def test_conversations_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(burst_trie.prefix_trie(df, capacity=20)) == plain(rows)
