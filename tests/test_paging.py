"""Deep pages, and sketches that are merged."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from querywarden.operators import metadata as md
from querywarden.operators import paging as pg


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    out = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), "x" * 50) for i in range(997)]
    return spark.createDataFrame(out, "id long, k string, v int, wide string").repartition(7), out


def ranked(out):
    low = lambda x: (x is not None, x or 0)
    by_v = sorted(sorted(out, key=lambda r: r[0]), key=lambda r: low(r[2]))
    return [r[0] for r in sorted(by_v, key=lambda r: (r[1] is not None, r[1] or ""), reverse=True)]


def test_pages_by_number(spark, data):
    df, out = data
    order, want = ["-k", "v", "id"], ranked(sorted(out))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for page in (1, 2, 17, 40, 42, 1000):
            got = [r.id for r in pg.deep_page(df, order, page, 24).collect()]
            assert got == want[(page - 1) * 24 : page * 24]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pg.deep_page(df.limit(0), order, 3, 5).count() == 0


def test_only_ranges_of_the_page_are_sorted():
    counts = [(0, 100), (2, 50), (1, 30), (3, 0), (4, 70)]
    assert pg.ranges_of_page(counts, 0, 10) == ([0], 0)
    assert pg.ranges_of_page(counts, 95, 50) == ([0, 1, 2], 95)
    assert pg.ranges_of_page(counts, 180, 10) == ([4], 0)
    assert pg.ranges_of_page(counts, 250, 10) == ([], 0)


def test_pages_after_a_key(data):
    df, out = data
    order, seen, last = ["-k", "v", "id"], [], None
    while True:
        page = pg.seek_page(df, order, 250, last).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = page[-1].asDict()
    assert seen == ranked(sorted(out))


def test_merged_sketches(spark, data):
    df, out = data
    halves = [md.prefix_sketches(df.filter(F.col("id") % 2 == n), ["k", "v", "id"], F.lit(n)) for n in (0, 1)]
    again = md.prefix_sketches(df.filter("id % 2 = 0 and id < 100"), ["k", "v", "id"], F.lit(0))
    got = rows(md.merged_cardinality(halves[0].unionByName(halves[1]).unionByName(again)), "seq", "n_rows", "cardinality")
    assert [g[:2] for g in got] == [(1, 997), (2, 997), (3, 997)]
    assert got[0][2] == 4 and got[1][2] == 16 and abs(got[2][2] - 997) < 30
