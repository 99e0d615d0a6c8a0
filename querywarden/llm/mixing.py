"""Mixing sources to target weights by a splitting tree of exact block quotas.

Sources weigh ``WEIGHTS`` in turn, by code point, null last; together they get as many words as there are, none
more than ``CAP`` times its own, and what is over is shared out again by weight. A source's documents are dealt
into blocks of about ``BLOCK_WORDS`` words by hash. It contributes each of its blocks once per whole epoch, and
a last part of an epoch: blocks in permuted order, of the last one only the first documents in permuted order.

The resulting quota of blocks is divided among the output shards by a binary tree. At each node as many of its
blocks as the left half of its shards gets are drawn without replacement, by a random rank; so the numbers of
each source's blocks on the left follow the multivariate hypergeometric law, and the quotas stay exact. At the
leaves each shard has its own disjoint blocks, and rows are ordered at random within the shard.

Null texts and texts without words have size 0 and are taken as often as their source asks; taken words
are 0. The null source is a source. Repeated rows go together. An empty table gives an empty result. Choices depend
on a document's key and text and the seed only, so reruns agree. ``mixed`` returns the input's rows as they are,
whatever their columns are called; ``mix_sources`` returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.llm.packs import stored

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 23
SEED = 20_240_607
RANGES = 256


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources are few next to documents; the two running sums over them stand in one task. Sorted by cap per
    weight, the capped sources come first; the share of the first one that its cap does not bind holds for
    all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap_words = (F.col("source_size") * cap).cast("double")
    weighed = sizes.withColumn("weight", weight).withColumn("most", cap_words)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = weighed.withColumn("at", F.row_number().over(order)).withColumn("share", left / weight_left)
    free = F.when(F.col("most") >= F.col("share") * F.col("weight"), F.struct("at", "share"))
    share = F.min(free).over(whole)["share"]
    return shared.withColumn("share", share).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("share") * F.col("weight"), F.col("most"))).alias("target")
    )


def _with(a: DataFrame, b: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by source, null included, and further columns."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in ("source", *more)})
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in more:
        on &= F.col(c) == F.col(f"_{c}")
    return a.join(other, on, how).drop("_source", *[f"_{c}" for c in more])


def _split(draws: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: each node's blocks to its left or right half, exact numbers to each.

    Ranks are made of ranges of the random value: rows are numbered within a range, and only the sizes of the
    ranges are summed up for a node.
    """
    value = F.xxhash64(F.lit(seed), F.lit(level), "source", "block", "epoch")
    rows = draws.withColumn("value", value).withColumn("part", F.pmod(F.shiftright("value", 40), F.lit(RANGES)))
    sizes = rows.groupBy("low", "high", "part").agg(F.count(F.lit(1)).alias("n"))
    node = Window.partitionBy("low", "high")
    running = node.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("low", "high", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("offset"), F.sum("n").over(node).alias("all"))
    within = Window.partitionBy("low", "high", "part").orderBy("value", "source", "block", "epoch")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(offsets, ["low", "high", "part"])
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    quota = F.round(F.col("all") * (middle - F.col("low")) / (F.col("high") - F.col("low")))
    left = F.col("rank") + F.col("offset") <= quota
    one = F.col("high") - F.col("low") < 2
    return ranked.select(
        "source", "block", "epoch",
        F.when(one | left, F.col("low")).otherwise(middle).alias("low"),
        F.when(one | ~left, F.col("high")).otherwise(middle).alias("high"),
    )


class Mix:
    """The plan of a mix: targets of the sources, and where each of their blocks goes."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                 cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED):
        self.text, self.key, self.source, self.seed = text, key, source, seed
        self.rows = stored(self.measured(docs), "mix-rows")
        totals = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        z, t = F.col("source_size"), F.col("target")
        epochs = F.when(z > 0, F.least(F.floor(t / z), F.lit(cap))).otherwise(F.lit(0)).cast("int")
        blocks = F.greatest(F.ceil(z / block_words), F.lit(1)).cast("long")
        self.sources = stored(
            source_targets(totals, weights, cap).withColumn("epochs", epochs).withColumn("rest", t - F.col("epochs") * z).withColumn("n_blocks", blocks),
            "mix-sources",
        )
        words = self.sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        self.shards = max(1, -(-words // shard_words))
        self.blocks = self._blocks()

    def measured(self, docs: DataFrame, *more: Column) -> DataFrame:
        return docs.select(
            *more,
            F.col(self.key).alias("doc_id"),
            F.col(self.source).alias("source"),
            word_count(self.text).alias("size"),
            F.xxhash64(F.lit(self.seed), F.col(self.key), F.col(self.text)).alias("value"),
        )

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their source's plan, their block and their place in it."""
        planned = _with(rows, self.sources)
        return planned.withColumn("block", F.pmod("value", F.col("n_blocks"))).withColumn("order", F.xxhash64("value", F.lit(self.seed)))

    def _blocks(self) -> DataFrame:
        dealt = self.dealt(self.rows)
        sums = stored(
            dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest")), "mix-blocks"
        )
        permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(self.seed), "source", "block"), "block")
        before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = sums.withColumn("need", F.col("rest") - before)
        whole, part = F.col("need") >= F.col("words"), (F.col("need") > 0) & (F.col("need") < F.col("words"))
        last = last.withColumn("whole", whole & (F.col("rest") > 0)).withColumn("part", part)
        edge = last.filter("part").select("source", "block", "need")
        inside = _with(dealt.select("source", "block", "order", "size"), edge, "block").groupBy("source", "need", "order").agg(F.sum("size").alias("size"))
        so_far = F.sum("size").over(Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
        taken = inside.withColumn("middle", so_far - F.col("size") / 2).filter("middle <= need")
        cuts = taken.groupBy("source").agg(F.max("order").alias("cut"))
        known = _with(last, cuts, how="left")
        known = known.withColumn("cut", F.when(F.col("part"), F.col("cut")))
        times = F.col("epochs") + (F.col("whole") | F.col("cut").isNotNull()).cast("int")
        known = stored(known.select("source", "block", "whole", "cut", times.alias("times")), "mix-quotas")
        draws = known.filter("times > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
        draws = draws.withColumn("low", F.lit(0)).withColumn("high", F.lit(self.shards))
        for level in range((self.shards - 1).bit_length()):
            draws = stored(_split(draws, level, self.seed), "mix-tree")
        placed = draws.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("low").alias("shard")))).alias("draws"))
        return stored(_with(known, placed, "block", how="left").select("source", "block", "whole", "cut", "draws"), "mix-placed")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """``rows`` (measured) with ``source_size``, ``target`` and ``draws``: the shards they go to, one entry per copy."""
        placed = _with(self.dealt(rows), self.blocks, "block")
        mine = F.filter("draws", lambda d: (d["epoch"] < F.col("epochs")) | F.col("whole") | (F.col("order") <= F.col("cut")))
        copies = F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(self.seed), "value", d["epoch"]).alias("place")))
        return placed.withColumn("draws", F.coalesce(copies, F.array().cast("array<struct<shard:int,place:bigint>>"))).drop(
            "epochs", "rest", "n_blocks", "block", "order", "whole", "cut"
        )

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The mix: rows of ``docs`` once per copy, each shard in one partition and in random order."""
        whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")
        copies = self.drawn(self.measured(docs, whole)).select("_doc", F.explode("draws").alias("_draw"))
        return copies.repartition(self.shards, "_draw.shard").sortWithinPartitions("_draw.shard", "_draw.place").select("_doc.*")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, draws, taken``."""
    mix = Mix(docs, **options)
    return mix.drawn(mix.rows).drop("value").withColumn("taken", F.col("size") * F.size("draws"))
