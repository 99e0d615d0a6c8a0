"""Shards of near equal bytes by a k-d tree over document metadata.

A node of the tree is split at the weighted median, by bytes, of its widest dimension: the one whose range
within the node is the largest part of its range over all documents. The median is found by histograms: each
round counts bytes in ranges of the sort key for all nodes at once and looks closer at the range that holds the
median; only these counts reach the driver, at most ``COUNTS`` in all. The sort key is the dimension followed
by a hash of the text, so rows with equal texts are never parted and ties do not unbalance the halves.

Nulls count as empty texts of one byte. Repeated rows and equal texts share a shard; a group of them that
holds more than a shard's part makes that shard larger. An empty table gives an empty result. Slots number
a shard's rows from 0 without gaps, ties in any order. Other columns pass through if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.llm.packs import stored

SHARDS = 8
DIM_BITS, HASH_BITS = 22, 40
COUNTS = 1 << 16
TOLERANCE = 1e-4
SLOT_RANGES = 1024


def scaled(value: Column, most: float) -> Column:
    """A value from 0 to ``most`` as an integer of ``DIM_BITS`` bits."""
    top = (1 << DIM_BITS) - 1
    return F.least(F.greatest(F.floor(value / most * top), F.lit(0)), F.lit(top)).cast("long")


def text_dimensions(text: Column) -> dict[str, Column]:
    """Length, number of lines and share of multi-byte characters; equal texts have equal values."""
    size = F.octet_length(text)
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return {
        "length": scaled(F.log2(size + F.lit(1)), 32.0),
        "lines": scaled(F.log2(lines + F.lit(1)), 32.0),
        "wide": scaled((size - F.length(text)) / (size + F.lit(1)), 1.0),
    }


@dataclass
class Node:
    shard: int
    shards: int
    test: Column | None = None
    dim: str = ""
    low: int = 0
    high: int = 1 << (DIM_BITS + HASH_BITS)
    below: int = 0
    weight: int = 0
    cut: int | None = None

    @property
    def wanted(self) -> float:
        return self.weight * (self.shards // 2) / self.shards


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), HASH_BITS).bitwiseOR(F.shiftrightunsigned("hash", 64 - HASH_BITS))


def _case(pairs: list[tuple[Column | None, Column]]) -> Column:
    out = None
    for test, value in pairs:
        if test is None:
            return value
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _medians(rows: DataFrame, nodes: list[Node]) -> None:
    """Set each node's ``cut``: keys below it go left."""
    open_nodes = list(nodes)
    while open_nodes:
        bits = max(4, min(12, (COUNTS // len(open_nodes)).bit_length() - 1))
        shift = {n.shard: max(0, (n.high - n.low - 1).bit_length() - bits) for n in open_nodes}
        which = _case([(n.test, F.lit(n.shard)) for n in open_nodes])
        place = _case([(n.test, F.shiftright(_key(n.dim) - F.lit(n.low), shift[n.shard])) for n in open_nodes])
        inside = _case([(n.test, (_key(n.dim) >= n.low) & (_key(n.dim) < n.high)) for n in open_nodes])
        counts = rows.filter(inside).groupBy(which.alias("node"), place.alias("part")).agg(F.sum("size").alias("w")).collect()
        still = []
        for n in open_nodes:
            at = n.below
            for part, w in sorted((r.part, r.w) for r in counts if r.node == n.shard):
                low = n.low + (part << shift[n.shard])
                if at + w >= n.wanted:
                    high = low + (1 << shift[n.shard])
                    if shift[n.shard] == 0 or w <= TOLERANCE * n.weight:
                        n.cut = low if n.wanted - at < at + w - n.wanted else high
                    else:
                        n.low, n.high, n.below = low, high, at
                        still.append(n)
                    break
                at += w
            else:
                n.cut = n.high
        open_nodes = still


def tree(rows: DataFrame, dims: list[str], shards: int) -> Column:
    """The shard of a row, as an expression on the columns ``dims``, ``hash`` and ``size`` of ``rows``."""
    leaves, grown = [], [Node(0, shards)]
    whole: dict[str, int] = {}
    while grown:
        leaves += [n for n in grown if n.shards == 1]
        nodes = [n for n in grown if n.shards > 1]
        if not nodes:
            break
        which = _case([(n.test, F.lit(n.shard)) for n in nodes])
        spans = [f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]
        found = {r.node: r for r in rows.groupBy(which.alias("node")).agg(F.sum("size").alias("w"), *spans).collect()}
        for n in nodes:
            r = found.get(n.shard)
            if r is None:
                n.cut, n.dim = 0, dims[0]
                continue
            width = {d: r[f"{d}_max"] - r[f"{d}_min"] for d in dims}
            whole = whole or {d: max(1, w) for d, w in width.items()}
            n.dim, n.weight = max(dims, key=lambda d: width[d] / whole[d]), r.w
        _medians(rows, [n for n in nodes if n.cut is None])
        grown = []
        for n in nodes:
            left, half = _key(n.dim) < n.cut, n.shards // 2
            both = [(left, n.shard, half), (~left, n.shard + half, n.shards - half)]
            grown += [Node(at, k, t if n.test is None else n.test & t) for t, at, k in both]
    return _case([(n.test, F.lit(n.shard)) for n in leaves])


def kd_shards(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, dims: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size`` (bytes and one), ``text_crc32, shard, slot``.

    ``dims`` maps names to integers of ``DIM_BITS`` bits that are equal for equal texts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    dims = dims or text_dimensions(t)
    rows = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(t).alias("hash"),
            *[c.alias(f"dim_{d}") for d, c in dims.items()],
        ),
        "shard-rows",
    )
    placed = rows.withColumn("shard", tree(rows, [f"dim_{d}" for d in dims], shards).cast("int"))
    return number_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def number_slots(placed: DataFrame) -> DataFrame:
    """``slot`` for each row: its number within the shard. Ranges of a hash are numbered apart and put in a row."""
    rows = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SLOT_RANGES)))
    sizes = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "hash")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(offsets, ["shard", "_part"])
    return numbered.withColumn("slot", (F.col("_at") + F.col("_offset")).cast("long")).drop("_part", "_at", "_offset")
