"""Near-duplicate join on the Jaccard similarity of word shingles by chosen paths.

A document is its set of distinct runs of ``SHINGLE`` words (a shorter one: the run of all its words).
Documents with equal sets are one class and are joined through one representative. In each run of the method
a set chooses some of its tokens by a random threshold of 1 / (``LAMBDA`` * size), so similar sets tend to choose
shared tokens; each choice extends a path and splits the sets again, ``DEPTH`` times at once. Sets with the same
path share a bucket. Small buckets are compared by brute force on sketches; buckets above ``LIMIT`` are
split on, ``DEPTH`` tokens deeper, for ``ROUNDS`` more rounds, unless most of their sets are like the first one; sets
like it are tied to it. Buckets still above ``LIMIT`` after the last round are compared by brute force, too, in block
pairs. The number of runs follows from the target recall by the survival of a path through all rounds. Sets tied by candidates form clusters, and
in these all pairs of sets of like size are compared exactly, in blocks of so many sets and tokens, so no cluster meets in one task.

A link is a pair of documents with similarity >= ``SIMILARITY``; classes are the connected components of links.
Nulls and texts without words have no set and no link: each is a class of its own. Repeated rows and copies
are linked to each other. An empty table gives an empty result. Keys may be null or repeated; the class id
is the least key of the class (null if all are null). Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.llm.components import components
from querywarden.llm.packs import KEYS, ROW_BITS, flags_of, judge, key_rows, pack, parts_of, repeats, stored, unpack
from querywarden.llm.words import Words, give_back, mix
from querywarden.operators.lookups import salted_lookup

SHINGLE, SIMILARITY = 5, (4, 5)
LAMBDA, DEPTH, ROUNDS, LIMIT = 0.7, 3, 2, 64
RECALL = 0.9995
BINS, LIKELY = 128, 0.6
#: a large bucket with this share of sets somewhat like its first one is not split on; all its sets are tied to the first
SOMEWHAT, DENSE = 0.4, 0.5
#: a block of a cluster has about this many sets and tokens at most; sets of two bands of sizes apart cannot be linked
BLOCK, TOKENS, BAND = 512, 1 << 19, 1.3
#: (path, token) pairs looked at together, and bytes of sets sent together
PAIRS, SLICE = 1 << 18, 1 << 21
CHUNK = 1 << 20
SEED = 0x5DEECE66D


def survival(similarity: float, depth: int) -> float:
    """Chance that two sets of a similarity still share a path after ``depth`` choices, at least."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - exp(-alive * similarity / LAMBDA)
    return alive


def runs_for(recall: float) -> int:
    """Runs until two sets at the threshold have met in a bucket with chance ``recall``, even if all their buckets are split on to the last round."""
    return ceil(log(1 - recall) / log(1 - survival(SIMILARITY[0] / SIMILARITY[1], DEPTH * (ROUNDS + 1))))


class Sets:
    """The shingle sets of a chunk, one after the other, each sorted."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        h = w.hashes()
        at, run = w.windows(h, SHINGLE)
        doc = w.doc[at]
        few = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
        whole = [int(mix(np.bitwise_xor.reduce(mix(h[w.first[d] : w.first[d + 1]] + np.arange(w.count[d], dtype=np.uint64))) + np.uint64(w.count[d]))) for d in few]
        doc, run = np.concatenate((doc, few)), np.concatenate((run, np.array(whole, np.uint64)))
        order = np.lexsort((run, doc))
        doc, run = doc[order], run[order]
        new = np.ones(len(run), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
        self.n_words = w.count
        self.token, self.doc = run[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def of(self, d: int) -> np.ndarray:
        return self.token[self.first[d] : self.first[d + 1]]

    def thresholds(self) -> np.ndarray:
        chance = np.minimum(1.0, 1 / (LAMBDA * np.maximum(self.size, 1)))
        return np.minimum(chance * 2.0**64, 2.0**64 - 2048).astype(np.uint64)

    def paths(self, doc: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths ``depth`` choices longer than those given: documents, keys, and the numbers of the paths they extend."""
        chance, origin = self.thresholds(), np.arange(len(doc))
        for _ in range(depth):
            node, token = self._choices(doc, key, chance)
            doc, key, origin = doc[node], mix(key[node] ^ mix(self.token[token])), origin[node]
        return doc, key, origin

    def _choices(self, doc: np.ndarray, key: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every path meets each token of its set: the pairs of path and chosen token, worked out in slices."""
        size = self.size[doc]
        total = np.cumsum(size)
        nodes, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(doc):
            end = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + PAIRS, side="right")))
            part = size[at:end]
            node = np.repeat(np.arange(at, end), part)
            token = np.arange(len(node)) - np.repeat(np.cumsum(part) - part, part) + self.first[doc[node]]
            taken = self.token[token] * (key[node] | np.uint64(1)) <= chance[doc[node]]
            nodes.append(node[taken])
            tokens.append(token[taken])
            at = end
        return np.concatenate(nodes), np.concatenate(tokens)

    def sketches(self) -> list[bytes]:
        """One byte for each of ``BINS`` ranges of hashes: of the least token in it, or 0 if there is none."""
        scrambled = mix(self.token)
        order = np.lexsort((scrambled, self.doc))
        value, doc = scrambled[order], self.doc[order]
        slot = (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        place = doc * BINS + slot
        lead = np.ones(len(place), bool)
        lead[1:] = place[1:] != place[:-1]
        out = np.zeros(len(self.size) * BINS, np.uint8)
        out[place[lead]] = (value[lead] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
        return [out[d * BINS : (d + 1) * BINS].tobytes() for d in range(len(self.size))]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    either = ((a | b) > 0).sum(1)
    return ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1)


def _describe(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = Sets(unpack(row))
                n = len(s.size)
                low = np.zeros(n, np.uint64)
                high = np.zeros(n, np.uint64)
                np.add.at(low, s.doc, mix(s.token))
                np.add.at(high, s.doc, mix(s.token ^ np.uint64(SEED)))
                full = np.flatnonzero(s.size > 0)
                starts = mix(np.arange(runs, dtype=np.uint64) + np.uint64(SEED))
                docs, keys, _ = zip(*(s.paths(full, np.full(len(full), k), DEPTH) for k in starts), strict=True)
                docs, keys = np.concatenate(docs), np.concatenate(keys)
                order = np.argsort(docs, kind="stable")
                ends = np.searchsorted(docs[order], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["chunk"] * (1 << ROW_BITS) + np.arange(n), pa.int64()),
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(s.size, pa.int64()),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.array(s.sketches(), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))),
                    ],
                    ["row", "doc_id", "size", "low", "high", "sketch", "keys"],
                )
                del s, docs, keys, order, ends, low, high
                give_back()

    return run


DESCRIBED = "row long, doc_id long, size long, low long, high long, sketch binary, keys array<long>"


NODE = np.dtype([("level", "u1"), ("key", "<u8"), ("row", "<i8"), ("parent", "<u8")])
NODES = "chunk long, nodes binary"
DEEPER = "level int, key long, row long, parent long"


def _deeper(_, left: pa.Table, right: pa.Table) -> pa.Table:
    """Further paths of the sets of a chunk that lie in large buckets, for all rounds to come, packed; ``parent`` is
    the path of the round before that a path extends."""
    chunks, blobs = [], []
    for row in left.to_pylist():
        s = Sets(unpack(row))
        base = row["chunk"] << ROW_BITS
        doc, key = right.column("row").to_numpy() - base, right.column("key").to_numpy().view(np.uint64)
        found = []
        for level in range(1, ROUNDS + 1):
            before = key
            doc, key, origin = s.paths(doc, key, DEPTH)
            nodes = np.empty(len(key), NODE)
            nodes["level"], nodes["key"], nodes["row"], nodes["parent"] = level, key, doc + base, before[origin]
            found.append(nodes)
        chunks.append(row["chunk"])
        blobs.append(np.concatenate(found).tobytes())
        del s, found
        give_back()
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "nodes": pa.array(blobs, pa.binary())})


def _node_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, times = np.unique(np.frombuffer(row["nodes"], NODE)["key"], return_counts=True)
                yield key_rows(row["chunk"], keys, (times > 1).astype(np.uint8), parts)

    return run


def _shared_nodes(_, left: pa.Table, right: pa.Table) -> pa.Table:
    """The paths of a chunk that other sets take, too."""
    nodes = np.concatenate([np.frombuffer(b, NODE) for b in left.column("nodes").to_pylist()] or [np.empty(0, NODE)])
    if len(nodes):
        _keys, which = np.unique(nodes["key"], return_inverse=True)
        nodes = nodes[flags_of(right)[which] > 0]
    columns = [nodes["level"].astype(np.int32), nodes["key"].astype(np.int64), nodes["row"].astype(np.int64), nodes["parent"].astype(np.int64)]
    return pa.table([pa.array(c) for c in columns], ["level", "key", "row", "parent"])


def deeper_nodes(packed: DataFrame, going: DataFrame) -> DataFrame:
    """Further paths from those of ``going`` (key, row, chunk), as far as two sets share them."""
    nodes = stored(packed.groupBy("chunk").cogroup(going.groupBy("chunk")).applyInArrow(_deeper, NODES), "deeper")
    keys = nodes.mapInArrow(_node_keys(parts_of(packed.sparkSession)), KEYS)
    flags = judge(keys, np.dtype("u1"), repeats)
    return stored(nodes.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_shared_nodes, DEEPER), "shared")


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent[up]
        x = up
    return x


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force inside buckets, which are runs of equal keys of at most ``LIMIT`` rows; a forest of the likely pairs."""
    parent: dict[int, int] = {}
    rest: pa.Table | None = None

    def compare(t: pa.Table) -> None:
        key, row = t.column("key").to_numpy(), t.column("row").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(row), BINS)
        for lag in range(1, LIMIT):
            at = np.flatnonzero(key[lag:] == key[:-lag]) if lag < len(key) else []
            if not len(at):
                return
            for part in np.array_split(at, len(at) // 100_000 + 1):
                for i in part[alike(sketch[part], sketch[part + lag]) >= LIKELY]:
                    a, b = _root(parent, int(row[i])), _root(parent, int(row[i + lag]))
                    parent[max(a, b)] = min(a, b)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        key = t.column("key").to_numpy()
        open_from = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        compare(t.slice(0, open_from))
        rest = t.slice(open_from)
    if rest is not None:
        compare(rest)
    rest = None
    pairs = [(x, _root(parent, x)) for x in parent if _root(parent, x) != x]
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, BINS) for c in ("sketch", "sketch_first"))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("first"), pa.array(alike(one, two))], ["row", "first", "near"])


def _stars(link: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each row the least row of its component by ``link``; these edges have the components of all links."""
    least, left = row.copy(), np.ones(len(row), bool)
    for i in np.argsort(row):
        front = np.array([i] if left[i] else [], np.int64)
        while len(front):
            least[front], left[front] = row[i], False
            front = np.flatnonzero(link[front].any(0) & left)
    return least


def _large_buckets(group: pa.Table) -> pa.Table:
    """Brute force on a block pair of a bucket; a forest of the likely pairs."""
    row = group.column("row").to_numpy()
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(row), BINS)
    likely = np.stack([alike(sketch[i], sketch) >= LIKELY for i in range(len(row))])
    least = _stars(likely, row)
    tied = least != row
    return pa.table({"a": pa.array(row[tied]), "b": pa.array(least[tied])})


def block_pairs(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Likely pairs inside buckets of any size (``key``, ``row``, ``n`` rows), each block of a bucket with each other."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = large.select("key", "row", blocks.alias("blocks"), F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"))
    spread = placed.join(sketches, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = spread.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "row", "sketch")
    return sides.groupBy("key", "one", "two").applyInArrow(_large_buckets, "a long, b long").distinct()


def candidates(described: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of rows whose connected components hold all likely links.

    No local rows join in: those come through Python workers of a second kind, which an executor keeps beside the others.
    """
    sketches = described.select("row", "sketch")
    nodes = described.select(F.explode("keys").alias("key"), "row")
    found = []
    for level in range(ROUNDS + 1):
        nodes = nodes.distinct()
        sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1")
        shared = stored(nodes.join(sizes, "key"), "buckets")
        small = shared.filter(F.col("n") <= LIMIT).join(sketches, "row").select("key", "row", "sketch")
        found.append(small.repartition("key").sortWithinPartitions("key", "row").mapInArrow(_small_buckets, "a long, b long"))
        large = shared.filter(F.col("n") > LIMIT).select("key", "row", "first", "n")
        firsts = large.select("first").distinct().join(sketches.withColumnsRenamed({"row": "first", "sketch": "sketch_first"}), "first")
        pairs = large.filter("row != first").select("row", "first").distinct().join(sketches, "row").join(firsts, "first")
        near = stored(pairs.mapInArrow(_near_first, "row long, first long, near double"), "near")
        found.append(near.filter(F.col("near") >= LIKELY).select(F.col("row").alias("a"), F.col("first").alias("b")))
        # only sets unlike the first one meet their paths again: in a bucket of near copies they are few
        weak = stored(large.join(near.filter(F.col("near") < LIKELY), ["row", "first"]), "weak")
        unlike = weak.groupBy("key", "n").agg(F.count(F.when(F.col("near") < SOMEWHAT, 1)).alias("unlike"))
        sparse = stored(unlike.filter((F.col("n") - F.col("unlike")) / F.col("n") < DENSE).select("key"), "sparse")
        found.append(weak.join(sparse, "key", "left_anti").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct())
        going = large.join(sparse, "key", "left_semi").select("key", "row", "n", F.shiftright("row", ROW_BITS).alias("chunk"))
        if going.isEmpty():
            break
        if level == ROUNDS:
            found.append(block_pairs(going, sketches))
            break
        if not level:
            deeper = deeper_nodes(packed, going)
        open_keys = going.select(F.col("key").alias("parent")).distinct()
        nodes = deeper.filter(F.col("level") == level + 1).join(open_keys, "parent", "left_semi").select("key", "row")
    return reduce(DataFrame.union, found)


PLACE = ["row", "cluster", "band", "block", "blocks", "above", "below", "copies"]
SETS = "row long, cluster long, band int, block int, blocks int, above int, below int, copies long, tokens binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the placed rows of each chunk, each set once, in slices of about ``SLICE`` bytes."""
    for b in batches:
        for i in range(b.num_rows):
            texts = unpack(b.select(["size", "raw", "blob"]).slice(i, 1).to_pylist()[0])
            places = pa.RecordBatch.from_struct_array(b.column("places").slice(i, 1).flatten()).select(PLACE)
            s = Sets([texts[place] for place in places.column("row").to_numpy() & ((1 << ROW_BITS) - 1)])
            del texts
            total, at = np.cumsum(8 * s.size), 0
            while at < places.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] - 8 * s.size[at] + SLICE, side="right")))
                tokens = pa.array([s.of(d).tobytes() for d in range(at, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([*places.slice(at, end - at).columns, tokens], [*PLACE, "tokens"])
                at = end
            del s, tokens
            give_back()


def _exact(group: pa.Table) -> pa.Table:
    """All pairs of a block pair (of one block: all in it; else those of both sides): each row's linked documents, and
    the least row its links lead to."""
    sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
    row, copies, side = (group.column(c).to_numpy() for c in ("row", "copies", "side"))
    m, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        part = np.zeros((m, 2048), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    link = SIMILARITY[1] * common >= SIMILARITY[0] * union
    np.fill_diagonal(link, False)
    if group.column("next")[0].as_py() or group.column("one")[0].as_py() != group.column("two")[0].as_py():
        link &= side[:, None] != side[None, :]
    links = link @ copies
    return pa.table({"row": pa.array(row), "links": pa.array(links.astype(np.int64)), "least": pa.array(_stars(link, row))})


def placed(clusters: DataFrame) -> DataFrame:
    """``PLACE`` for the rows of ``clusters`` (row, cluster, copies, size).

    A cluster that fits into a block is one block (``band`` -1). Others are cut into bands of sizes by powers of ``BAND``,
    so that linked sets are in the same band or in neighbours (their sizes differ by a quarter at most), and a band into
    blocks by hash: as many as its sets and tokens ask for, ``blocks``; ``above`` and ``below`` are those of its neighbours.
    """
    banded = clusters.withColumn("band", F.floor(F.log("size") / F.log(F.lit(BAND))).cast("int"))
    parts = stored(banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")), "bands")
    whole = parts.groupBy("cluster").agg(((F.sum("n") <= BLOCK) & (F.sum("tokens") <= TOKENS)).alias("whole"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / TOKENS)).cast("int")
    sized = parts.join(whole, "cluster").select("cluster", "band", "whole", F.when(F.col("whole"), 1).otherwise(blocks).alias("blocks"))
    bands = Window.partitionBy("cluster").orderBy("band")

    def neighbour(step: int) -> Column:
        there = ~F.col("whole") & (F.lag("band", step).over(bands) == F.col("band") - step)
        return F.when(there, F.lag("blocks", step).over(bands)).otherwise(0)

    cut = sized.withColumn("above", neighbour(-1)).withColumn("below", neighbour(1))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    return salted_lookup(banded, cut, ["cluster", "band"], "row", "inner").select(
        "row", "cluster", F.when(F.col("whole"), -1).otherwise(F.col("band")).alias("band"), block.alias("block"), "blocks", "above", "below", "copies"
    )


def block_units() -> Column:
    """The block pairs of a placed row: with each block of its band, and of the bands next to it."""

    def with_each(blocks: str, unit) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.col(blocks), F.lit(1)) - 1), unit)

    def unit(band: Column, following: int, one: Column, two: Column, side: Column) -> Column:
        return F.struct(band.alias("band"), F.lit(following).alias("next"), one.alias("one"), two.alias("two"), side.cast("int").alias("side"))

    band, block = F.col("band"), F.col("block")
    own = with_each("blocks", lambda o: unit(band, 0, F.least(block, o), F.greatest(block, o), block))
    above = with_each("above", lambda o: unit(band, 1, block, o, F.lit(0)))
    below = with_each("below", lambda o: unit(band - 1, 1, o, block, F.lit(1)))
    return F.concat(own, F.when(F.col("above") > 0, above).otherwise(F.slice(above, 1, 0)), F.when(F.col("below") > 0, below).otherwise(F.slice(below, 1, 0)))


def exact_links(packed: DataFrame, clusters: DataFrame) -> DataFrame:
    """``row, links, least`` for the rows of ``clusters`` (row, cluster, copies, size), from exact comparisons.

    A set leaves Python once and is copied in the shuffle, once for each block pair it belongs to: n / ``BLOCK``
    copies in a cluster of n sets of like size. No task holds more than a block pair.
    """
    places = placed(clusters).withColumn("chunk", F.shiftright("row", ROW_BITS))
    wanted = places.groupBy("chunk").agg(F.collect_list(F.struct(*PLACE)).alias("places"))
    sets = packed.join(wanted, "chunk").select("size", "raw", "blob", "places").mapInArrow(_sets, SETS)
    units = sets.select("row", "cluster", "copies", "tokens", F.explode(block_units()).alias("u"))
    sides = units.select("cluster", "u.band", "u.next", "u.one", "u.two", "u.side", "row", "copies", "tokens")
    return sides.groupBy("cluster", "band", "next", "one", "two").applyInArrow(_exact, "row long, links long, least long")


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``class_id``, ``n_links`` (documents it is linked to), ``n_tokens``
    (shingles) and ``stays``, true for one row of each class: a row with the class id as key."""
    packed = pack(docs, text, key, CHUNK)
    described = stored(packed.mapInArrow(_describe(runs_for(recall)), DESCRIBED), "sets")
    full = described.filter("size > 0")
    sets = stored(full.groupBy("low", "high").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size")), "classes")
    chosen = described.join(sets.select("row"), "row", "left_semi")
    clusters = components(candidates(chosen, packed)).select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    exact = stored(exact_links(packed, clusters.join(sets.select("row", "copies", "size"), "row")), "links")
    counts = exact.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(exact.filter("least != row").select(F.col("row").alias("a"), F.col("least").alias("b")))
    rooted = sets.drop("size").join(counts, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "row"))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = rooted.join(classes, "root").select("low", "high", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = described.select("row", "doc_id", "size", "low", "high").join(known, ["low", "high"], "left")
    alone = (F.col("size") == 0) | F.col("root").isNull()
    joined = out.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("size").alias("n_tokens"),
        F.when(alone, F.col("row")).otherwise(F.col("root")).alias("root"),
    )
    firsts = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f")).select("root", F.col("f.row").alias("first"))
    return joined.join(firsts, "root").select("doc_id", "class_id", "n_links", "n_tokens", (F.col("row") == F.col("first")).alias("stays"), "row")
