"""The prefix trie of rebuilt conversations, held in burst containers.

A turn's id is a 128-bit hash of its place, role and text, and a node is named by the exclusive-or of the
ids on its path. A container holds the distinct suffixes below one node, the trie head, with how often each
occurs and its least conversation. A container of more than ``CAPACITY`` suffixes bursts: its head becomes a node,
and its suffixes move to one container for each next turn id. Containers that are left are dealt to shards by
their head, sorted there, and swept into nodes with one path in memory. Burst nodes then get their subtree
sums from the containers below them, round by round.

Long conversations are cut into segments of ``SEGMENT`` turns, each filed under the node before it, so a row
stays small and bursting takes at most ``SEGMENT`` rounds, whatever a conversation's length. What lies below a
segment is summed by pointer doubling over the segments' heads and added to the nodes on the way.

Turns are put in order without one task for a conversation: all turns are sorted into ranges, and counted by
range. Turns are ordered by number (null first), then by the hash of role and text; equal rows are turns of
their own. Null roles and texts are empty; the remainder of a negative id is negative or zero. Rows without a conversation id belong to no conversation. An empty
table has no nodes; other columns play no part. The list of conversations that end at a node is hashed in order
by one task, as SHA-256 demands, but streamed in packed pieces, so it is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywarden.llm.packs import stored

SEGMENT, CAPACITY = 64, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: conversations c - c % GROUP to c lend and borrow first turns, up to BORROWED - 1 of them
GROUP, BORROWED = 20, 4
#: conversation ids of a packed piece
PIECE_BITS = 12
BATCH = 4096
SWEPT = (
    "kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "a long, b long, pa long, pb long"
)
ENDS = "ea long, eb long, ends_sha256 string"
#: a node's name; a container's, as the last node of a segment heads a container of the next one, too
KEY = ["ka", "kb"]
HELD = [*KEY, "seg"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, pos, id, w``: the turns with their place in the conversation, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("id"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("w"),
    )
    narrow = stored(rows, "turns")
    # equal rows may be dealt to several ranges, too
    ranged = narrow.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "id", "_nth").drop("_nth")
    placed = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "id")
    numbered = placed.withColumn("nth", F.row_number().over(within)).join(offsets, ["conv_id", "part"])
    return stored(numbered.select("conv_id", "part", (F.col("before") + F.col("nth") - 1).alias("pos"), "id", "w"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, total`` of all conversations, and ``conv_id, total, d, id, w`` of their turns after borrowing."""
    size = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    lent = turns.filter((F.col("pos") < BORROWED - 1) & (F.col("conv_id") % GROUP == 0))
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "w"))).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    convs = size.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    head = F.filter("head", lambda t: t["pos"] < F.col("h"))
    convs = convs.join(lent, "base", "left").withColumn("head", F.when(F.col("head").isNotNull(), head).otherwise(F.array().cast("array<struct<pos:long,id:binary,w:long>>")))
    total = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("m"), total.alias("total")), "conversations")
    # the few ranges of a conversation carry what its turns need to know, so that turns of one are not drawn together
    known = size.select("conv_id", "part").join(convs.drop("head"), "conv_id")
    own = turns.join(known, ["conv_id", "part"]).filter("pos >= h").select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("m")).alias("d"), "id", "w")
    borrowed = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", "total", F.col("t.pos").alias("d"), "t.id", "t.w")
    return convs.select("conv_id", "total"), own.unionByName(borrowed)


def _xor(turns: str | Column, side: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[side]))


def segments(convs: DataFrame, path: DataFrame, segment: int) -> DataFrame:
    """``conv_id, seg, turns, goes_on`` and the names of the nodes before (``ka, kb``) and at its end (``ea, eb``)."""
    d = path.select("conv_id", "total", F.expr(f"d div {segment}").alias("seg"), F.struct("d", F.xxhash64("d", "id").alias("a"), F.xxhash64("id", "d").alias("b"), "w").alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w")))
    segs = d.groupBy("conv_id", "total", "seg").agg(turns.alias("turns"))
    none = convs.filter("total = 0").select("conv_id", "total", F.lit(0).cast("long").alias("seg"), F.array().cast(segs.schema["turns"].dataType).alias("turns"))
    segs = stored(segs.unionByName(none).withColumn("sa", _xor("turns", "a")).withColumn("sb", _xor("turns", "b")), "segments")
    goes_on = (F.col("total") > (F.col("seg") + 1) * segment).alias("goes_on")
    ends = [F.col(f"k{x}").bitwiseXOR(F.col(f"s{x}")).alias(f"e{x}") for x in "ab"]
    zero = [F.lit(0).cast("long").alias(f"k{x}") for x in "ab"]
    short = segs.filter(F.col("total") <= segment).select("*", *zero)
    # names of the nodes before the segments of long conversations: sums of blocks of segments, then of segments
    long = segs.filter(F.col("total") > segment).withColumn("block", F.expr("seg div 4096"))
    names = long.select("conv_id", "block", "seg", "sa", "sb")
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = names.groupBy("conv_id", "block").agg(F.bit_xor("sa").alias("xa"), F.bit_xor("sb").alias("xb"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{x}").over(upto), F.lit(0)).alias(f"y{x}") for x in "ab"])
    inside = Window.partitionBy("conv_id", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    heads = names.withColumns({f"z{x}": F.coalesce(F.bit_xor(f"s{x}").over(inside), F.lit(0)) for x in "ab"}).join(blocks, ["conv_id", "block"])
    heads = heads.select("conv_id", "seg", *[F.col(f"z{x}").bitwiseXOR(F.col(f"y{x}")).alias(f"k{x}") for x in "ab"])
    long = long.drop("block").join(heads, ["conv_id", "seg"])
    return short.unionByName(long).select("conv_id", "seg", "turns", goes_on, *KEY, *ends)


def end_digests(segs: DataFrame) -> DataFrame:
    """``ea, eb, ends_sha256`` of the nodes at which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []

        def handed() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["ea", "eb", "ends_sha256"])

        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("ea", "eb", "ids")), strict=True):
                if (a, b) == at:
                    digest.update(b",")
                else:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            if len(out) >= BATCH:
                yield handed()
        if at:
            out.append((*at, digest.hexdigest()))
            yield handed()

    pieces = segs.filter("not goes_on").groupBy("ea", "eb", F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    packed = pieces.agg(ids.alias("ids")).repartition("ea", "eb").sortWithinPartitions("ea", "eb", "piece")
    return packed.select("ea", "eb", "ids").mapInArrow(run, ENDS)


class Node:
    """A node on the path of a sweep; ``done`` are its finished children, which wait for its least conversation."""

    __slots__ = ("a", "b", "children", "depth", "done", "first", "leaves", "n", "open", "saved", "w")

    def __init__(self, depth: int, a: int, b: int, w: int):
        self.depth, self.a, self.b, self.w = depth, a, b, w
        self.n = self.children = self.leaves = self.saved = 0
        self.first, self.open, self.done = None, False, []

    def add(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)

    def finish(self) -> None:
        """Count the node itself into its sums."""
        self.leaves += not self.children and not self.open
        self.saved += (self.n - 1) * self.w

    def row(self, parent: int | None) -> tuple:
        return 0, self.depth, self.first, parent, self.n, self.children, self.leaves, self.saved, self.a, self.b, None, None


def sweep(rows: Iterator[dict], segment: int) -> Iterator[tuple]:
    """Nodes (kind 0) and containers' sums (kind 1) of suffixes sorted by container, then by turns.

    The head of a later segment is a node of the segment before, so only its sums come out here.
    """
    path, head, last = [], None, None

    def close() -> list[tuple]:
        node = path.pop()
        top = not path
        inner = top and head["seg"] and not head["at"]
        if not inner:
            node.finish()
        out = [d.row(head["up"] if inner else node.first) for d in node.done]
        node.done = []
        if not top:
            up = path[-1]
            up.add(node.n, node.first)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.done.append(node)
            return out
        if not inner:
            out.append(node.row(head["up"]))
        out.append((1, node.depth, node.first, None, node.n, node.children, node.leaves, node.saved, node.a, node.b, head["pa"], head["pb"]))
        return out

    for r in rows:
        turns, at = r["turns"], r["at"]
        if head is None or any(r[k] != head[k] for k in HELD):
            while path:
                yield from close()
            head, last = r, []
            path.append(Node(r["seg"] * segment + at, r["ka"], r["kb"], turns[at - 1]["w"] if at else 0))
        same = at
        while same < min(len(turns), len(last)) and turns[same] == last[same]:
            same += 1
        while len(path) > same - at + 1:
            yield from close()
        for t in turns[same:]:
            p = path[-1]
            path.append(Node(p.depth + 1, p.a ^ t["a"], p.b ^ t["b"], t["w"]))
        path[-1].add(r["n"], r["first"])
        path[-1].open |= r["goes_on"]
        last = turns
    while path:
        yield from close()


def _swept(rows: DataFrame, segment: int) -> DataFrame:
    names = [f.split()[0] for f in SWEPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        schema = pa.schema([(n, pa.int32() if n == "kind" else pa.int64()) for n in names])
        for x in sweep((r for b in batches for r in b.to_pylist()), segment):
            out.append(x)
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    shards = rows.repartition(*HELD).sortWithinPartitions(*HELD, "turns")
    return stored(shards.mapInArrow(run, SWEPT), "swept")


def _burst(rows: DataFrame, segment: int, capacity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The suffixes in containers that hold ``capacity`` at most, and the nodes whose containers burst, round by round."""
    left, nodes = [], []
    inner = (F.col("seg") > 0) & (F.col("at") == 0)
    while True:
        big = stored(rows.groupBy(*HELD).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id")).filter(F.col("m") > capacity), "oversized")
        if big.isEmpty():
            return [*left, rows], nodes
        marked = stored(rows.join(big.select(*HELD, F.col("conv_id").alias("least")), HELD, "left"), "containers")
        left.append(marked.filter("least is null").drop("least"))
        hot = marked.filter("least is not null and size(turns) > at")
        turn = F.element_at("turns", F.col("at") + 1)
        kids = hot.groupBy(*HELD, turn["a"].alias("ta"), turn["b"].alias("tb")).agg(F.any_value("at").alias("at"), F.any_value("up").alias("up"), F.any_value("pa").alias("pa"), F.any_value("pb").alias("pb"), F.any_value(F.get("turns", F.col("at") - 1)["w"]).alias("w"))
        heads = kids.groupBy(*HELD).agg(F.count(F.lit(1)).alias("n_children"), *[F.any_value(c).alias(c) for c in ("at", "up", "pa", "pb", "w")])
        found = heads.join(big.drop("m"), HELD).withColumn("kind", F.when(inner, 1).otherwise(0)).withColumn("depth", F.col("seg") * segment + F.col("at"))
        own = F.when(inner | F.col("w").isNull(), 0).otherwise((F.col("n_convs") - 1) * F.col("w"))
        nodes.append(stored(found.withColumn("own", own), "burst"))
        rows = stored(
            hot.select(
                *[F.col(f"k{x}").bitwiseXOR(turn[x]).alias(f"k{x}") for x in "ab"],
                "seg", (F.col("at") + 1).alias("at"), F.when(inner, F.col("up")).otherwise(F.col("least")).alias("up"),
                F.col("ka").alias("pa"), F.col("kb").alias("pb"), "turns", "n", "first", "goes_on",
            ),
            "burst-suffixes",
        )


SUMS = ["n_leaves", "saved_tokens"]


def _upward(nodes: list[DataFrame], swept: DataFrame) -> list[DataFrame]:
    """The burst nodes with the sums of the containers below them."""
    up = [F.sum(s).alias(f"_{s}") for s in SUMS]
    below = swept.filter("kind = 1 and pa is not null").groupBy("pa", "pb").agg(*up)
    out: list[DataFrame] = []
    for level in reversed(nodes):
        sums = below
        if out:
            sums = below.unionByName(out[-1].filter("pa is not null").groupBy("pa", "pb").agg(*up)).groupBy("pa", "pb").agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in SUMS])
        joined = level.join(sums.withColumnsRenamed({"pa": "ka", "pb": "kb"}), KEY, "left")
        out.append(stored(joined.withColumn("n_leaves", F.coalesce("_n_leaves", F.lit(0))).withColumn("saved_tokens", F.col("own") + F.coalesce("_saved_tokens", F.lit(0))).drop(*[f"_{s}" for s in SUMS]), "burst-sums"))
    return out


def _below_segments(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``ka, kb`` of the first and last node of each segment that goes on, its ``turns`` and ``seg``, and the sums of all
    that lies below its last node: the head's own segment, and by pointer doubling those further down."""
    tree = rows.filter("goes_on").select("seg", "turns", "ka", "kb", "ea", "eb").join(heads.withColumnsRenamed({"a": "ea", "b": "eb"}), ["ea", "eb"])
    now = stored(tree.withColumn("pa", F.when(F.col("seg") > 0, F.col("ka"))).withColumn("pb", F.when(F.col("seg") > 0, F.col("kb"))), "segment-sums")
    while not now.filter("pa is not null").isEmpty():
        sums = now.filter("pa is not null").groupBy(F.col("pa").alias("ea"), F.col("pb").alias("eb")).agg(*[F.sum(s).alias(f"_{s}") for s in SUMS])
        jump = now.select(F.col("ea").alias("pa"), F.col("eb").alias("pb"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"))
        step = now.join(sums, ["ea", "eb"], "left").withColumns({s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in SUMS}).drop(*[f"_{s}" for s in SUMS])
        now = stored(step.join(jump, ["pa", "pb"], "left").drop("pa", "pb").withColumnsRenamed({"_pa": "pa", "_pb": "pb"}), "segment-sums")
    return now


def _lengthened(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes with what lies in later segments: children of a segment's last node, and sums for all on the way to it."""
    names = F.aggregate(
        "turns",
        F.array(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b"))),
        lambda out, t: F.concat(out, F.array(F.struct(F.element_at(out, -1)["a"].bitwiseXOR(t["a"]).alias("a"), F.element_at(out, -1)["b"].bitwiseXOR(t["b"]).alias("b")))),
    )
    # the first node of a later segment is the last one of the segment before
    way = F.when(F.col("seg") > 0, F.slice(names, F.lit(2), F.size("turns"))).otherwise(names)
    extra = below.select(F.explode(way).alias("k"), *SUMS).groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(*[F.sum(s).alias(f"_{s}") for s in SUMS])
    kids = below.select(F.col("ea").alias("a"), F.col("eb").alias("b"), F.col("n_children").alias("_n_children"))
    joined = nodes.join(extra, ["a", "b"], "left").join(kids, ["a", "b"], "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in (*SUMS, "n_children")}).drop("_n_children", *[f"_{s}" for s in SUMS])


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, capacity: int = CAPACITY) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    segs = stored(segments(*rebuilt(own_turns(conversations)), segment), "paths")
    keep = [F.any_value(c).alias(c) for c in ("seg", "turns", "ka", "kb")]
    rows = segs.groupBy("ea", "eb").agg(*keep, F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.max("goes_on").alias("goes_on"))
    rows = stored(rows, "suffixes")
    long = not rows.filter("goes_on").isEmpty()
    nothing = F.lit(None).cast("long")
    start = rows.withColumns({"at": F.lit(0), "up": nothing, "pa": nothing, "pb": nothing})
    if long:
        above = rows.filter("goes_on").select(F.col("ea").alias("ka"), F.col("eb").alias("kb"), F.col("first").alias("up"))
        start = start.drop("up").join(above, KEY, "left")
    columns = [*KEY, "seg", "at", "up", "pa", "pb", "turns", "n", "first", "goes_on"]
    left, burst = _burst(stored(start.select(*columns), "suffixes"), segment, capacity)
    whole = left[0].select(*columns)
    for more in left[1:]:
        whole = whole.unionByName(more.select(*columns))
    swept = _swept(whole, segment)
    out = ["kind", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", *SUMS, "a", "b"]
    nodes = swept.select(*out, "pa")
    for level in _upward(burst, swept):
        nodes = nodes.unionByName(level.withColumnsRenamed({"ka": "a", "kb": "b", "up": "parent_conv_id"}).select(*out, "pa"))
    found = nodes.filter("kind = 0").drop("kind", "pa")
    if long:
        heads = nodes.filter("kind = 1 and pa is null and depth > 0").select("a", "b", "n_children", *SUMS)
        found = _lengthened(found, _below_segments(rows, heads))
    ends = end_digests(segs).withColumnsRenamed({"ea": "a", "eb": "b"})
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return found.join(ends, ["a", "b"], "left").select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", *SUMS, digest.alias("ends_sha256")
    )
