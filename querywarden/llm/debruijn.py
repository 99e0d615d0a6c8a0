"""Removal of long repeated passages by a compacted De Bruijn graph of word windows.

A window of ``WINDOW`` words is an edge of the graph; its nodes are the windows' common parts. First, each
window is reduced to its minimiser, the run of ``ANCHOR`` words in it with the smallest hash: equal windows
have equal minimisers, so only windows whose minimiser occurs twice can repeat. These windows become edges
with the word before and after. Edges that occur twice are the repeated part of the graph. Where all
occurrences of an edge have the same next word and all occurrences of that next edge the same previous word,
the two are compacted; what remains are maximal nonbranching paths. Each document's occurrences of a path are
joined by the path and verified by the words at their source coordinates: a path stays only where at least two
occurrences hold the same words.

All occurrences are removed, those in the same document included. Nulls and texts shorter than a window
lose nothing. A repeated row repeats all its windows. An empty table gives an empty result. Keys may be null
or repeated; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import FLAGS, KEYS, flags_of, judge, key_rows, pack, parts_of, repeats, stored, unpack
from querywarden.llm.words import Words, covered, rolling

WINDOW, ANCHOR = 35, 12
EDGE = np.dtype([("many", "u1"), ("before", "<u8"), ("after", "<u8")])
BRANCH = (1 << 64) - 1
OUT = (
    "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>, "
    "chunk long, path long, low long, high long"
)


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours."""
    n, have, out = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while 2 * have <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    return best(out[:n], out[width - have : width - have + n])


class Chunk:
    """Words, windows and minimisers of a chunk."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words = Words(texts)
        self.window = window
        self.hash = self.words.hashes()
        n = len(self.hash)
        self.at, self.edge = self.words.windows(self.hash, window)
        if not len(self.at):
            self.least = np.empty(0, np.uint64)
            self.anchors, self.times = self.least, np.empty(0, np.int64)
            return
        runs = rolling(self.hash, anchor)
        least = _sliding(runs, window - anchor + 1, np.minimum)
        self.least = least[self.at]
        inside = np.zeros(n - window + 1, np.uint64)
        inside[self.at] = self.least
        width = window - anchor
        most = _sliding(np.concatenate((np.zeros(width, np.uint64), inside, np.zeros(width, np.uint64))), width + 1, np.maximum)
        chosen = (most == runs) & (most > 0)
        self.anchors, self.times = np.unique(runs[chosen], return_counts=True)

    def candidates(self, flags: np.ndarray) -> np.ndarray:
        """Windows (numbers into ``at``) whose minimiser repeats."""
        if not len(self.at):
            return self.at
        return np.flatnonzero(flags[np.searchsorted(self.anchors, self.least)] > 0)

    def edges(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct edges among the picked windows, what is known of each here, and the edge of each window."""
        w = self.words
        at, doc = self.at[picked], w.doc[self.at[picked]]
        # no word is 0, and different ones are BRANCH
        word = lambda h: h % np.uint64(BRANCH - 1) + np.uint64(1)
        before = np.where(at > w.first[doc], word(self.hash[np.maximum(at - 1, 0)]), np.uint64(0))
        last = w.first[doc + 1] - 1
        after = np.where(at + self.window <= last, word(self.hash[np.minimum(at + self.window, len(self.hash) - 1)]), np.uint64(0))
        keys, which, times = np.unique(self.edge[picked], return_inverse=True, return_counts=True)
        load = np.zeros(len(keys), EDGE)
        load["many"] = times > 1
        load["before"], load["after"] = _one(which, before, len(keys)), _one(which, after, len(keys))
        return keys, load, which


def _one(which: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """The value all entries of a key have in common, or ``BRANCH``."""
    low, high = np.full(m, BRANCH, np.uint64), np.zeros(m, np.uint64)
    np.minimum.at(low, which, value)
    np.maximum.at(high, which, value)
    return np.where(low == high, low, np.uint64(BRANCH))


def _texts(table: pa.Table) -> list[tuple[dict, list[bytes]]]:
    return [(r, unpack(r)) for r in table.to_pylist()]


def _degrees(which: np.ndarray, load: np.ndarray, m: int) -> np.ndarray:
    """Bit 0: the edge repeats; bit 1: one word before all its occurrences; bit 2: one after."""
    flags = repeats(which, load["many"], m).astype(np.uint8)
    for bit, side in ((2, "before"), (4, "after")):
        one = _one(which, load[side], m)
        flags |= np.where((one != np.uint64(BRANCH)) & (one != 0), bit, 0).astype(np.uint8)
    return flags


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (its remaining words joined by
    single spaces) and ``spans`` (removed words by number, end exclusive)."""
    spark = docs.sparkSession
    parts = parts_of(spark)
    packed = pack(docs, text, key)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in _texts(pa.Table.from_batches([b])):
                c = Chunk(texts, window, anchor)
                yield key_rows(row["chunk"], c.anchors, (c.times > 1).astype(np.uint8), parts)

    def edges(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, texts in _texts(left):
            c = Chunk(texts, window, anchor)
            keys, load, _which = c.edges(c.candidates(flags_of(right)))
            out.append(key_rows(row["chunk"], keys, load, parts))
        return pa.Table.from_batches(out)

    def walk(_, left: pa.Table, right: pa.Table) -> pa.Table:
        mark = right.column("kind").to_numpy()
        flags = [flags_of(right.filter(pa.array(mark == k))) for k in (0, 1)]
        veto = np.frombuffer(b"".join(right.filter(pa.array(mark == 2)).column("flags").to_pylist()), np.int64)
        return pa.concat_tables([_walk(row, Chunk(texts, window, anchor), *flags, veto) for row, texts in _texts(left)])

    def beside(kind: int, df: DataFrame) -> DataFrame:
        return df.withColumn("kind", F.lit(kind))

    hot_anchors = stored(judge(packed.mapInArrow(anchors, KEYS), np.dtype("u1"), repeats), "anchors")
    edge_rows = packed.groupBy("chunk").cogroup(hot_anchors.groupBy("chunk")).applyInArrow(edges, KEYS)
    hot_edges = stored(judge(edge_rows, EDGE, _degrees), "edges")
    known = beside(0, hot_anchors).unionByName(beside(1, hot_edges))

    def result(extra: DataFrame) -> DataFrame:
        return stored(packed.groupBy("chunk").cogroup(extra.groupBy("chunk")).applyInArrow(walk, OUT), "walks")

    found = result(known)
    false = _unverified(found)
    if not false.isEmpty():
        vetoes = false.groupBy("chunk").agg(F.array_sort(F.collect_set("path")).alias("p"))
        found = result(known.unionByName(beside(2, vetoes.mapInArrow(_veto_rows, FLAGS))))
    return found.filter("path is null").select("doc_id", "n_words", "n_removed", "kept", "spans")


def _veto_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [np.array(p, np.int64).tobytes() for p in b.column("p").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "flags"])


def _unverified(found: DataFrame) -> DataFrame:
    """Paths, by chunk, that do not hold the same words at two source coordinates at least."""
    paths = found.filter("path is not null").select("chunk", "path", "low", "high", "n_removed")
    same = paths.groupBy("path", "low", "high").agg(F.sum("n_removed").alias("n"))
    false = same.groupBy("path").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("n")).filter("kinds > 1 or n < 2").select("path")
    return stored(paths.join(false, "path", "left_semi").select("chunk", "path").distinct(), "unverified")


def _walk(row: dict, c: Chunk, anchor_flags: np.ndarray, edge_flags: np.ndarray, veto: np.ndarray) -> pa.Table:
    """A chunk's documents without their repeated paths, and one row for each distinct path in it."""
    w, window = c.words, c.window
    picked = c.candidates(anchor_flags)
    keys, _, which = c.edges(picked)
    flag = edge_flags[which] if len(keys) else np.empty(0, np.uint8)
    live = flag & 1 > 0
    at, edge, flag = c.at[picked][live], c.edge[picked][live], flag[live]
    # an edge and the next are one path if nothing branches between them
    follows = (np.diff(at) == 1) & (w.doc[at[1:]] == w.doc[at[:-1]]) & (flag[:-1] & 4 > 0) & (flag[1:] & 2 > 0)
    first = np.flatnonzero(np.concatenate(([True], ~follows))) if len(at) else np.empty(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    start, end = at[first], at[last] + window
    path = (edge[first] ^ ((last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    proof: dict[tuple[int, int, int], int] = {}
    for s, e, p in zip(start, end, path.tolist(), strict=True):
        span = b" ".join(w.data[w.start[s] : w.end[e - 1]].tobytes().split())
        digest = hashlib.md5(span).digest()
        k = (p, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
        proof[k] = proof.get(k, 0) + 1
    good = ~np.isin(path, veto)
    windows = np.concatenate([at[f : g + 1] for f, g in zip(first[good], last[good], strict=True)]) if good.any() else at[:0]
    gone = covered(windows, window, len(w.doc))
    removed = np.bincount(w.doc[gone], minlength=len(w.texts))
    kept, spans = [], []
    for i, t in enumerate(w.texts):
        if not removed[i]:
            kept.append(b" ".join(t.split()))
            spans.append([])
            continue
        words, a, b = t.split(), w.first[i], w.first[i + 1]
        stay = ~gone[a:b]
        kept.append(b" ".join([x for x, s in zip(words, stay, strict=True) if s]))
        ends = np.diff(np.concatenate(([0], gone[a:b].astype(np.int8), [0])))
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(ends == 1), np.flatnonzero(ends == -1), strict=True)])
    n, m = len(w.texts), len(proof)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    nothing = lambda k, kind: pa.nulls(k, kind)
    ids = row["doc_id"]
    return pa.table(
        {
            "doc_id": pa.array(ids + [None] * m, pa.int64()),
            "n_words": pa.array([*w.count.tolist(), *[None] * m], pa.int64()),
            "n_removed": pa.array([*removed.tolist(), *proof.values()], pa.int64()),
            "kept": pa.array([k.decode() for k in kept] + [None] * m, pa.string()),
            "spans": pa.array(spans + [None] * m, span_type),
            "chunk": pa.array([row["chunk"]] * (n + m), pa.int64()),
            "path": pa.concat_arrays([nothing(n, pa.int64()), pa.array([k[0] for k in proof], pa.int64())]),
            "low": pa.concat_arrays([nothing(n, pa.int64()), pa.array([k[1] for k in proof], pa.int64())]),
            "high": pa.concat_arrays([nothing(n, pa.int64()), pa.array([k[2] for k in proof], pa.int64())]),
        }
    )
