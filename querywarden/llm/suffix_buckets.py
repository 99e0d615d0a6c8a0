"""Removal of long repeated byte strings by bucket-pointer refinement of suffixes.

A suffix is a byte position; its bucket of depth L holds all suffixes that start with the same L bytes, and a
bucket's identifier of depth 2L is made from those of depth L at the suffix itself and at the later offset L.
So identifiers of any depth come from a few refinements that reuse the ones before; they are 64-bit values
that depend on content only, hence buckets of different chunks can be told apart without ranking all suffixes.

Across chunks, refinement starts from buckets of depth ``GRAM``. To keep them few, a string of ``WIDTH`` bytes is
filed under that one of its q-grams which has the smallest identifier, the first one of these; equal strings
are filed alike. A run is a stretch of neighbouring strings filed under the same q-gram there. First, q-gram buckets are sorted and
refined by the identifiers of their runs' first and last string:

* a bucket with one member is done: none of its strings repeats;
* a run whose whole extent repeats is done: all of its strings do;
* runs that differ share a bucket, but not the extent. Only these are refined to the depth of ``WIDTH``, string by
  string, together with one run for each extent that repeats in the same bucket, which stands for all of its
  kind.

All occurrences are removed, overlapping ones and those in the same document included. Strings never cross
documents. Nulls and texts shorter than ``WIDTH`` lose nothing; a repeated row repeats all its strings. Keys may
be null or repeated; an empty table gives an empty result; other columns play no part. Work inside a chunk goes
by slices, so that a very long text needs memory for its bytes only. With n strings the chance that any two
different ones share an identifier is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import FLAGS, KEYS, flags_of, key_rows, pack, stored, unpack
from querywarden.llm.words import mix

WIDTH, GRAM = 200, 32
#: strings worked on at once: their identifiers of each depth stay in a core's cache
SLICE = 1 << 16
#: bytes of text for each range of identifiers
RANGE_BYTES = 32 << 20
LETTER = mix(np.arange(1, 257, dtype=np.uint64))
ENTRY = np.dtype([("extent", "<u8"), ("many", "u1")])
LONE, WHOLE, SPLIT, STANDS = 0, 1, 2, 3
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _joined(near: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers from those of two buckets each."""
    out = near * np.uint64(0x9E3779B97F4A7C15)
    out += later
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def deeper(ids: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Bucket identifiers of depth ``to`` from those of ``depth``, doubling it and overlapping at the end."""
    while depth < to:
        step = min(depth, to - depth)
        if len(ids) <= step:
            return ids[:0]
        ids = _joined(ids[:-step], ids[step:])
        depth += step
    return ids


def _least(ids: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n, have, out = len(ids) - width + 1, 1, ids
    if n <= 0:
        return ids[:0]
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


class Chunk:
    """Strings and runs of a chunk's texts; a string is named by its first byte."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.width, self.gram, self.texts = width, gram, texts
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        found = [self._runs(lo, hi) for lo, hi in self._slices()]
        self.low, self.high, gram_id, extent = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64 if i > 1 else np.int64) for i in range(4))
        # distinct (q-gram, extent) in order, and the entry of each run
        order = np.lexsort((extent, gram_id))
        g, e = gram_id[order], extent[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.grams = g[fresh]
        self.load = np.zeros(len(self.grams), ENTRY)
        self.load["extent"] = e[fresh]
        self.load["many"] = np.bincount(self.entry, minlength=len(self.grams)) > 1
        self.sample = order[fresh]

    def _slices(self) -> Iterator[tuple[int, int]]:
        for lo in range(0, len(self.data) - self.width + 1, SLICE):
            yield lo, min(lo + SLICE, len(self.data) - self.width + 1)

    def _ids(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of q-grams, and of the strings that start in a slice."""
        grams = deeper(LETTER[self.data[lo : hi + self.width - 1]], 1, self.gram)
        return grams, deeper(grams, self.gram, self.width)

    def _runs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams, strings = self._ids(lo, hi)
        least = _least(grams, self.width - self.gram + 1)
        at = np.arange(lo, hi)
        doc = np.searchsorted(self.end, at, side="right")
        whole = at + self.width <= self.end[doc]
        first = whole.copy()
        # the string before was filed under its own start, or a smaller identifier has come in
        first[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
        low = np.flatnonzero(first)
        high = np.flatnonzero(whole & np.append(~whole[1:] | first[1:], True))
        # the first and the last string of a run meet, so they and their distance are its extent
        extent = _joined(_joined(strings[low], strings[high]), (high - low).astype(np.uint64))
        return low + lo, high + lo, mix(least[low]), extent

    def strings(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and identifiers of the strings of the picked runs (a mask)."""
        low, high = self.low[picked], self.high[picked]
        at, ids = [], []
        for lo, hi in self._slices():
            a, b = np.searchsorted(low, (lo, hi))
            if a < b:
                n = high[a:b] - low[a:b] + 1
                here = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at.append(here)
                ids.append(self._ids(lo, hi)[1][here - lo])
        return (np.concatenate(at), np.concatenate(ids)) if at else (np.empty(0, np.int64), np.empty(0, np.uint64))

    def sent(self, verdict: np.ndarray) -> np.ndarray:
        """Runs whose strings are refined one by one: all that are split, and one that stands for its extent."""
        out = verdict[self.entry] == SPLIT
        out[self.sample[verdict == STANDS]] = True
        return out

    def rest(self, gone: np.ndarray) -> Iterator[tuple[int, int, list, bytes]]:
        """Per text the bytes and spans removed, and what is left."""
        for end, size, text in zip(self.end, self.size, self.texts, strict=True):
            here = gone[end - size : end]
            n = int(here.sum())
            if not n:
                yield 0, 0, [], text
                continue
            edge = np.diff(np.concatenate(([0], here.view(np.int8), [0])))
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            yield n, len(spans), spans, self.data[end - size : end][~here].tobytes()


def sort_buckets(keys: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Verdict on each member (``extent``, ``many``) of the q-gram buckets ``keys``."""
    order = np.lexsort((load["extent"], keys))
    k, e, many = keys[order], load["extent"][order], load["many"][order] > 0
    if not len(k):
        return np.empty(0, np.uint8)
    bucket = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
    fresh = np.append(True, (k[1:] != k[:-1]) | (e[1:] != e[:-1]))
    kind = np.cumsum(fresh) - 1
    repeats = (np.bincount(kind) > 1) | (np.bincount(kind, weights=many) > 0)
    alone = (np.bincount(bucket) == 1) & (np.bincount(bucket, weights=many) == 0)
    split = ~repeats[kind]
    mixed = np.bincount(bucket, weights=split) > 0
    out = np.where(split, SPLIT, np.where(mixed[bucket] & fresh, STANDS, WHOLE))
    out[alone[bucket]] = LONE
    back = np.empty(len(out), np.uint8)
    back[order] = out
    return back


def sort_strings(keys: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Whether each string's identifier occurs twice."""
    _, which = np.unique(keys, return_inverse=True)
    return ((np.bincount(which) > 1) | (np.bincount(which, weights=load) > 0))[which] if len(keys) else np.empty(0, np.uint8)


def refined(keyed: DataFrame, payload: np.dtype, verdict: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A byte for each entry of each chunk, from all chunks' entries in its range of identifiers."""

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        blobs = group.column("keys").to_pylist()
        keys = np.concatenate([np.frombuffer(b, np.uint64, count=int(k)) for b, k in zip(blobs, n, strict=True)])
        load = np.concatenate([np.frombuffer(b, payload, offset=8 * int(k)) for b, k in zip(blobs, n, strict=True)])
        del blobs
        flags, end = verdict(keys, load).astype(np.uint8), np.cumsum(n)
        out = [flags[e - k : e].tobytes() for e, k in zip(end, n, strict=True)]
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "flags": pa.array(out, pa.binary())})

    return keyed.groupBy("part").applyInArrow(run, FLAGS)


def ranges_for(packed: DataFrame, bytes_each: int = RANGE_BYTES) -> int:
    """Ranges of identifiers for stored chunks, by their bytes; no setting plays a part."""
    total = packed.agg(F.sum("raw")).first()[0] or 0
    return max(1, -(-total // bytes_each))


def repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (its remaining bytes) and
    ``spans`` (removed bytes of the text's UTF-8, end exclusive)."""
    packed = pack(docs, text, key)
    ranges = ranges_for(packed, range_bytes)

    def read(table: pa.Table) -> Iterator[tuple[dict, Chunk]]:
        for row in table.to_pylist():
            yield row, Chunk(unpack(row), width, gram)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, c in read(pa.Table.from_batches([b])):
                yield key_rows(row["chunk"], c.grams, c.load, ranges)

    def strings(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, c in read(left):
            keys, times = np.unique(c.strings(c.sent(flags_of(right)))[1], return_counts=True)
            out.append(key_rows(row["chunk"], keys, (times > 1).astype(np.uint8), ranges))
        return pa.Table.from_batches(out)

    def remove(_, left: pa.Table, right: pa.Table) -> pa.Table:
        mark = right.column("kind").to_numpy()
        verdict, twice = (flags_of(right.filter(pa.array(mark == k))) for k in (0, 1))
        return pa.concat_tables([_removed(row, c, verdict, twice) for row, c in read(left)])

    first = stored(refined(packed.mapInArrow(buckets, KEYS), ENTRY, sort_buckets), "buckets")
    keyed = packed.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(strings, KEYS)
    second = stored(refined(keyed, np.dtype("u1"), sort_strings), "strings")
    known = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    return packed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(remove, OUT)


def _removed(row: dict, c: Chunk, verdict: np.ndarray, twice: np.ndarray) -> pa.Table:
    """A chunk's texts without the bytes of repeated strings."""
    edge = np.zeros(len(c.data) + 1, np.int32)

    def cover(low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(edge, low, 1)
        np.add.at(edge, high + c.width, -1)

    flag = verdict[c.entry] if len(c.entry) else np.empty(0, np.uint8)
    whole = (flag == WHOLE) | (flag == STANDS)
    cover(c.low[whole], c.high[whole])
    sent = c.sent(verdict)
    if sent.any():
        at, ids = c.strings(sent)
        # of the strings sent, those of runs that stand for their extent are covered already
        split = np.repeat(flag[sent] == SPLIT, (c.high - c.low + 1)[sent])
        keys = np.unique(ids)
        at = at[split & (twice[np.searchsorted(keys, ids)] > 0)]
        cover(at, at)
    gone = np.cumsum(edge[:-1]) > 0
    found = list(c.rest(gone))
    removed, n_spans, spans, kept = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        {
            "doc_id": pa.array(row["doc_id"], pa.int64()),
            "n_bytes": pa.array(c.size, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(spans, span_type),
        }
    )
