"""Exact nearest neighbours by cosine for two large sets, with an index that skips blocks of pairs.

Vectors are laid out in blocks of about equal size: by the nearest of a fixed number of pivots (cell), then by
the angle to it (ring). A block knows the least and the largest angle of its vectors to some of the pivots. By
the triangle inequality two vectors differ by at least the difference of their angles to any pivot; so a pair of
blocks whose ranges lie further apart than the similarity asked for allows is skipped. Ranges are compared at
two levels: groups of neighbouring blocks first, of which there are at most ``GROUPS`` a side, then the blocks of
the groups that are left. A task multiplies one pair of blocks and hands on the best ``k`` for each query.

The driver sees the pivots, a count for each cell and ring, and the ranges of the groups: numbers that do not
grow with the data. At worst, on vectors without clusters, nothing is skipped: then each block travels once
for every block of the other side, and all pairs are multiplied, as any exact answer has to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.operators.ranking import top_n
from querywarden.session import cut_lineage

TOP_K = 3
MIN_SIMILARITY = 0.5
PIVOTS, BOUNDS, RINGS, GROUPS = 64, 16, 64, 256
BLOCK_ROWS = 8192
#: rows of a block that are multiplied at once
STRIP = 512
#: values of a row that share a maximum
PART = 32
PLACED = "id long, embedding array<float>, cell int, ring int, angles array<float>"
PAIRED = "query_id long, entry_id long, similarity double"
#: slack for angles kept in single precision
SLACK = 1e-5


def _unit(values: pd.Series) -> np.ndarray:
    mat = np.asarray(values.tolist(), dtype=np.float64)
    norm = np.linalg.norm(mat, axis=1, keepdims=True)
    return mat / np.where(norm == 0, 1.0, norm)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors (``id, embedding``; null ones left out) with cell, ring and angles to the first pivots, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                angles = _angle(_unit(b["embedding"]) @ centres.T)
                cell = angles.argmin(axis=1)
                ring = np.minimum((angles[np.arange(len(b)), cell] * (RINGS / math.pi)).astype(int), RINGS - 1)
                yield pd.DataFrame({"id": b["id"], "embedding": b["embedding"], "cell": cell, "ring": ring, "angles": list(angles[:, :BOUNDS].astype(np.float32))})

    return cut_lineage(vectors.select("id", "embedding").filter("embedding is not null").mapInPandas(run, PLACED), "vectors")


def layout(counts: list[tuple[int, int, int]], block_rows: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``cell, ring, start, pieces``: the first block of each ring and over how many it spreads; and the number of blocks.

    Small neighbouring rings share a block, large ones are cut.
    """
    out, block, filled = [], -1, block_rows
    for cell, ring, n in sorted(counts):
        if n >= block_rows:
            pieces = math.ceil(n / block_rows)
            out.append((cell, ring, block + 1, pieces))
            block, filled = block + pieces, block_rows
            continue
        if filled + n > block_rows:
            block, filled = block + 1, 0
        out.append((cell, ring, block, 1))
        filled += n
    return out, block + 1


def blocked(vectors: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """``id, embedding, angles, block`` of placed vectors, and the number of blocks."""
    counts = [tuple(r) for r in vectors.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()]
    rings, blocks = layout(counts, block_rows)
    where = vectors.sparkSession.createDataFrame(rings, "cell int, ring int, start int, pieces int")
    block = F.col("start") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    return vectors.join(where, ["cell", "ring"]).select("id", "embedding", "angles", block.alias("block")), blocks


def ranges(vectors: DataFrame, blocks: int, bounds: int) -> DataFrame:
    """``block, grp`` (a group of neighbouring blocks) and ``lo, hi``, the angles' ranges."""
    side = lambda f, name: F.array(*[f(F.col("angles")[i]) for i in range(bounds)]).alias(name)
    found = vectors.groupBy("block").agg(side(F.min, "lo"), side(F.max, "hi"))
    return found.withColumn("grp", F.floor(F.col("block") * min(GROUPS, blocks) / blocks).cast("int"))


def near_blocks(queries: DataFrame, entries: DataFrame, reach: float) -> DataFrame:
    """``qb, eb``: the pairs of blocks (see ``ranges``) that may hold vectors within the angle ``reach``."""

    def groups(df: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
        n = len(df.first()["lo"])
        rows = df.groupBy("grp").agg(*[F.min(F.col("lo")[i]) for i in range(n)], *[F.max(F.col("hi")[i]) for i in range(n)]).collect()
        mat = np.array([list(r)[1:] for r in rows], dtype=np.float64)
        return [r["grp"] for r in rows], mat[:, :n], mat[:, n:]

    q, qlo, qhi = groups(queries)
    e, elo, ehi = groups(entries)
    pairs = []
    for g, lo, hi in zip(q, qlo, qhi, strict=True):
        gap = np.maximum(elo - hi, lo - ehi).max(axis=1)
        pairs += [(g, e[i]) for i in np.flatnonzero(gap <= reach)]
    left = queries.select(F.col("grp").alias("qg"), F.col("block").alias("qb"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    right = entries.select(F.col("grp").alias("eg"), F.col("block").alias("eb"), F.col("lo").alias("elo"), F.col("hi").alias("ehi"))
    both = queries.sparkSession.createDataFrame(pairs, "qg int, eg int").join(left, "qg").join(right, "eg")
    apart = F.arrays_zip("qlo", "qhi", "elo", "ehi")
    far = F.exists(apart, lambda x: (x["elo"] - x["qhi"] > reach) | (x["qlo"] - x["ehi"] > reach))
    return both.filter(~far).select("qb", "eb")


def _hopeful(cos: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, in any order, of values >= ``least`` that hold the ``k`` largest of each row.

    The ``k``-th largest maximum of parts of a row is reached by ``k`` values. Maxima of ``PART`` values that stand
    ``width`` apart cost a fraction of a partition of the row, and only parts whose maximum gets there are looked at.
    """
    rows, width = len(cos), cos.shape[1] // PART
    if width > k:
        body, tail = cos[:, : width * PART].reshape(rows, PART, width), cos[:, width * PART :]
        tops = np.maximum.reduce(body, axis=1)
        if not (np.isnan(tops).any() or np.isnan(tail).any()):
            floor = np.maximum(np.partition(tops, -k, axis=1)[:, -k], least)
            row, part = np.nonzero(tops >= floor[:, None])
            hit, nth = np.nonzero(body[row, :, part] >= floor[row, None])
            more, end = np.nonzero(tail >= floor[:, None])
            return np.concatenate([row[hit], more]), np.concatenate([nth * width + part[hit], width * PART + end])
    floor = np.full(rows, least)
    if cos.shape[1] > k:
        floor = np.maximum(floor, np.partition(cos, -k, axis=1)[:, -k])
    return np.nonzero(cos >= floor[:, None])


def _best(k: int, min_similarity: float, skip_self: bool):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            # ties go to the lower id: candidates are kept in id order, and sorts are stable
            c = c.sort_values("entry_id", kind="stable")
            ids, mat, asks = c["entry_id"].to_numpy(), _unit(c["vector"]), q["query_id"].to_numpy()
            vectors = _unit(q["vector"])
            for at in range(0, len(q), STRIP):
                cos = vectors[at : at + STRIP] @ mat.T
                if skip_self:
                    cos[asks[at : at + STRIP, None] == ids[None, :]] = -2.0
                row, col = _hopeful(cos, k, min_similarity)
                value = cos[row, col]
                order = np.lexsort((col, -value, row))
                row, col, value = row[order], col[order], value[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = nth < k
                out.append((asks[at + row[keep]], ids[col[keep]], value[keep]))
        query, entry, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"query_id": query, "entry_id": entry, "similarity": value})

    return run


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    skip_self: bool = False,
) -> DataFrame:
    """``query_id, entry_id, similarity, rank``: the ``k`` most similar entries with cosine >= the minimum, exactly.

    Inputs are (id, embedding); ids are distinct. Null vectors have no neighbours. Ties go to the lower id.
    ``skip_self`` leaves out entries with the query's own id. Pivots are the entries with the lowest hash.
    """
    chosen = corpus.filter("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").collect()
    if not chosen:
        return queries.select(
            F.col("id").alias("query_id"), F.col("id").alias("entry_id"),
            F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"),
        ).limit(0)
    centres = _unit(pd.Series([r.embedding for r in chosen]))
    entries, n_entries = blocked(placed(corpus, centres), block_rows)
    asks, n_asks = (entries, n_entries) if queries is corpus else blocked(placed(queries, centres), block_rows)
    order = [F.col("similarity").desc(), F.col("entry_id")]
    nothing = queries.sparkSession.createDataFrame([], PAIRED)
    if not n_asks:
        return top_n(nothing, ["query_id"], order, k, "entry_id")
    bounds = min(BOUNDS, len(chosen))
    of_entries = cut_lineage(ranges(entries, n_entries, bounds), "blocks")
    of_asks = of_entries if queries is corpus else cut_lineage(ranges(asks, n_asks, bounds), "blocks")
    reach = math.acos(max(-1.0, min(1.0, min_similarity))) + SLACK
    pairs = cut_lineage(near_blocks(of_asks, of_entries, reach), "block-pairs")
    keys = ["qb", "eb"]
    # each side has names and columns of its own, as both may be the same vectors
    left = asks.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.col("block").alias("qb")).join(pairs, "qb")
    there = pairs.select(*[F.col(c).alias(c) for c in keys])
    right = entries.select(F.col("id").alias("entry_id"), F.col("embedding").alias("vector"), F.col("block").alias("eb")).join(there, "eb")
    right = right.select("entry_id", "vector", *[F.col(c).alias(c) for c in keys])
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k, min_similarity, skip_self), PAIRED)
    return top_n(partial, ["query_id"], order, k, "entry_id")
