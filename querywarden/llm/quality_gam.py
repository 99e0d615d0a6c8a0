"""Document quality by a generalised additive model with pairwise interactions.

Features are counts and ratios of a whole text. The model is a sum of lookup tables, one per feature and one
per chosen pair of features, learned by cyclic boosting: round after round, each table in turn gets a shallow
tree fitted to the gradient of the log-loss. A score adds the entries of a document's bins.

The model is fitted on at most about ``SAMPLE`` labelled rows, chosen by hash; features and scores cover all
rows and whole texts. Null and empty texts have all features 0 and a score like others. A null key counts as
held out; labels of a key given twice count as 1 if one of them is. Ties in a split go to the lower bin. With no
labels the score is 0.5. An empty table gives an empty result; no column of the input but key and text is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import stored
from querywarden.llm.words import WHITE, Words, chunks, text_bytes

SAMPLE = 50_000
FOLDS, THRESHOLD = 5, 0.3
BINS, COARSE, PAIRS = 64, 8, 10
ROUNDS, RATE, LEAF = 60, 0.2, 25.0
FEATURES = [
    "log_words", "word_length", "distinct_words", "repeated_words", "repeated_lines", "upper", "digits", "symbols", "pipes",
    "full_stops", "exclaims", "commas", "odd_ends", "wide", "line_words", "capital_starts",
]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
SYMBOL, PIPE, STOP, SHOUT, COMMA = map(_flags, (b"#*$%&<>=_{}[]~^\\@", b"|", b".", b"!?", b",;:"))
LETTER = _flags(bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(128, 256)))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    w = Words(texts)
    n, data = len(texts), w.data

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[w.doc_end] - sums[w.doc_start]).astype(float)

    words = w.count.astype(float)
    some = np.maximum(words, 1)
    chars = np.maximum(total(~WHITE[data]), 1)
    h = w.hashes()
    pair = _distinct(w.doc, h, n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    last, first = data[w.end - 1], data[w.start]
    odd = ~(LETTER | DIGIT | STOP | COMMA | _flags(b")\"'?!"))[last] | ((w.end - w.start > 2) & SHOUT[last] & SHOUT[data[np.maximum(w.end - 2, 0)]])
    per = lambda flag: np.bincount(w.doc[flag], minlength=n).astype(float)
    lines = np.array([len(x) for x in (t.split(b"\n") for t in texts)], float)
    distinct_lines = np.array([len(set(t.split(b"\n"))) for t in texts], float)
    columns = [
        np.log1p(words), chars / some, pair / some, per(again) / some, 1 - distinct_lines / np.maximum(lines, 1), total(UPPER[data]) / chars,
        total(DIGIT[data]) / chars, total(SYMBOL[data]) / chars, total(PIPE[data]) / some, total(STOP[data]) / some, total(SHOUT[data]) / some,
        total(COMMA[data]) / some, per(odd) / some, total(data >= 128) / chars, np.log1p(words / np.maximum(lines, 1)), per(UPPER[first]) / some,
    ]
    out = np.stack(columns, axis=1) if n else np.empty((0, len(FEATURES)))
    out[w.count == 0] = 0
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


@dataclass
class Gam:
    """Cut points, lookup tables and chosen pairs; bins of a feature are numbered by its cut points."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for b, table in zip(self.bins(x, self.cuts), self.tables, strict=True):
            out += table[b]
        b = self.bins(x, self.coarse)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[b[i], b[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of a cut of ordered bins with gradient and weight sums, and the cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 0) & (hr > 0), gl**2 / (hl + LEAF) + gr**2 / (hr + LEAF) - g.sum() ** 2 / (h.sum() + LEAF), -np.inf)
    if not len(gain):
        return -np.inf, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values of a shallow tree on ordered bins."""
    gain, at = _split(g, h) if depth else (-np.inf, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + LEAF))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree on two features: a cut of one, then one of the other on each side."""
    best, value = -np.inf, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, a.shape[0]):
            sides = [(a[:at].sum(0), b[:at].sum(0)), (a[at:].sum(0), b[at:].sum(0))]
            trees = [_tree(x, y, 1) for x, y in sides]
            gain = sum(float((2 * t * x - t**2 * (y + LEAF / len(t))).sum()) for t, (x, y) in zip(trees, sides, strict=True))
            if gain > best:
                grid = np.concatenate([np.tile(t, (k, 1)) for t, k in zip(trees, (at, a.shape[0] - at), strict=True)])
                best, value = gain, grid.T if turn else grid
    return best, value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    """Tables of single features first, then those of the pairs that promise most."""
    model = Gam()
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    quantiles = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
    model.cuts, model.coarse = quantiles(BINS), quantiles(COARSE)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins, coarse = model.bins(x, model.cuts), model.bins(x, model.coarse)
    f = np.full(len(y), model.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            g, h = slope()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), 2)
            table += step
            f += step[b]
    sizes = [len(c) + 1 for c in model.coarse]

    def grid(v: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slope()
    gains = [(_pair_tree(grid(g, i, j), grid(h, i, j))[0], i, j) for i in range(len(sizes)) for j in range(i)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            step = RATE * _pair_tree(grid(g, i, j), grid(h, i, j))[1]
            table += step
            f += step[coarse[i], coarse[j]]
    return model


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``x``, the features of each whole text, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            x = features(text_bytes(part.column("_text")))
            flat = pa.array(x.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return stored(rows.mapInArrow(run, "doc_id long, x array<float>"), "features")


def training_rows(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``sample`` labelled rows that are not held out, or of all if there are fewer."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    usable = rows.withColumn("held_out", held_out()).filter("not held_out").join(known, "doc_id")
    total = usable.count()
    share = min(1.0, sample / max(total, 1))
    part = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else usable
    got = part.select("x", "y").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)
    return x[order], got["y"].to_numpy(float)[order]


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``; ``labels`` has ``doc_id, quality``."""
    rows = measured(docs, text, key)
    model = fit(*training_rows(rows, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
