"""Language-model scores of whole texts by a hidden Markov model.

Tokens are a text's words with A-Z in lower case, and one end token. Counts of all words of the training
documents are gathered by an exchange of each chunk's distinct words (by their 64-bit hashes). The model emits word
classes from ``STATES`` latent states: the ``TOP`` most frequent words are classes of their own, others are classed
by their last letters; inside a class a word has its share of the class's counts, smoothed, with one share kept
for words not seen. Transitions and emissions are trained by Baum-Welch: each round every task adds up
expected counts over windows of its training texts, the sums are added across partitions, and the new model, whose
size is fixed, goes out with the next round. A score is the sum of log10 of the scaling factors of the
forward recursion over the whole text: the exact likelihood of the sequence.

A null text is empty: one token, the end. A null key is held out. Repeated rows are scored and counted one
by one; ties among frequent words go by hash. An empty table gives an empty result; without training documents
the model is uniform over classes. Columns other than key and text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.packs import KEYS, flags_of, key_rows, pack, parts_of, stored, unpack
from querywarden.llm.words import Words, mix

FOLDS = 10
STATES, TOP, TAILS = 8, 2048, 1024
ROUNDS, WINDOW = 6, 256
SMOOTH, BASE_SMOOTH, BELIEF = 0.1, 0.1, 50.0
STICKY = 0.9
SLICES = 64
CHUNK = 4 << 20
END = 0
CLASSES = 1 + TOP + TAILS
COUNT = np.dtype([("n", "<u4"), ("tail", "<u2")])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != 0


class Tokens:
    """Words of a chunk: a hash and the class of the last letters for each."""

    def __init__(self, row: dict):
        self.words = w = Words([t.translate(LOWER) for t in unpack(row)])
        self.hash = w.hashes()
        size = w.end - w.start
        code = np.zeros(len(size), np.uint64)
        for k in range(3):
            code |= np.where(size > k, w.data[np.maximum(w.end - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
        self.tail = (mix(code) % np.uint64(TAILS)).astype(np.int64)
        self.train = np.fromiter(map(training, row["doc_id"]), bool, len(row["doc_id"]))
        self.keys, first, self.which = np.unique(self.hash, return_index=True, return_inverse=True)
        self.key_tail = self.tail[first]

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.keys), COUNT)
        out["n"] = np.bincount(self.which[self.train[self.words.doc]], minlength=len(self.keys))
        out["tail"] = self.key_tail
        return out


FREQUENT = np.dtype([("n", "<i8"), ("key", "<u8"), ("tail", "<i4")])
GATHERED = "chunk long, part int, flags binary, tail_n array<long>, tail_v array<long>, top binary"


def _most_frequent(words: np.ndarray) -> np.ndarray:
    return words[np.lexsort((words["key"], -words["n"]))[:TOP]]


def _merge_top(group: pa.Table) -> pa.Table:
    words = np.concatenate([np.frombuffer(b, FREQUENT) for b in group.column("top").to_pylist()])
    return pa.table({"top": pa.array([_most_frequent(words).tobytes()], pa.binary())})


def _gather(group: pa.Table) -> pa.Table:
    """For a range of words: each chunk's words with their whole counts; on the first row what the range adds
    to the classes of last letters, and its most frequent words."""
    n, blobs = group.column("n").to_numpy(), group.column("keys").to_pylist()
    keys = np.concatenate([np.frombuffer(b, np.uint64, count=int(k)) for b, k in zip(blobs, n, strict=True)])
    load = np.concatenate([np.frombuffer(b, COUNT, offset=8 * int(k)) for b, k in zip(blobs, n, strict=True)])
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(which, weights=load["n"], minlength=len(distinct)).astype(np.int64)
    tail = load["tail"][first].astype(np.int64)
    seen = total > 0
    words = np.zeros(len(distinct), FREQUENT)
    words["n"], words["key"], words["tail"] = total, distinct, tail
    top = _most_frequent(words[seen]).tobytes()
    sums = [np.bincount(tail, weights=total, minlength=TAILS).astype(np.int64).tolist(), np.bincount(tail[seen], minlength=TAILS).tolist(), top]
    end, spread, m = np.cumsum(n), total.astype("<u8")[which], len(n)
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table(
        {
            "chunk": group.column("chunk"),
            "part": group.column("part"),
            "flags": pa.array([spread[e - k : e].tobytes() for e, k in zip(end, n, strict=True)], pa.binary()),
            **{name: pa.array([s] + [None] * (m - 1), kind) for name, s, kind in zip(("tail_n", "tail_v", "top"), sums, kinds, strict=True)},
        }
    )


@dataclass
class Lexicon:
    """What the counts say: totals, the frequent words and the classes of last letters."""

    n: int
    v: int
    ends: int
    keys: np.ndarray
    classes: np.ndarray
    tail_n: np.ndarray
    tail_v: np.ndarray

    def encode(self, t: Tokens, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each distinct word of a chunk, and log10 of its share of the class."""
        at = np.minimum(np.searchsorted(self.keys, t.keys), max(len(self.keys) - 1, 0))
        own = self.keys[at] == t.keys if len(self.keys) else np.zeros(len(t.keys), bool)
        share = np.log10((count + SMOOTH) / (self.tail_n[t.key_tail] + SMOOTH * (self.tail_v[t.key_tail] + 1)))
        return np.where(own, self.classes[at] if len(self.keys) else 0, 1 + TOP + t.key_tail), np.where(own, 0.0, share)


def lexicon(gathered: DataFrame, packed: DataFrame) -> Lexicon:
    """The totals; of the frequent words ``SLICES`` lists of ``TOP`` reach the driver at most."""
    sums = gathered.filter("tail_n is not null").select(F.posexplode(F.arrays_zip("tail_n", "tail_v")).alias("tail", "s"))
    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in sums.groupBy("tail").agg(F.sum("s.tail_n").alias("n"), F.sum("s.tail_v").alias("v")).collect():
        tail_n[r.tail], tail_v[r.tail] = r.n, r.v
    words = int(tail_n.sum())
    v = int(tail_v.sum())
    tops = gathered.filter("top is not null").select("top", F.pmod("part", F.lit(SLICES)).alias("slice"))
    lists = [r.top for r in tops.groupBy("slice").applyInArrow(_merge_top, "top binary").collect()]
    top = _most_frequent(np.concatenate([np.empty(0, FREQUENT), *(np.frombuffer(b, FREQUENT) for b in lists)]))
    train = F.pmod(F.crc32(F.coalesce(F.col("d").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) != 0
    ends = packed.select(F.explode("doc_id").alias("d")).filter(F.col("d").isNotNull() & train).count()
    np.subtract.at(tail_n, top["tail"], top["n"])
    np.subtract.at(tail_v, top["tail"], 1)
    keys = top["key"].astype(np.uint64)
    order = np.argsort(keys)
    return Lexicon(words + ends, v + (ends > 0), ends, keys[order], 1 + order, tail_n, tail_v)


CODED = "chunk long, doc_id array<long>, n_tokens array<long>, n_known array<long>, base array<double>, share array<double>, raw long, codes binary"


def _coded(row: dict, count: np.ndarray, lex: Lexicon) -> pa.RecordBatch:
    """A chunk's texts as classes, end tokens included, with each text's known words and fixed parts of scores."""
    t = Tokens(row)
    n_docs, doc = len(t.words.texts), t.words.doc
    kind, share = lex.encode(t, count)
    floor = lex.n + BASE_SMOOTH * (lex.v + 1)
    base = np.log10((count + BASE_SMOOTH) / floor)
    per = lambda x, start: start + np.bincount(doc, weights=x[t.which], minlength=n_docs)
    size = t.words.count + 1
    codes = np.full(int(size.sum()), END, np.uint16)
    codes[np.arange(len(doc)) + doc] = kind[t.which]
    raw = codes.tobytes()
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["chunk"]], pa.int64()),
            one(row["doc_id"], pa.int64()),
            one(size.tolist(), pa.int64()),
            one((per((count > 0).astype(float), 0) + (lex.ends > 0)).astype(np.int64).tolist(), pa.int64()),
            one(per(base, np.log10((lex.ends + BASE_SMOOTH) / floor)).tolist(), pa.float64()),
            one(per(share, 0).tolist(), pa.float64()),
            pa.array([len(raw)], pa.int64()),
            pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()),
        ],
        ["chunk", "doc_id", "n_tokens", "n_known", "base", "share", "raw", "codes"],
    )


@dataclass
class Model:
    """Start, transition and emission probabilities; emissions by class, then state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(weights: np.ndarray) -> Model:
    """States that tend to stay, with the classes' shares shifted at random in each."""
    rng = np.random.default_rng(7)
    emit = (weights[:, None] + 1e-9) * rng.uniform(0.2, 1.8, (CLASSES, STATES))
    move = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(move, STICKY)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _codes(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["codes"], decompressed_size=row["raw"], codec="zstd", asbytes=True) if row["raw"] else b"", np.uint16)


def expected(codes: np.ndarray, first: np.ndarray, size: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over windows, and the windows' log-likelihood.

    A window that does not begin a text starts from the states' long-run shares.
    """
    at = np.concatenate([np.arange(f, f + n, WINDOW) for f, n in zip(first, size, strict=True)])
    end = np.minimum(at + WINDOW, np.repeat(first + size, -(-size // WINDOW)))
    opens = np.isin(at, first)
    order = np.argsort(at - end, kind="stable")
    at, end, opens = at[order], end[order], opens[order]
    length = end - at
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
    long_run = np.linalg.matrix_power(m.move, 64)[0].astype(np.float32)
    seen = [emit[codes[at[:k] + t]] for t, k in enumerate(active)]
    forward, scale = [], []
    a = np.where(opens[:, None], m.start.astype(np.float32), long_run)
    for t, k in enumerate(active):
        a = (a[:k] if t == 0 else a[:k] @ move) * seen[t]
        c = a.sum(1, keepdims=True) + np.float32(1e-30)
        a = a / c
        forward.append(a)
        scale.append(c)
    starts, moves, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    gamma = [None] * steps
    back = np.ones((active[-1], STATES), np.float32)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if t < steps - 1:
            nxt = active[t + 1]
            ahead = seen[t + 1] * back / scale[t + 1]
            moves += forward[t][:nxt].T @ ahead
            back = np.concatenate((ahead @ move.T, np.ones((k - nxt, STATES), np.float32)))
        g = forward[t] * back
        gamma[t] = g / (g.sum(1, keepdims=True) + np.float32(1e-30))
    starts += gamma[0][opens].sum(0)
    flat = np.concatenate([codes[at[:k] + t] for t, k in enumerate(active)])
    weights = np.concatenate(gamma)
    for s in range(STATES):
        emitted[:, s] = np.bincount(flat, weights=weights[:, s], minlength=CLASSES)
    return starts, moves * m.move, emitted, float(sum(np.log(c).sum() for c in scale))


def likelihoods(codes: np.ndarray, size: np.ndarray, m: Model) -> np.ndarray:
    """log10 of the probability of each text, by the scaled forward recursion over all its tokens."""
    out = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    total = np.zeros(len(size))
    a = np.tile(m.start, (len(size), 1))
    for t, k in enumerate(active):
        a = (a[:k] if t == 0 else a[:k] @ m.move) * m.emit[codes[first[:k] + t]]
        c = a.sum(1)
        a /= c[:, None]
        total[:k] += np.log10(c)
    out[order] = total
    return out


COUNTS = "state int, slice int, log double, sums binary"


def _add(group: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(b, np.float64) for b in group.column("sums").to_pylist())
    log = float(np.sum(group.column("log").to_numpy()))
    row = [group.column(c)[0].as_py() for c in ("state", "slice")]
    return pa.table({"state": pa.array([row[0]], pa.int32()), "slice": pa.array([row[1]], pa.int32()), "log": pa.array([log]), "sums": pa.array([sums.tobytes()], pa.binary())})


def improve(coded: DataFrame, m: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over all training texts; also their log-likelihood under ``m``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emitted, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
        some = False
        for b in batches:
            for row in b.to_pylist():
                size = np.array(row["n_tokens"], np.int64)
                first = np.cumsum(size) - size
                train = np.fromiter(map(training, row["doc_id"]), bool, len(size))
                if train.any():
                    s, v, e, x = expected(_codes(row), first[train], size[train], m)
                    starts, moves, emitted, log, some = starts + s, moves + v, emitted + e, log + x, True
        if some:
            sums = [np.concatenate(([starts[k]], moves[k], emitted[:, k])).tobytes() for k in range(STATES)]
            part = TaskContext.get().partitionId() % SLICES
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(STATES), pa.int32()), pa.array([part] * STATES, pa.int32()), pa.array([log / STATES] * STATES), pa.array(sums, pa.binary())],
                ["state", "slice", "log", "sums"],
            )

    rows = coded.select("doc_id", "n_tokens", "raw", "codes").mapInArrow(run, COUNTS)
    added = rows.groupBy("state", "slice").applyInArrow(_add, COUNTS).groupBy("state").applyInArrow(_add, COUNTS).collect()
    if not added:
        return m, 0.0
    sums = np.stack([np.frombuffer(r.sums, np.float64) for r in sorted(added, key=lambda r: r.state)])
    starts, moves, emitted = sums[:, 0] + 1, sums[:, 1 : 1 + STATES] + 1, sums[:, 1 + STATES :].T
    shares = (emitted.sum(1) + 0.5) / (emitted.sum() + 0.5 * CLASSES)
    emitted = emitted + BELIEF * shares[:, None]
    return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(0)), sum(r.log for r in added)


def train(coded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    weights = np.full(CLASSES, 1.0)
    weights[1 + TOP :] += lex.tail_n
    weights[END] += lex.ends
    if len(lex.keys):
        weights[1 : 1 + TOP] += (lex.n - lex.ends - lex.tail_n.sum()) / len(lex.keys) / np.maximum(np.arange(TOP) + 1, 1) ** 0.5
    m = first_model(weights / weights.sum())
    for _ in range(rounds):
        m, _log = improve(coded, m)
    return m


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    parts = parts_of(docs.sparkSession)
    packed = pack(docs, text, key, CHUNK)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Tokens(row)
                yield key_rows(row["chunk"], t.keys, t.counts(), parts)

    gathered = stored(packed.mapInArrow(words, KEYS).groupBy("part").applyInArrow(_gather, GATHERED), "words")
    lex = lexicon(gathered, packed)

    def code(_, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_coded(row, flags_of(right, "<u8").astype(np.float64), lex) for row in left.to_pylist()])

    counts = gathered.select("chunk", "part", "flags")
    coded = stored(packed.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(code, CODED), "coded")
    m = train(coded, lex, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                size = np.array(row["n_tokens"], np.int64)
                whole = likelihoods(_codes(row), size, m) + np.array(row["share"])
                held = [not training(d) for d in row["doc_id"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(held), pa.array(size), pa.array(row["n_known"], pa.int64()),
                     pa.array([lex.n] * len(size), pa.int64()), pa.array(row["base"], pa.float64()), pa.array(whole)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
