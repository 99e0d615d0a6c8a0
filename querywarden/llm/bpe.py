"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A text of at most ``LEAF`` code points is encoded in one go. A longer one is cut into leaves of that
length, which tasks encode in parallel; then halves are joined, level by level. At a join the tokens around
the cut are decoded and encoded again as one window. It grows until both sides agree: its first token starts
where a piece of the left half starts that the cut cannot have touched, and it has a piece boundary in common
with the right half. From there on the right half's tokens are those of the whole text, for the pieces a text
is split into depend on what follows a boundary only. Inside one long run of letters, which has no boundary, the
window is accepted when its first and last tokens are those of the halves: a sequence in which every two
neighbours stand as in an encoding of their own is the encoding of the whole run.

A token sequence is ``ids``, little-endian unsigned 32-bit integers. Null is encoded as the empty text; its
``ids`` are empty. Repeated rows are encoded one by one, extra columns pass through, an empty table gives
an empty one. Texts are whole at any length.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywarden.llm.words import chunks, keeper

LEAF = 16384
#: bytes on either side of a window that a cut may have touched (special tokens, look-ahead)
MARGIN = 96
#: marks a token that starts a piece; ids stay below
FIRST = np.uint32(1 << 31)
BATCH_BYTES = 1 << 20


def tokenizer_json(path: str) -> str:
    """The tokenizer file; read where the query is built and sent along, its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _load(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_padding()
    t.no_truncation()
    return t


class Coder:
    """Encodes with piece starts marked and joins encodings."""

    def __init__(self, spec: str):
        self.t = _load(spec)
        size = self.t.get_vocab_size(with_added_tokens=True)
        to_byte = _byte_letters()
        added = {i: a.content.encode() for i, a in self.t.get_added_tokens_decoder().items()}
        self.bytes = [added.get(i) or bytes(to_byte[c] for c in self.t.id_to_token(i)) for i in range(size)]
        self.size = np.fromiter(map(len, self.bytes), dtype=np.int64, count=size)
        self.ranks, self.special, self.special_id = _by_ranks(json.loads(spec), self.bytes)

    def marked(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, those that start a piece marked."""
        out = []
        for e in self.t.encode_batch(texts, add_special_tokens=False):
            ids = np.array(e.ids, dtype=np.uint32)
            piece = np.array(e.word_ids, dtype=np.int64)
            ids[np.diff(piece, prepend=-1) != 0] |= FIRST
            out.append(ids)
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts of Latin-1 letters go through the faster coder for ranks, if there is one."""
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            try:
                x.encode("latin-1")
                out[i] = self._ranked(x)
            except UnicodeEncodeError:
                pass
            if out[i] is None:
                rest.append(i)
        for i, e in zip(rest, self.t.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _ranked(self, text: str) -> bytes | None:
        if self.ranks is None:
            return None
        ids = []
        for n, part in enumerate(text.split(self.special)):
            if n:
                ids.append(self.special_id)
            ids += self.ranks.encode_ordinary(part)
        return array("I", ids).tobytes()

    def decoded(self, ids: bytes) -> str:
        """The text of unmarked ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        table = self.bytes
        return b"".join([table[i] for i in array("I", ids)]).decode("utf-8", "replace")

    def text(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes[i] for i in ids & ~FIRST).decode("utf-8")

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.size[ids & ~FIRST]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The encoding of the two texts in a row, from the encodings of each."""
        if not len(a) or not len(b):
            return np.concatenate((a, b))
        inside = self._join_run(a, b)
        if inside is not None:
            return inside
        a_left = np.cumsum(self.sizes(a)[::-1])[::-1]  # bytes from each token to the end
        b_before = np.cumsum(self.sizes(b)) - self.sizes(b)
        a_first, b_first = np.flatnonzero(a & FIRST), np.flatnonzero(b & FIRST)
        left, right = MARGIN, 2 * MARGIN
        while True:
            far = a_first[a_left[a_first] >= left]
            i = int(far[-1]) if len(far) else 0
            near = b_first[b_before[b_first] >= right]
            j = int(near[0]) if len(near) else len(b)
            w = self.marked([self.text(np.concatenate((a[i:], b[:j])))])[0]
            if j == len(b):
                return np.concatenate((a[:i], w))
            w_before = np.cumsum(self.sizes(w)) - self.sizes(w) - a_left[i]
            w_first = np.flatnonzero(w & FIRST)
            ok = w_first[(w_before[w_first] >= 0) & (w_before[w_first] <= b_before[j] - MARGIN)]
            common = np.intersect1d(w_before[ok], b_before[b_first])
            if len(common):
                k = ok[np.searchsorted(w_before[ok], common[0])]
                m = b_first[np.searchsorted(b_before[b_first], common[0])]
                return np.concatenate((a[:i], w[:k], b[m:]))
            left, right = 2 * left, 4 * right

    def _join_run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """The join if the cut lies inside a run of letters too long for a window, else None."""
        p = int(np.flatnonzero(a & FIRST)[-1])
        later = np.flatnonzero(b[1:] & FIRST)
        q = int(later[0]) + 1 if len(later) else len(b)
        if min(self.sizes(a[p:]).sum(), self.sizes(b[:q]).sum()) < 8 * MARGIN:
            return None
        try:
            left, right = self.text(a[p:]), self.text(b[:q])
        except UnicodeDecodeError:
            return None
        if not (left.removeprefix(" ").isalpha() and right.isalpha()):
            return None
        width = 8
        while True:
            i, j = max(p, len(a) - width), min(q, width)
            try:
                window = self.text(np.concatenate((a[i:], b[:j])))
            except UnicodeDecodeError:  # it cuts a character
                window = None
            if window is not None or (i == p and j == q):
                w = self.marked([window])[0]
                ends = w[0] & ~FIRST == a[i] & ~FIRST or i == p, w[-1] & ~FIRST == b[j - 1] & ~FIRST or j == q
                one_piece = not (w[1:] & FIRST).any()
                if one_piece and all(ends):
                    w = w & ~FIRST
                    w[0] |= a[i] & FIRST
                    tail = b[j:].copy()
                    return np.concatenate((a[:i], w, tail))
            if i == p and j == q:
                return None
            width += width // 2

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The leaves joined pairwise, level by level."""
        while len(leaves) > 1:
            pairs = zip(leaves[::2], leaves[1::2], strict=False)
            leaves = [self.join(a, b) for a, b in pairs] + leaves[len(leaves) // 2 * 2 :]
        return leaves[0]


def _by_ranks(spec: dict, tokens: list[bytes]):
    """A coder for the same vocabulary whose merges are ranked by id, its special token and that token's id.

    None if the file is not of that kind: byte-level pieces by the usual pattern, no normaliser, one special
    token, merges in the order of their ids.
    """
    import public_tokenizers
    import tiktoken

    pieces, model, added = spec["pre_tokenizer"], spec["model"], spec["added_tokens"]
    if spec["normalizer"] or pieces["type"] != "ByteLevel" or pieces["add_prefix_space"] or not pieces["use_regex"] or len(added) != 1:
        return None, "", -1
    if any(added[0][k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None, "", -1
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) < len(merged):
        return None, "", -1
    ranks = {t: i for i, t in enumerate(tokens) if i != added[0]["id"]}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder, added[0]["content"], added[0]["id"]


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _coder(spec: str) -> Coder:
    return Coder(spec)


def _forget() -> None:
    _coder.cache_clear()
    _load.cache_clear()


keeper(_forget)


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", keep_text: bool = False, leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column ``ids``; ``tokenizer`` is the content of a tokenizers file.

    A text's leaves are brought together again by the row's number, which one pass gives and uses, so ``docs`` must
    be a stored table or otherwise give the same rows in the same order when a task is repeated.
    """
    others = [c for c in docs.columns if c != "ids" and (keep_text or c != text)]
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"in_{c}") for c in others])
    size = F.length("_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for part in chunks(batches, "_text", BATCH_BYTES):
            ids = pa.array(coder.plain(part.column("_text").to_pylist()), pa.binary())
            passed = [part.column(f"in_{c}") for c in others]
            yield pa.RecordBatch.from_arrays([*passed, ids], [*[f"in_{c}" for c in others], "_ids"])

    passing = [f for f in rows.schema if f.name != "_text"]
    short = rows.filter(size <= leaf).mapInArrow(encode, T.StructType([*passing, T.StructField("_ids", T.BinaryType())]))
    long = _encode_long(rows.withColumn("_row", F.monotonically_increasing_id()).filter(size > leaf), spec, others, leaf)
    both = short.unionByName(long)
    return both.select(*[F.col(f"in_{c}").alias(c) for c in others], F.col("_ids").alias("ids"))


def _encode_long(rows: DataFrame, spec, others: list[str], leaf: int) -> DataFrame:
    """Rows of long texts with their ids. A row's number is used within this one pass only: the row's other columns
    travel with its first leaf."""
    names = [f"in_{c}" for c in others]
    passing = [f for f in rows.schema if f.name in names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            for i, (row, text) in enumerate(zip(part.column("_row").to_pylist(), part.column("_text").to_pylist(), strict=True)):
                pieces = [text[at : at + leaf] for at in range(0, len(text), leaf)]
                own = [part.column(c).slice(i, 1) for c in names]
                own = [pa.concat_arrays([c, pa.nulls(len(pieces) - 1, c.type)]) for c in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string()), *own],
                    ["_row", "_at", "_text", *names],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for part in chunks(batches, "_text", BATCH_BYTES):
            ids = [x.astype("<u4").tobytes() for x in coder.marked(part.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_at"), pa.array(ids, pa.binary()), *[part.column(c) for c in names]], ["_row", "_at", "_ids", *names])

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("_at").to_numpy())
        leaves = group.column("_ids").combine_chunks()
        whole = _coder(spec.value).tree([np.frombuffer(leaves[int(i)].as_py(), dtype="<u4") for i in order])
        ids = (whole & ~FIRST).astype("<u4").tobytes()
        return group.select(names).slice(int(order[0]), 1).append_column("_ids", pa.array([ids], pa.binary()))

    number, place, ids = T.StructField("_row", T.LongType()), T.StructField("_at", T.IntegerType()), T.StructField("_ids", T.BinaryType())
    free = [T.StructField(f.name, f.dataType) for f in passing]
    leaves = rows.mapInArrow(cut, T.StructType([number, place, T.StructField("_text", T.StringType()), *free]))
    encoded = leaves.repartition("_row", "_at").mapInArrow(encode, T.StructType([number, place, ids, *free]))
    return encoded.groupBy("_row").applyInArrow(join, T.StructType([*free, ids]))


def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``, special tokens included; null ``ids`` give the empty text."""
    others = [c for c in encoded.columns if c != "decoded"]
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    rows = encoded.select(F.coalesce(F.col(ids), F.lit(b"")).alias("_text"), *[F.col(c).alias(f"in_{c}") for c in others])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for part in chunks(batches, "_text", BATCH_BYTES):
            texts = [coder.decoded(x) for x in part.column("_text").to_pylist()]
            passed = [part.column(f"in_{c}") for c in others]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, pa.string())], [*[f"in_{c}" for c in others], "decoded"])

    schema = T.StructType([f for f in rows.schema if f.name != "_text"] + [T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(decode, schema).select(*[F.col(f"in_{c}").alias(c) for c in others], "decoded")
