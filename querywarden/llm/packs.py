"""Texts packed into compressed chunks, and an exchange that tells each chunk which of its keys repeat.

A chunk is a few megabytes of consecutive rows. It goes through a shuffle as one compressed row, and its
keys (hashes of words or word runs) go as packed arrays, one for each range of keys. A key is sent once per
chunk, whatever its number of occurrences, so a frequent key costs no more than one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.words import chunks, text_bytes
from querywarden.session import scratch_dir, ship_code

PACK = "chunk long, doc_id array<long>, size array<long>, raw long, blob binary"
KEYS = "part int, chunk long, n int, keys binary"
FLAGS = "chunk long, part int, flags binary"
CHUNK_BYTES = 2 << 20
#: a row is numbered by its chunk and its place there; a chunk by its task and its place there
ROW_BITS = 20
#: the column of row numbers in stored tables
ROW = "_querywarden_row"


BATCH = "4m"


def prepare(spark) -> None:
    """What the operators need of a session: this package on the executors, and texts sent to Python in small batches."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder with a denser compression, and read back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _aside(columns: list[str]) -> str:
    """A name for an input column that is called like ``ROW``."""
    taken, name = {c.lower() for c in columns}, ROW + "_"
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` (all columns, or those named), stored with their number ``ROW``, which is computed only here:
    a second scan of the same files may be cut into other partitions and number its rows otherwise. A column of the
    input that is called ``ROW`` is stored under another name; ``as_given`` gives it back."""
    names = list(dict.fromkeys(columns or docs.columns))
    own = [F.col(c).alias(_aside(docs.columns) if c.lower() == ROW else c) for c in names]
    return stored(docs.select(*own, F.monotonically_increasing_id().alias(ROW)), "numbered")


def as_given(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a ``numbered`` table with the ``columns`` of its input."""
    return rows.select(*[F.col(_aside(columns) if c.lower() == ROW else c).alias(c) for c in columns])


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` in stored chunks; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << ROW_BITS, count()
        for part in chunks(batches, "_text", size):
            texts = text_bytes(part.column("_text"))
            raw = b"".join(texts)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            one = pa.array([0, len(texts)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + next(serial)], pa.int64()),
                    pa.ListArray.from_arrays(one, part.column("_key")),
                    pa.ListArray.from_arrays(one, sizes),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()),
                ],
                ["chunk", "doc_id", "size", "raw", "blob"],
            )

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    return stored(rows.mapInArrow(run, PACK), "packs")


def unpack(row: dict) -> list[bytes]:
    """The texts of a chunk, in order."""
    raw = pa.decompress(row["blob"], decompressed_size=row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
    ends = np.cumsum(row["size"], dtype=np.int64)
    return [raw[e - s : e] for s, e in zip(row["size"], ends, strict=True)]


def parts_of(spark) -> int:
    """Ranges of keys: as many as shuffle partitions, which a cluster sizes for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_rows(chunk: int, keys: np.ndarray, payload: np.ndarray, parts: int) -> pa.RecordBatch:
    """A chunk's sorted distinct ``keys`` with one record of ``payload`` each, cut by range of keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edge))
    blobs = [keys[edge[p] : edge[p + 1]].tobytes() + payload[edge[p] : edge[p + 1]].tobytes() for p in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(np.diff(edge)[full], pa.int32()), pa.array(blobs, pa.binary())],
        ["part", "chunk", "n", "keys"],
    )


def judge(keyed: DataFrame, payload: np.dtype, verdict: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Per chunk and range of keys one byte for each of its keys, in order.

    ``verdict(which, payload, m)`` sees the entries of all chunks for a range, ``which`` numbering the ``m``
    distinct keys, and returns a byte for each distinct key.
    """

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        blobs = group.column("keys").to_pylist()
        keys = np.concatenate([np.frombuffer(b, np.uint64, count=int(k)) for b, k in zip(blobs, n, strict=True)])
        load = np.concatenate([np.frombuffer(b, payload, offset=8 * int(k)) for b, k in zip(blobs, n, strict=True)])
        distinct, which = np.unique(keys, return_inverse=True)
        flags = verdict(which, load, len(distinct)).astype(np.uint8)[which]
        end = np.cumsum(n)
        out = [flags[e - k : e].tobytes() for e, k in zip(end, n, strict=True)]
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "flags": pa.array(out, pa.binary())})

    return keyed.groupBy("part").applyInArrow(run, FLAGS)


def repeats(which: np.ndarray, many: np.ndarray, m: int) -> np.ndarray:
    """Verdict: keys of two chunks, or of one that holds them ``many`` times."""
    return (np.bincount(which, minlength=m) > 1) | (np.bincount(which, weights=many, minlength=m) > 0)


def flags_of(table: pa.Table, kind: str = "u1") -> np.ndarray:
    """A chunk's verdicts in the order of its keys."""
    order = np.argsort(table.column("part").to_numpy())
    blobs = table.column("flags").to_pylist()
    return np.frombuffer(b"".join(blobs[i] for i in order), kind)
