"""Exact deduplication as a stream with keyed state on disk.

Rows arrive in micro-batches. State, kept by RocksDB under the stream's checkpoint and never expired,
holds for each digest the stable identifier of the row that stays, the locator of its content and the
number of rows seen. A digest seen before is a hit; full bytes of hits are compared with those the locator
points to, and a row that differs in spite of an equal digest stays as a text of its own.

Texts are equal when identical after lower-casing A-Z. Null counts as the empty text; so all null and empty
texts are one group. Of equal texts the row with the largest ``doc_id`` stays (null is the smallest); if
several rows share that ``doc_id``, one of them stays. An empty table gives an empty result. Other columns
play no part; names of the result never come from the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywarden.llm.packs import ROW, as_given, numbered
from querywarden.session import cut_lineage, scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # an executor may hold many stores: small buffers for each, and stores of ended streams are closed soon
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each of many small stores takes 4 MB ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 10_000


def normal_text(text: str | Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null is empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.octet_length(t) == F.length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of a ``numbered`` table: ``doc_id``, the row's stored number ``row``, and the digest of its normalised text."""
    norm = normal_text(text)
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(ROW).alias("row"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
    )


def run_stream(spark: SparkSession, path: str, schema: StructType, checkpoint: str, updates: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Feed the digest files at ``path`` through the state until all are read; a rerun goes on from there.

    Each micro-batch appends the groups it changed to ``updates`` under its own number, so a batch that is
    repeated after a failure replaces what it wrote before.
    """
    saved = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
        )

        def append(batch: DataFrame, number: int) -> None:
            changed = batch.select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.row").alias("keep_row"), "group_size")
            changed.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        stream = (
            state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        stream.awaitTermination()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_now(spark: SparkSession, updates: str) -> DataFrame:
    """The groups as of the last micro-batch: a group only grows, so its largest entry is the newest."""
    log = spark.read.schema("digest binary, keep_id long, keep_row long, group_size long").parquet(f"{updates}/batch=*")
    newest = log.groupBy("digest").agg(F.max(F.struct("group_size", "keep_id", "keep_row")).alias("s"))
    return newest.select("digest", "s.keep_id", "s.keep_row", "s.group_size")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", files_per_batch: int = FILES_PER_BATCH, has_rows: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row``.

    ``row`` is the number in ``docs`` if that is a ``numbered`` table (``has_rows``); else rows are numbered and stored here.
    """
    spark = docs.sparkSession
    docs = docs if has_rows else numbered(docs, key, text)
    rows = cut_lineage(digests(docs, text, key), "dedup-digests")
    path = rows.inputFiles()
    base = scratch_dir(spark, "dedup-stream")
    if path:
        run_stream(spark, path[0].rpartition("/")[0], rows.schema, f"{base}/checkpoint", f"{base}/updates", files_per_batch)
        groups = state_now(spark, f"{base}/updates")
    else:
        groups = spark.createDataFrame([], "digest binary, keep_id long, keep_row long, group_size long")
    placed = rows.join(groups, "digest", "left")
    collided = cut_lineage(collisions(docs, placed.filter("group_size > 1").select("row", "digest"), text), "dedup-collisions")
    if not collided.isEmpty():
        placed = _apart(docs, placed, collided, text)
    return placed.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keep_row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def collisions(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """Digests whose rows (``hits``: row, digest) do not all hold the same bytes."""
    own = docs.select(F.col(ROW).alias("row"), normal_text(text).alias("own"))
    span = own.join(hits, "row").groupBy("digest").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    return span.filter("low != high").select("digest")


def _apart(docs: DataFrame, placed: DataFrame, collided: DataFrame, text: str) -> DataFrame:
    """``placed`` with groups by bytes instead of digest where the digest is one of ``collided``."""
    own = docs.select(F.col(ROW).alias("row"), normal_text(text).alias("own"))
    mixed = placed.join(collided, "digest", "left_semi").select("doc_id", "row", "digest").join(own, "row")
    groups = mixed.groupBy("digest", "own").agg(F.max(F.struct("doc_id", "row")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    regrouped = mixed.join(groups, ["digest", "own"]).select(
        "digest", "doc_id", "row", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "group_size"
    )
    return placed.join(collided, "digest", "left_anti").unionByName(regrouped)


def kept_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows = numbered(docs)
    stay = exact_dedup(rows, text, key, has_rows=True).filter("kept").select(F.col("row").alias(ROW))
    return as_given(rows.join(stay, ROW, "left_semi"), docs.columns)
