"""A corpus from raw documents to tokens: clean, deduplicate exactly and nearly, mix sources, encode.

Each stage takes what the one before it kept, stored and read again, and its decisions take effect: failing
lines and rejected documents go, of equal texts and of near-duplicate groups one document stays, sources are
taken as often as the mix says, and what is left is encoded and decoded again. No SQL expresses the
clean-up and the mix, so the pipeline is tested against plain versions of its stages.

A null text counts as empty and is rejected by the quality rules. Of equal texts the largest ``doc_id`` stays, of rows
equal in that, too, one; of a near-duplicate group the least ``doc_id``. An empty table stays empty. Further columns
pass all stages but the last, whatever they are called; ``n_chars``, if there, is the length of the cleaned text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.llm import bpe, chosen_path, line_rules, mixing, stream_dedup
from querywarden.llm.packs import ROW, as_given, numbered, prepare, stored
from querywarden.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    prepare(spark)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = line_rules.line_rules(docs.toDF(*names.values()), text=names["text"], keep_text=False).filter("kept")
    new = {c: F.col(name) for c, name in names.items()} | {"text": F.col("clean_text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[column.alias(c) for c, column in new.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    prepare(spark)
    return stream_dedup.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare(spark)
    rows = numbered(docs)
    gone = chosen_path.jaccard_join(rows, key=ROW).filter("not stays").select(F.col("doc_id").alias(ROW))
    return as_given(rows.join(gone, ROW, "left_anti"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in random order."""
    prepare(spark)
    return mixing.Mix(docs).mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian, 32 bits each), and whether they decode to its text.

    Ids are stored before they are decoded: encoder and decoder in one task would take two Python workers each, and an
    executor keeps as many as its tasks ever used at once. A text's digest goes along in place of the text.
    """
    prepare(spark)
    spec = bpe.tokenizer_json(tokenizer_path())
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = stored(bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text", digest.alias("digest")), spec), "encoded")
    same = F.unhex(F.sha2("decoded", 256)) == F.col("digest")
    n = (F.octet_length("ids") / 4).cast("long")
    return bpe.bpe_decode(ids, spec).select("doc_id", "lang", "source", n.alias("n_tokens"), "ids", same.alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
