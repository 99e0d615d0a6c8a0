"""Registered queries of the corpus operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.llm import bpe, burst_trie, chosen_path, debruijn, hmm, line_rules, mixing, pii, quality_gam, sharding, stream_dedup, suffix_buckets, variants
from querywarden.llm.oracles import ORACLES
from querywarden.llm.packs import prepare

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.tokenizer_json(tokenizer_path())
    ids = bpe.bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), spec)
    return bpe.bpe_decode(ids, spec).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op3_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("copies"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.quality_scores(documents(spark, sf_dir), labels)


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_tokens")


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(documents(spark, sf_dir))


def op8_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.repeated_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(documents(spark, sf_dir)).drop("row")


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_rules.line_rules(docs, clean=False, keep_text=False)


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return burst_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op13_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_buckets.repeated_bytes(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_tree": op1_bpe_tree,
    "op2_weak_pii": op2_weak_pii,
    "op3_mixing_tree": op3_mixing_tree,
    "op4_kd_shards": op4_kd_shards,
    "op5_quality_gam": op5_quality_gam,
    "op6_chosen_path": op6_chosen_path,
    "op7_hmm_scores": op7_hmm_scores,
    "op8_debruijn_spans": op8_debruijn_spans,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_rules": op10_line_rules,
    "op11_burst_trie": op11_burst_trie,
    "op12_pivotal_grams": op12_pivotal_grams,
    "op13_suffix_buckets": op13_suffix_buckets,
}
