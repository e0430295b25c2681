"""One registered query for each training-data operator: its whole table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chatformat, decontam, langid, licenses, linededup, quality, repair, rules, shards, tokenstore
from .common import shared_dir, table
from .ngramjoin import ngram_groups
from .oracle import ORACLE_SQL


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, with_ids=False)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, bpe.vocabulary_path("byte_bpe_50k.json"))
    return tokenstore.read_store(spark, path, digest_only=True)


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "expected_grade", "tail_probability", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chatformat.read_back(chatformat.format_turns(turns))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.summaries(repair.edits(repair.damaged(turns)), turns)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), *alignment.sources(bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("piece_bpe_32k.model")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a store of 16 shards, brought to 24, and read back."""
    path = shared_dir(spark, "shards")
    shards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, 16)
    shards.reshard(spark, path, 24)
    stored = shards.read_shards(spark, path)
    nothing = F.lit(None).cast("int").alias("grown_shard")
    return stored.select("row.doc_id", shards.text_size("row.text").alias("size"), shards.text_crc32("row.text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), nothing)


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("labels", "score", "matches")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), None).drop("kept", "quality")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_store": op5_token_store,
    "op1_quality_ordinal": op1_quality_ordinal,
    "op10_quality_rules": op10_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_sharding": op13_sharding,
    "license_places": license_places,
    "quality_rule_counts": quality_rule_counts,
}
