"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Every stage takes null doc_ids, null, empty and very long texts, ties, repeated rows, an empty table and further columns of any
name, as its operator says: a null or empty text is rated by the model's thresholds, loses no line, is in no group, is not hit, and
has no ids; rows that repeat are treated alike; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontam, linededup, ngramjoin, quality
from tallyloom.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go; the others stay as they are."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has lost lines and has no word left goes too."""
    out = linededup.dedup_lines(docs, counts=("__n_lines", "__n_removed"))
    return out.where("__n_removed = 0 or text rlike '[^ \\t-\\r]'").select(*[f"`{c}`" for c in docs.columns])


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, Jaccard 0.8 or more."""
    return ngramjoin.first_of_groups(docs, n=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from texts; all rows stay."""
    return decontam.remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document."""
    return bpe.encode_documents(docs, bpe.read_ranks(bpe.vocabulary_path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", no_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: Trained weights and hashed similarities have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
