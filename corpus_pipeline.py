"""Documents to packed training sequences, stage by stage.

Each stage takes all rows its predecessor kept and returns the columns of
documents; the last one returns pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.llm import bagminhash, cotraining, mixing, packing, queries, repeats
from starloom.llm.common import read
from starloom.session import cut_lineage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier keeps."""
    return cotraining.good_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.without_near_duplicates(docs)


def repeated_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of over 50 words that occur twice, however few bytes they have; what is emptied goes."""
    return repeats.strip_repeated_runs(docs, least=51).withColumn("n_chars", F.length("text").cast("long"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes or more that occur twice; what is emptied goes."""
    return repeats.strip_repeats(docs, least=400).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them."""
    # Rows travel as one column, so that none of theirs meets one of the mixture's.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang", "source", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"))
    return mixing.repeated(queries.mixed(rows)).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("repeated_words", repeated_words),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Trained scores, signatures and tokenizers cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
