"""A corpus for training from ``documents``: five stages, each on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import bpe, decontam, langid, linedup, neardup
from alertloom.llm.common import unused, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language (null texts and texts without a letter); a missing ``lang`` is filled in, where any language is known."""
    samples = langid.learn(docs)
    if not samples:
        return langid.lettered(docs)
    # No column of the documents is mistaken for one that a stage adds.
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = langid.identify(docs, samples, keep=tuple(docs.columns), added=(pred, score)).filter(F.col(pred) != langid.UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document of which nothing is left goes."""
    n_lines, removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    cut = linedup.dedup_lines(docs, added=(n_lines, removed))
    some = F.col(removed) > 0
    cleaned = cut.filter(~(some & ~F.col("text").rlike(linedup.BLANK)))
    return cleaned.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near-duplicates, and one row of it where rows are repeated; rows without doc_id all stay."""
    # What is joined with the texts is written first, so that Spark knows its size.
    gone = written(neardup.near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Which of the rows under one doc_id stays is a matter of their contents alone.
    h1, h2 = unused(docs, "h1"), unused(docs, "h2")
    named = kept.withColumns({h1: F.xxhash64(*docs.columns), h2: F.xxhash64(F.lit(1), *docs.columns)})
    firsts = named.groupBy("doc_id").agg(F.min(F.struct(h1, h2)).alias("first"), F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL")
    repeated = written(firsts.select(F.col("doc_id").alias(unused(docs, "own_id")), F.col("first").alias(unused(docs, "first"))), "repeated")
    if repeated.isEmpty():
        return kept
    own, first = repeated.columns
    joined = named.join(repeated, F.col("doc_id") == F.col(own), "left")
    single = joined.filter(F.col(own).isNull()).select(*docs.columns)
    one = joined.filter(F.struct(F.col(h1).alias(h1), F.col(h2).alias(h2)) == F.col(first)).select(*docs.columns)
    return single.unionByName(one.dropDuplicates(["doc_id"]))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold a test item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontam.contained_items(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: the texts as token ids, and the text decoded from them."""
    path = public_tokenizers.path(RANKS)
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("bytes", "UTF-8").alias("text"))


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

# Automata, signatures and merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
