"""The operators' queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import bpe, decontam, langid, licenses, linedup, merkle, neardup, pii, topk, trie, urlrules, vecdedup, warc
from alertloom.llm.common import scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.listing(pii.private_spans(_table(spark, sf_dir, "documents")))


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = langid.identify(docs, langid.learn(docs))
    return judged.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op5_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    decoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.page_listing(warc.read_archive(spark, path))


def op8_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op10_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_private_spans": op2_private_spans,
    "op3_languages": op3_languages,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_repeated_lines": op5_repeated_lines,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_archive": op7_archive,
    "op8_top_vectors": op8_top_vectors,
    "op9_licenses": op9_licenses,
    "op10_benchmark_passages": op10_benchmark_passages,
    "op11_manifest": op11_manifest,
    "op12_near_vectors": op12_near_vectors,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op5_repeated_lines": linedup.ORACLE,
    "op8_top_vectors": topk.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op11_manifest": merkle.ORACLE,
    "op12_near_vectors": vecdedup.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
