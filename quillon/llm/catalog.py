"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat, decontam, divergence, itq, langid, linededup, pii, simhash, tokenbin, trie, warc, winnow

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_control_strings(table(spark, sf_dir, "conversations")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaked (doc_id, item_id); clean documents have none."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines removed: doc_id, n_lines, n_removed, text."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.digests(table(spark, sf_dir, "embeddings"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_chat_prefixes, op4_decontaminate, op5_warc, op6_fuzzy_lines, op7_pii_crf, op8_itq_embeddings, op9_token_shards, op10_covering_simhash, op11_winnowing, op12_source_divergence, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_prefixes": chat.ORACLE, "op4_decontaminate": decontam.ORACLE, "op5_warc": warc.ORACLE, "op8_itq_embeddings": itq.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_prefix_trie": trie.ORACLE}
