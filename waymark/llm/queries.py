"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.chat import format_chats
from waymark.llm.decontaminate import contaminated
from waymark.llm.jaccard import jaccard_components
from waymark.llm.line_dedup import drop_shared_lines
from waymark.llm.merkle import audit_tampering
from waymark.llm.mixing import taken
from waymark.llm.oracles import ORACLES
from waymark.llm.quality_model import score_quality
from waymark.llm.records import byte_bpe, read_records, write_records
from waymark.llm.repair import damage, repair_summary
from waymark.llm.secrets import find_secrets
from waymark.llm.sharding import assign_shards
from waymark.llm.urls import judge_urls
from waymark.llm.quality_rules import judge_quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A file of the public tokenizers; WAYMARK_TOKENIZERS names another folder of them."""
    folder = os.environ.get("WAYMARK_TOKENIZERS")
    if not folder:
        folder = importlib.util.find_spec("public_tokenizers").submodule_search_locations[0]
    return os.path.join(folder, name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(table(spark, sf_dir, "documents"), byte_bpe(vocabulary("byte_bpe_50k.json")))
    return read_records(manifest, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "words_covered", "item_words", "coverage")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damage(table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_shared_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_tampering(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mixing": op2_source_mixing,
    "op3_sharding": op3_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_format": op5_chat_format,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_records": op7_token_records,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

__all__ = ["ORACLES", "QUERIES"]
