"""A corpus pipeline: each stage takes the documents its predecessor kept.

Quality rules drop documents; of near-duplicate groups one document stays; documents that
hold benchmark passages go; the rest is mixed by source; the mix becomes token
records. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.decontaminate import drop_contaminated
from waymark.llm.jaccard import keep_first
from waymark.llm.mixing import mix
from waymark.llm.quality_rules import filter_quality
from waymark.llm.queries import table, vocabulary
from waymark.llm.records import byte_bpe, read_records, write_records
from waymark.plans.scratch import materialize, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest = write_records(docs, byte_bpe(vocabulary("byte_bpe_50k.json")))
    return read_records(manifest, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", deduplicate),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_records", token_records),
]

#: Weak supervision and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)  # a stage's table goes when the next one is written; the input is not one
    return STAGES[-1][1](spark, docs, sf_dir)
