"""From raw documents to token ids: STAGES in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns it got, but for the last,
which returns token ids. Each holds for whatever its own input is: rules, similarities, labelers' rates
and source targets are computed on the documents that the stages before have kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import bpe, mixing, ngram_join, pii, quality_rules
from arrayloom.llm._shared import materialise, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    return quality_rules.filter_documents(docs, "standard-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity connects, the one with the least id stays."""
    return ngram_join.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars counts the text as it is now."""
    masked = pii.redact(docs)
    if "n_chars" not in masked.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate grants it; none is changed."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a copy: its ids, their number, and digests of the ids and of the bytes they decode to."""
    kept = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(kept, RANKS, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", rules), ("ngram_join", near_duplicates), ("pii", personal_data), ("mixing", mix), ("bpe", tokens)]

#: Connected components and byte-pair merges have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
