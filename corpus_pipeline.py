"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Rows of the result: one for each document that the mix takes, as often as it takes it (doc_id, n_tokens, ids_sha256,
decoded_sha256). SQL cannot express the learned and seeded stages, so the query is tested against its stages' own
brute-force versions.

Every stage but the last gives rows with the columns that it got, whatever they are called. Null and empty texts pass
toxicity, near copies and secrets as they are and have no words to be mixed, so mixing drops them. Rows without an id
are judged like others and never taken for copies. Repeated rows count as one document for near copies. Very long texts
are worked on whole. A table without rows stays without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm import bpe, mixing, ngram_jaccard, queries, secret_scan, toxicity
from quantaloom.sources.shared import remove, shared_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the network learns from labels that aren't held out."""
    return toxicity.reject(docs, queries.toxicity_network(spark, docs, sf_dir))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return ngram_jaccard.one_of_each(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bpe.encode_digests(docs, queries.word_bpe_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_near_copies), ("secret_scan", blank_secrets), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what passes between them lies in the shared folder, and goes once the next stage is written."""
    folder = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
