"""The corpus pipeline: quality rules, near-duplicates, personal data, mixture, tokens.

Each stage works on all rows the one before it kept; all but the last return the columns of documents.
Encoding (the last) returns doc_id, source, lang, n_tokens, ids_sha256 and decoded_sha256 of each text.

Defined results per stage are those of its operator's docstring: texts that are null or empty have no words
and are rejected by the quality rules; rows of one doc_id with different texts are documents of their own until the
mixture, rows equal in both are one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from affinis.llm import bpe, mixing, pii, quality, simhash

#: Share of the tokens that the mixture takes, and how often it may take a document.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines of the others go too. Copies of a document count once for its lines."""
    return quality.filter_documents(docs, by_class=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked by their kind."""
    return pii.mask_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take."""
    return mixing.sample(docs, share=MIX_SHARE, epochs=MIX_EPOCHS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded text."""
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: SimHash fingerprints and byte-pair merges have no form in SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
