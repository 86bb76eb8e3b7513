"""opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import bpe, langid, lm, maxscore, mixing, pii, quality, resampling, simhash, substring, suffixes, warc
from affinis.llm.common import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantise(F.col("embedding")).alias("weights"))
    return maxscore.top_k(items.where("vec_id % 50 = 0"), items, 5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [pii.count_of(F.col("pii_spans"), k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(pii.listing(F.col("pii_spans"), base_only=True), 256)
    return found.select("doc_id", *n, base.alias("base_sha256"), pii.listing(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality.assess(docs)
    return out.select("doc_id", *quality.METRICS, "base_failed", "kept", "kept_words")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_top_k, op2_language_id, op3_pii, op4_warc, op5_byte_bpe, op6_suffix_array_dedup, op7_substring_dedup, op8_mixing, op9_quality_rules, op10_simhash_near_dedup, op11_lm_scoring, op12_resampling)}
