"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, decontaminate, licenses, neardup, pages, pii, prefixes, quality, substrings, tokens, toxicity, triejoin
from .base import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.key_of(spark)).drop("lang", "source", "n_chars")


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixes.prefix_trie(table(spark, sf_dir, "conversations"))
    return found.drop("position", "end_position")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_main_text, op4_token_counts, op5_license_scan, op6_quality_rules, op7_encode, op8_decontaminate, op9_pii, op10_repeated_substrings, op11_prefix_trie, op12_vector_codes, op13_ngram_join)}
ORACLE_SQL = {"op5_license_scan": licenses.scan_sql(), "op11_prefix_trie": prefixes.prefix_trie_sql(), "op12_vector_codes": codebooks.compress_sql()}
