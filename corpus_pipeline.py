"""A corpus pipeline of five stages; each works on all that the one before kept.

toxicity drops documents predicted toxic; near_duplicates keeps the smallest doc_id of each group;
decontamination drops documents with words in benchmark windows; pii rewrites texts; encoding
returns the digests of what is left. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackenlake.llm import base, decontaminate, neardup, pii, tokens, toxicity


#: Percent of shared shingles from which two documents are near duplicates.
SIMILAR = 80


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, base.table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs, percent=SIMILAR).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, base.table(spark, sf_dir, "benchmark"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = pii.pseudonymise(docs.select("text", F.struct(*docs.columns).alias("__doc")), pii.key_of(spark))
    own = {c: F.col("__doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return new.select([x.alias(c) for c, x in own.items()])


def stage_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("minhash near-dedup", stage_near_duplicates),
    ("benchmark decontamination", stage_decontamination),
    ("pii", stage_pii),
    ("sentencepiece encoding", stage_encoding),
]

#: SQL can't express the fitted model nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again for the next."""
    docs = base.table(spark, sf_dir, "documents")
    at = f"{base.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{i}")
    return docs
