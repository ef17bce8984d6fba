"""The training-data pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes the session, the documents that the stage before left and the data folder, and returns documents with
the columns it was given; the last returns the packed pieces. A stage sees all that its predecessor kept, and what one
stage takes out the next doesn't see.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import minhash, packing, pii, quality, substrings
from tidewright.llm.common import materialize, table, texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, 80 % or more of their 5-word shingles in common, stays: that with
    the smallest doc_id."""
    return minhash.keep_one(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document before has go from the text."""
    return substrings.drop_repeats(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to the name of its kind."""
    return pii.mask(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of windows of 2048 tokens."""
    return packing.pack(texts(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", pii_masking),
    ("packing", retrieval_packing),
]

#: Sketches, indexes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
