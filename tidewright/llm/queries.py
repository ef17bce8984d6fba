"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, interactions, licenses, lines, lm, minhash, packing, pii, quality, resample, substrings, warc
from .common import table, texts


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(texts(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(texts(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(texts(table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(texts(table(spark, sf_dir, "documents")))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(texts(table(spark, sf_dir, "documents"))).drop("starts", "ends")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(texts(table(spark, sf_dir, "documents")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(texts(table(spark, sf_dir, "documents")), ranks, public_tokenizers.PATTERN).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(texts(table(spark, sf_dir, "documents"))).drop("text")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_packing, op3_pii, op4_lm_scoring, op5_license_scan, op6_nearest_neighbours, op7_substring_dedup,
        op8_minhash, op9_quality_rules, op10_byte_bpe, op11_filter_audit, op12_line_dedup, op13_importance_resampling,
    )
}
