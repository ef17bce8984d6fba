"""Importance resampling towards a target distribution, over hashed n-grams, in two passes of Arrow batches.

The first pass turns each partition into one vector of feature counts, a bucket for each hash, by ``np.bincount``;
``treeReduce`` adds the vectors up, so the driver receives one of them, however many partitions there are. From the vectors of
the documents and of the target follows a bucket's gain, how much likelier the target is to draw it. The gains are
broadcast, 80 kB at any size of the input. The second pass gathers them for each document's features and sums by document, with
``np.bincount`` and weights. Gumbel noise from a hash of the doc_id makes the largest scores a sample without replacement;
ranks come from a sort by ranges, not from one task.

A null or empty text has no features and weight 0. A missing doc_id is hashed as an empty one. Rows that repeat are scored one
by one and may both be drawn; equal scores go to the smaller doc_id, a missing one first. An empty target leaves all
t at 0. Very long texts are one document of their batch like others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scans import numbered

from .common import materialize

#: Letters, digits and all beyond ASCII make words; other characters part them, A-Z are lowered.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def hashes(text: str, n: int) -> tuple[int, list[int]]:
    """How many words ``text`` has, and the crc32 of all runs of 1 to ``n`` of them. That of a longer run goes on from that of
    the run without its last word."""
    words = text.encode().translate(WORD).split()
    spaced = [b" " + w for w in words]
    last = list(map(crc32, words))
    out = list(last)
    for k in range(1, n):
        last = list(map(crc32, islice(spaced, k, None), last))
        out += last
    return len(words), out


def count_features(docs: DataFrame, buckets: int, n: int) -> np.ndarray:
    """How many features of all texts of ``docs`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for b in batches:
            for text in b.column("text").to_pylist():
                total += np.bincount(np.array(hashes(text, n)[1], "i8") % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, "i8")
    return vectors.map(lambda r: np.frombuffer(r["counts"], "i8")).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much more often the target holds a bucket, smoothed by one feature a bucket, rounded down."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + k) / ((source + 1.0) * (t + k))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], "f8")


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, times 1000 and rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each of ``docs``."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            words, sizes, found = [], [], []
            for text in b.column("text").to_pylist():
                m, h = hashes(text, n)
                words.append(m)
                sizes.append(len(h))
                found.append(np.array(h, "u4"))
            at = np.concatenate(found) % np.uint32(buckets) if found else np.zeros(0, "u4")
            weight = np.bincount(np.repeat(np.arange(len(ids)), sizes), weights=table[at], minlength=len(ids)).astype("i8")
            score = weight + np.array([noise(i, seed) for i in ids], "i8")
            out = {"doc_id": b.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(sizes, pa.int64()), "weight": pa.array(weight), "score": pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, n: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text) with weights towards ``target`` (text): ``percent`` of those with ``least_words`` or more are drawn
    without replacement, ``rank`` says in which order and is null for the others."""
    gain = gains(count_features(docs, buckets, n), count_features(target, buckets, n))
    scored = materialize(weigh(docs, gain, n, seed), "importance")
    able = F.col("n_words") >= least_words
    draws = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able), [F.desc("score"), F.asc_nulls_first("doc_id")], kind="long").withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
