"""Filter interaction audit: how filters overlap, and what each removes in every order, from a packed bitmap index.

The index has a row for each part and run of documents of one partition, with a NumPy bitset for every filter and label:
bit k says whether the run's k-th document fails the filter or bears the label. For each subset of filters, OR, AND-NOT
and popcount count the documents that pass all of the subset; these partition counts are summed by Spark. A filter that
comes after the prefix P of an order then removes what passes P less what passes P and the filter, so all orders follow
from one count for each subset, and no order is run over the documents.

A null text is an empty one and a null part the empty string. A document without doc_id repeats nobody's text, but others
repeat its text only where it has a doc_id; rows that repeat, doc_id and all, are no copies of each other. Of several labels
of one document any counts. An empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Documents that one run of the index takes at most.
RUN = 1 << 16
#: Rows of the index whose subsets are counted at a time.
ROWS = 64

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"


def facts(docs: DataFrame) -> DataFrame:
    """For each of ``docs`` (doc_id, source, text): doc_id, part, whether it fails filters A to D, and its text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("A", "B", "C", "D", "digest")}
            for text in b.column("text").to_pylist():
                raw = text.encode()
                words = raw.split()  # of bytes: at space and U+0009 to U+000D alone
                out["A"].append(len(words) < 200)
                out["B"].append(100 * len(set(words)) < 50 * len(words))
                out["C"].append(100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * len(text))
                out["D"].append(len(raw) != len(raw.translate(None, SIGNS)))
                out["digest"].append(hashlib.sha256(raw).digest())
            made = [pa.array(v, pa.binary() if k == "digest" else pa.bool_()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), *made], ["doc_id", "part", *out])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with E: some smaller doc_id has the same text. The smallest of each text is found with
    partial minima and joined by doc_id and digest, so a text that a third of the documents share is dealt over all tasks."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("_first", F.lit(True))
    return rows.join(firsts, ["doc_id", "digest"], "left").withColumn("E", F.col("_first").isNull() & F.col("doc_id").isNotNull()).drop("_first")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, false where ``labels`` (doc_id, quality, toxic) says nothing."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])


def index(rows: DataFrame, columns: list[str], part: str = "part") -> DataFrame:
    """The bitmap index of ``rows``: part, n and a packed bitset for each of the boolean ``columns``, true bits first from the
    lowest. Documents of a run are put in order of their part, each part's bits in words of their own."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        codes = t.column("part").combine_chunks().dictionary_encode()
        at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=len(names))
        words = -(-n // 64)
        begin = np.cumsum(words) - words
        place = np.repeat(64 * begin - (np.cumsum(n) - n), n) + np.arange(len(at))
        bits = np.zeros(64 * int(words.sum()), bool)
        packed = []
        for c in columns:
            bits[place] = t.column(c).to_numpy()[order]
            data = np.packbits(bits, bitorder="little").tobytes()
            packed.append(pa.array([data[8 * a : 8 * (a + w)] for a, w in zip(begin.tolist(), words.tolist(), strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), *packed], ["part", "n", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for a in range(0, b.num_rows, RUN):
                held.append(b.slice(a, RUN))
                size += held[-1].num_rows
                if size >= RUN:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    read = rows.select(F.coalesce(part, F.lit("")).alias("part"), *[F.coalesce(c, F.lit(False)).alias(c) for c in columns])
    return read.mapInArrow(run, ", ".join(["part string, n long", *[f"`{c}` binary" for c in columns]]))


def subset_counts(bitmaps: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """For each part and subset of ``filters``, whose k-th is the bit k of ``mask``: ``passed``, how many documents pass all of
    the subset, and for each of ``labels`` how many of them bear it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                n = b.column("n").to_numpy()
                words = -(-n // 64)
                begin, total = np.cumsum(words) - words, int(words.sum())
                live = np.full(total, ~np.uint64(0))
                short = n % 64 > 0
                live[(begin + words - 1)[short]] = (np.uint64(1) << (n % 64)[short].astype("u8")) - np.uint64(1)
                bits = {c: np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8") for c in (*filters, *labels)}
                fails = [np.zeros(total, "u8")]
                for mask in range(1, 1 << len(filters)):
                    low = (mask & -mask).bit_length() - 1
                    fails.append(fails[mask & (mask - 1)] | bits[filters[low]])

                def summed(x: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(np.bitwise_count(x).astype("i8"), begin)

                passed = [live & ~f for f in fails]
                counts = [np.concatenate([summed(p) for p in passed])] + [np.concatenate([summed(p & bits[c]) for p in passed]) for c in labels]
                masks = np.repeat(np.arange(len(passed), dtype="i4"), b.num_rows)
                parts = pa.concat_arrays([b.column("part")] * len(passed))
                yield pa.RecordBatch.from_arrays([parts, pa.array(masks), *map(pa.array, counts)], ["part", "mask", "passed", *labels])

    counted = bitmaps.mapInArrow(run, ", ".join(["part string, mask int, passed long", *[f"`{c}` long" for c in labels]]))
    return counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("passed", *labels)])


def orders(counts: DataFrame, filters: list[str], labels: dict[str, str]) -> DataFrame:
    """A row for each part, order of ``filters`` and step of it; ``labels`` maps a label to the name of the column that says how
    many of its documents the step removes. A part's counts are one row, of a value for each subset."""
    k, names = len(filters), ["passed", *labels]
    every = np.array(list(permutations(range(k))))
    bit = 1 << every
    after = np.cumsum(bit, axis=1)
    before = (after - bit).ravel()
    after, step, letter = after.ravel(), np.tile(np.arange(1, k + 1), len(every)), every.ravel()
    spelled = pa.array(["".join(filters[i] for i in o) for o in every.tolist()]).take(pa.array(np.repeat(np.arange(len(every)), k)))
    full = (1 << k) - 1
    # in how many orders exactly the filters of a subset come before a given one
    times = np.array([math.factorial(m.bit_count()) * math.factorial(max(0, k - 1 - m.bit_count())) for m in range(full + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                by = sorted(row["counts"], key=lambda c: c["mask"])
                passed, *more = (np.array([c[x] for c in by], "i8") for x in names)
                alone = [1 << i for i in range(k)]
                fails = np.array([passed[0] - passed[m] for m in alone])
                unique = np.array([passed[full ^ m] - passed[full] for m in alone])
                shapley = np.array([sum(times[p] * (passed[p] - passed[p | m]) for p in range(full + 1) if not p & m) for m in alone])
                removed = passed[before] - passed[after]
                columns = {
                    "kept": passed[after], "removed": removed, "redundant": fails[letter] - removed, "unique_fails": unique[letter],
                    **{name: x[before] - x[after] for name, x in zip(labels.values(), more, strict=True)}, "shapley": shapley[letter],
                }
                fixed = [pa.array([row["part"]] * len(step), pa.string()), spelled, pa.array(step, pa.int32())]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, pa.int64()) for c in columns.values())], ["part", "filter_order", "step", *columns])

    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("counts"))
    long = ["kept", "removed", "redundant", "unique_fails", *labels.values(), "shapley"]
    return rows.mapInArrow(run, ", ".join(["part string, filter_order string, step int", *[f"`{c}` long" for c in long]]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over ``docs`` (doc_id, source, text) in all 120 orders, with what ``labels`` says of the removed."""
    filters, kinds = list("ABCDE"), {"good": "good_lost", "toxic": "toxic_lost"}
    rows = labelled(repeats(materialize(facts(docs), "filter-facts")), labels)
    return orders(subset_counts(index(rows, [*filters, *kinds]), filters, list(kinds)), filters, kinds)
