"""Line dedup over levelled sorted runs: batches of documents take turns, each against the lines that earlier ones left.

A store holds runs of line hashes, tables bucketed and sorted by the hash with, for each, how many documents were seen with
the line and which of them keeps it. A new batch merges its own sorted hashes with each run without moving the run: an
anti join leaves out lines that are settled, found in enough documents already, an outer one adds what open lines have so
far, and the rest becomes the batch's own run. Where a level has ``fan`` runs they are merged into one of the next level, so
a batch meets few runs and a hash is rewritten once for each level.

The first batch that holds a line keeps it, and in it the largest doc_id; ``dedup`` deals a table into batches from the largest
doc_id down, so of all documents the largest keeps its lines. Dropped lines go to their documents by hash. Lines of more
than a thousandth of all (document, line) pairs are a thousand at most and are broadcast; others have no large group.

A document is a doc_id: rows that repeat one are judged alike, and count as often as they are there. Rows without doc_id lose a
line before any other row does. A null or empty text is one empty line. Equal lines of one document count once and go or
stay together. An empty table gives none; other columns of the input are left as they are where texts are rewritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACES, materialize, scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = SPACES.encode()

#: Lines found in more than this share of all (document, line) pairs are broadcast: a thousand at most.
HOT = 1000


def keys(text: str, chars: int) -> list[bytes]:
    """For each line of ``text`` the 128-bit hash of its key, the line stripped and in lower case, or an empty one where the
    key has fewer than ``chars`` code points."""
    out = []
    for line in text.encode().translate(LOWER).split(b"\n"):
        key = line.strip(_SPACES)
        # a code point has four bytes at most
        long = len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else b"")
    return out


def line_keys(docs: DataFrame, chars: int) -> DataFrame:
    """A row (doc_id, key) for each of ``docs`` (doc_id, text) and distinct long line in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = set(keys(text, chars)) - {b""}
                ids += [i] * len(found)
                out += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    return docs.mapInArrow(run, "doc_id long, key binary")


class Runs:
    """Levelled sorted runs of line hashes: key, docs (how many documents so far) and last (the one that keeps the line)."""

    def __init__(self, spark: SparkSession, least: int, fan: int = 3):
        self.spark, self.least, self.fan = spark, least, fan
        # as many buckets as a shuffle has partitions, so a batch's hashes meet a run's where they are
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take in the next batch of ``lines`` (doc_id, key), a row for each document and line."""
        own = lines.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        for run in self.runs():
            own = own.join(run.filter(F.col("docs") >= self.least).select("key"), "key", "left_anti")
        seen, last = F.lit(0), F.col("last")
        for k, run in enumerate(self.runs()):
            # a later run's figures include those of the runs before it
            own = own.join(run.filter(F.col("docs") < self.least).select("key", F.col("docs").alias(f"_docs{k}"), F.col("last").alias(f"_last{k}")), "key", "left")
            seen = F.greatest(seen, F.coalesce(f"_docs{k}", F.lit(0)))
            last = F.coalesce(f"_last{k}", last)
        self._put(0, self._write(own.select("key", (F.col("docs") + seen).alias("docs"), last.alias("last"))))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            full = self.levels[level]
            made = self._write(self._merged([self.spark.table(n) for n in full]))
            self.levels[level] = []
            for old in full:
                self.spark.sql(f"drop table {old}")
            self._put(level + 1, made)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The runs as one, by outer merge joins on their buckets. All rows of a key have the same ``last``. A union won't do:
        the plan would take its rows to lie by bucket, while the scans under it are read as plain files."""
        whole = runs[0]
        for run in runs[1:]:
            other = run.select("key", F.col("docs").alias("_docs"), F.col("last").alias("_last"))
            whole = whole.join(other, "key", "full").select("key", F.greatest("docs", "_docs").alias("docs"), F.coalesce("last", "_last").alias("last"))
        return whole

    def settled(self) -> DataFrame:
        """(key, docs, last) of the lines found in enough documents."""
        return self._merged(self.runs()).filter(F.col("docs") >= self.least)

    def close(self) -> None:
        """Forget the runs; their files stay in the shared folder."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"drop table {name}")
        self.levels = []


def batches(lines: DataFrame, n: int) -> list[DataFrame]:
    """``lines`` in ``n`` batches of near the same size, from the largest doc_id down; rows without doc_id come last."""
    cuts = lines.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    edges = sorted(set(cuts or []), reverse=True)
    out = []
    for high, low in zip([None, *edges], [*edges, None], strict=True):
        if low is not None:
            of = F.col("doc_id") > low
            out.append(lines.filter(of if high is None else of & (F.col("doc_id") <= high)))
        else:
            out.append(lines if high is None else lines.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull()))
    return out


def dropped(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """For each doc_id the hashes of the lines it loses: ``settled`` ones of ``lines`` that another document keeps."""
    limit = lines.count() // HOT
    hot, rest = settled.filter(F.col("docs") > limit), settled.filter(F.col("docs") <= limit)
    common = lines.join(F.broadcast(hot.select("key", "last")), "key")
    others = lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest.select("key", "last"), "key")
    lost = common.unionByName(others).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))


def dedup(docs: DataFrame, chars: int = 40, least: int = 5, n_batches: int = 4, fan: int = 3) -> DataFrame:
    """``docs`` with lines that at least ``least`` documents share taken from all of them but the one with the largest doc_id:
    the columns of ``docs`` and n_lines (before), n_dropped and kept_sha256; where it has such columns, these take their place."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = materialize(line_keys(read, chars), "line-keys")
    store = Runs(docs.sparkSession, least, fan)
    for batch in batches(lines, n_batches):
        store.add(batch)
    settled = materialize(store.settled(), "settled-lines")
    store.close()
    gone = dropped(lines, settled).select(F.col("doc_id").alias("_gone_from"), F.col("lost").alias("_lost"))
    made = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])
    kept = [f for f in docs.schema if f.name not in made.names]
    schema, names = StructType([*kept, *made]), [f.name for f in kept]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, out = [], {k: [] for k in ("n_lines", "n_dropped", "kept_sha256")}
            for text, lost in zip(b.column("text").to_pylist(), b.column("_lost").to_pylist(), strict=True):
                whole = (text or "").split("\n")
                stay = whole
                if lost:
                    drop = set(lost)
                    stay = [line for line, key in zip(whole, keys(text, chars), strict=True) if key not in drop]
                texts.append("\n".join(stay) if len(stay) < len(whole) else text)
                out["n_lines"].append(len(whole))
                out["n_dropped"].append(len(whole) - len(stay))
                out["kept_sha256"].append(hashlib.sha256((texts[-1] or "").encode()).hexdigest())
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            columns += [pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *out])

    whole = docs.select(*names).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_from")), "left").drop("_gone_from")
    return whole.mapInArrow(run, schema)
