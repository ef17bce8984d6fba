"""Ledgers with compare-and-set: a change is rows in a folder of their own and one file that makes them a version.

That file must not exist yet. Of several writers who change the same version at once one makes it; the others look at what it
wrote and try again, so a check and the write it allows are one step. Readers see whole versions only. Rows lost with a
failed try are never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ledger import DuplicateKey


class Conflict(RuntimeError):
    """Other writers were faster in every try."""


class IdentityChanged(ValueError):
    """An update would change columns that say which row it is."""


def made_first(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file at ``path``; it comes into being whole or not at all, and never twice. A local or mounted
    file is linked from one written beside it, others are renamed by Hadoop's FileContext, which overwrites nothing."""
    url = urlparse(path)
    beside = f"{path}.{uuid.uuid4().hex}"
    if url.scheme in ("", "file"):
        plain = urlparse(beside).path
        with open(plain, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(plain, url.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(plain)
        return True
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    out = source.getFileSystem(conf).create(source, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    try:
        context.rename(source, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # py4j wraps what Hadoop throws
        if "FileAlreadyExistsException" not in str(e):
            raise
        context.delete(source, False)
        return False
    return True


class Versions:
    """Rows (``schema``) under ``keys``, of each the newest; ``guard`` is the column that consuming a row sets, ``unique`` are
    further columns that no update may change, ``indexes`` names lists of columns that are asked for by all but their last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], guard: str | None = None, unique: tuple[str, ...] = (), indexes: dict[str, list[str]] | None = None):
        self.spark, self.path, self.schema, self.keys, self.guard, self.unique, self.indexes = spark, path.rstrip("/"), schema, keys, guard, unique, indexes or {}
        self.columns = spark.createDataFrame([], schema).columns
        log = self._hadoop(self._log)
        log.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(log)

    @property
    def _log(self) -> str:
        return f"{self.path}/_log"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        path = self._hadoop(self._log)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return max((int(n) for n in (f.getPath().getName() for f in files) if n.isdigit()), default=0)

    def _entries(self, version: int) -> list[dict]:
        """What the versions up to ``version`` say, from the last that holds all rows on."""
        if not version:
            return []
        said = {r.n: json.loads(r.value) for r in self.spark.read.text(self._log, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(\d+)$", 1).alias("n"), "value").filter("n != ''").collect()}
        upto = sorted((int(n), e) for n, e in said.items() if int(n) <= version)
        whole = max((n for n, e in upto if e["whole"]), default=0)
        return [e for n, e in upto if n >= whole]

    def history(self, version: int | None = None) -> DataFrame:
        """All rows since the last compaction with the ``_version`` that wrote them."""
        entries = self._entries(self.version() if version is None else version)
        if not entries:
            return self.spark.createDataFrame([], f"{self.schema}, _version long")
        return self.spark.read.schema(f"{self.schema}, _version long").parquet(*[f"{self.path}/{e['folder']}" for e in entries])

    def read(self, version: int | None = None) -> DataFrame:
        """Each key's newest row as of ``version``."""
        newest = self.history(version).groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns), "_version").alias("_row"))
        return newest.select("_row.*")

    def change(self, make: Callable[[DataFrame], DataFrame], tries: int = 50, whole: bool = False) -> DataFrame:
        """Commit the rows that ``make`` derives from the newest rows; where another writer was faster it is asked again. Returns
        the rows written; none make no version."""
        for _ in range(tries):
            seen = self.version()
            folder = f"rows-{uuid.uuid4().hex}"
            rows = make(self.read(seen)).select(*self.columns)
            rows.withColumn("_version", F.lit(seen + 1).cast("long")).write.parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(f"{self.schema}, _version long").parquet(f"{self.path}/{folder}")
            if written.isEmpty() or made_first(self.spark, f"{self._log}/{seen + 1:020d}", json.dumps({"folder": folder, "whole": whole})):
                return written.drop("_version")
        raise Conflict(f"{tries} changes of {self.path} came too late")

    def compact(self) -> None:
        """One version that holds the newest rows; those before needn't be read any more."""
        self.change(lambda now: now, whole=True)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add all of ``rows`` or, where a key is taken or stands twice, none."""
        twice = rows.groupBy(*self.keys).count().filter("count > 1")

        def make(now: DataFrame) -> DataFrame:
            if not twice.isEmpty() or not rows.join(now, self.keys, "left_semi").isEmpty():
                raise DuplicateKey(f"{self.keys} of new rows are taken")
            return rows

        return self.change(make)

    def write_once(self, rows: DataFrame) -> DataFrame:
        """Add those of ``rows`` whose key is new; all keys come back with the row that is stored, and whether this call ``created``
        it."""
        first = rows.dropDuplicates(self.keys)
        made = self.change(lambda now: first.join(now.select(*self.keys), self.keys, "left_anti"))
        return self.read().join(first.select(*self.keys), self.keys, "left_semi").join(made.select(*self.keys, F.lit(True).alias("created")), self.keys, "left").fillna(False, ["created"])

    def consume_once(self, updates: DataFrame, now_ms: int) -> DataFrame:
        """Apply ``updates`` (the keys and any other columns) to rows whose guard is null; the guard isn't null afterwards, ``now_ms``
        where the update leaves it out. Returns the keys with ``ok`` and a reason: not-found or precondition-failed."""
        if not self.guard:
            raise ValueError("this ledger has no guard column")
        named = [c for c in updates.columns if c not in self.keys]
        kind = dict(self.spark.createDataFrame([], self.schema).dtypes)[self.guard]
        new = updates.dropDuplicates(self.keys).select(*self.keys, *[F.col(c).alias(f"_{c}") for c in named])
        identity = [c for c in named if c in self.unique]

        def make(now: DataFrame) -> DataFrame:
            free = now.filter(F.col(self.guard).isNull()).join(new, self.keys)
            for c in identity:
                if not free.filter(~F.col(c).eqNullSafe(F.col(f"_{c}"))).isEmpty():
                    raise IdentityChanged(f"{c} says which row it is")
            guard = F.lit(now_ms).cast(kind)
            values = {c: F.col(f"_{c}") if c in named else F.col(c) for c in self.columns if c not in self.keys}
            values[self.guard] = F.coalesce(f"_{self.guard}", guard) if self.guard in named else guard
            return free.select(*self.keys, *[v.alias(c) for c, v in values.items()])

        done = self.change(make).select(*self.keys, F.lit(True).alias("ok"))
        there = self.read().select(*self.keys, F.lit(True).alias("_there"))
        out = new.select(*self.keys).join(done, self.keys, "left").join(there, self.keys, "left")
        why = F.when(F.col("ok"), None).when(F.col("_there"), "precondition-failed").otherwise("not-found")
        return out.select(*self.keys, F.coalesce("ok", F.lit(False)).alias("ok"), why.alias("reason"))

    def _index(self, name: str, prefix: list) -> list[str]:
        columns = self.indexes[name]
        if len(prefix) != len(columns) - 1:
            raise ValueError(f"index {name} has {len(columns)} columns, so it is asked for by {len(columns) - 1}, not by {len(prefix)}")
        return columns

    def latest(self, name: str) -> DataFrame:
        """Of each prefix of an index the row with the largest last column."""
        *prefix, last = self.indexes[name]
        return self.read().groupBy(*prefix).agg(F.max_by(F.struct(*self.columns), last).alias("_row")).select("_row.*")

    def listed(self, name: str, prefix: list, limit: int | None = None) -> DataFrame:
        """The rows under one prefix of an index, newest first."""
        *columns, last = self._index(name, prefix)
        rows = self.read()
        for c, v in zip(columns, prefix, strict=True):
            rows = rows.filter(F.col(c) == v)
        rows = rows.orderBy(F.desc(last))
        return rows if limit is None else rows.limit(limit)

    def problems(self) -> list[str]:
        """What stored rows have against the declaration: columns an index lacks, and indexes that aren't unique."""
        out = [f"index {n} names {c}, which the rows lack" for n, cs in self.indexes.items() for c in cs if c not in self.columns]
        rows = self.read()
        for name, columns in self.indexes.items():
            if set(columns) <= set(self.columns):
                w = Window.partitionBy(*columns)
                if not rows.withColumn("_n", F.count("*").over(w)).filter("_n > 1").isEmpty():
                    out.append(f"index {name} isn't unique")
        return out
