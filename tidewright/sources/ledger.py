"""Ledgers as Parquet folders, with one writer at a time: Parquet has no compare-and-set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored


class DuplicateKey(ValueError):
    """A row's key is stored already, or stands twice among new rows."""


class Ledger:
    """Rows under unique ``keys``; rows are added, never changed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not self._exists():
            return empty
        rows = self.spark.read.parquet(self.path)
        drift = {(f.name, f.dataType) for f in rows.schema} ^ {(f.name, f.dataType) for f in empty.schema}
        if drift:
            raise ValueError(f"stored and declared columns differ: {sorted(n for n, _ in drift)}")
        return rows.select(*empty.columns)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def duplicates(self, rows: DataFrame) -> DataFrame:
        """Keys of ``rows`` that are stored or repeated."""
        twice = rows.groupBy(*self.keys).count().filter("count > 1").select(*self.keys)
        return twice.union(rows.join(self.read().select(*self.keys), self.keys, "left_semi").select(*self.keys)).distinct()

    def append(self, rows: DataFrame) -> None:
        """Add all rows or, if a key is taken, none."""
        if not self.duplicates(rows).isEmpty():
            raise DuplicateKey(f"{self.keys} of new rows are taken")
        rows.select(*self.read().columns).write.mode("append").parquet(self.path)

    def write_once(self, rows: DataFrame) -> DataFrame:
        """Add the rows whose key is new; all of ``rows`` come back as stored, with whether they were created."""
        first = rows.dropDuplicates(self.keys)
        # written to a table of its own first: what is new can't be told any more once it is in the ledger
        new = stored(first.join(self.read().select(*self.keys), self.keys, "left_anti"), "new-rows")
        new.select(*self.read().columns).write.mode("append").parquet(self.path)
        created = new.select(*self.keys).withColumn("created", F.lit(True))
        return self.read().join(first.select(*self.keys), self.keys, "left_semi").join(created, self.keys, "left").fillna(False, ["created"])

    def latest(self, prefix: list[str], seq: str) -> DataFrame:
        w = Window.partitionBy(*prefix).orderBy(F.desc(seq))
        return self.read().withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")

    def newest(self, seq: str, n: int, **prefix: object) -> DataFrame:
        rows = self.read()
        for k, v in prefix.items():
            rows = rows.filter(F.col(k) == v)
        return rows.orderBy(F.desc(seq)).limit(n)


def consume(ledger: DataFrame, key: str, consumed_at: str, taken: DataFrame) -> DataFrame:
    """``ledger`` after ``taken`` (key, at): a row is consumed by the first taker while it has none; others change nothing."""
    first = taken.groupBy(key).agg(F.min("at").alias("_at"))
    return ledger.join(first, key, "left").withColumn(consumed_at, F.coalesce(consumed_at, "_at")).drop("_at")


#: How a series' repeated times are settled, and its gaps.
def deduplicate(rows: DataFrame, keys: list[str], order: str, policy: str) -> DataFrame:
    if policy == "average":
        numbers = [c for c, t in rows.dtypes if t == "double"]
        return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numbers])
    if policy == "reject":
        twice = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
        return rows.join(twice, keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.asc(order) if policy == "keep_first" else F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def forward_filled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
