"""Ticks and candles from the ``events`` table: symbol is the event type, price its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_by_day(rows: DataFrame, keys: list[str], order: list[str], day: Column, name: str) -> DataFrame:
    """Number the rows of each key from 0, in ``order``, without bringing a key's rows into one task: rows are numbered
    within a day, and each day starts where the days before it, counted in a small table, end."""
    rows = rows.withColumn("_day", day)
    counts = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order))
    numbered = rows.withColumn("_k", within)
    return numbered.join(starts, [*keys, "_day"]).withColumn(name, (F.col("_first") + F.col("_k") - 1).cast("long")).drop("_day", "_k", "_first")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, price and i, the tick's place in its symbol's stream; ``event_id`` breaks ties of time. They are
    numbered once a session and kept in the shared folder for as long as the files of ``events`` stay the same."""
    source = f"{sf_dir}/events.parquet"
    key = (spark.sparkContext.applicationId, source, _files(spark, source))
    if key not in _numbered or not _files(spark, _numbered[key][0]):
        e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
        made = index_by_day(e, ["symbol"], ["ts", "event_id"], F.to_date("ts"), "i")
        path = place(spark, "ticks")
        made.write.parquet(path)
        _numbered[key] = (path, made.schema)
    path, schema = _numbered[key]
    return spark.read.schema(schema).parquet(path)


_numbered: dict[tuple, tuple] = {}


def _files(spark: SparkSession, source: str) -> tuple:
    """Name, length and time of the file or files at a path of any Hadoop file system; none where there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)) if fs.exists(path) else ()


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def candles_by_time(rows: DataFrame, seconds: int) -> DataFrame:
    """Open, high, low, close of each symbol and bucket of ``seconds``, with the number of ticks."""
    bucket = F.floor(epoch("ts") / seconds) * seconds
    return rows.groupBy("symbol", bucket.alias("epoch")).agg(
        F.min_by("price", "i").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "i").alias("close"), F.count("*").alias("n"),
    )


def candles_by_count(rows: DataFrame, size: int = 10) -> DataFrame:
    """Candles of ``size`` ticks, numbered by c; the last of a symbol may be short."""
    return rows.groupBy("symbol", F.floor(F.col("i") / size).alias("c")).agg(
        F.min(epoch("ts")).alias("epoch"), F.min_by("price", "i").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "i").alias("close"), F.count("*").alias("n"),
    )
