"""Queries over streams and point processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import point_process as pp
from tidewright.operators import runs as rn
from tidewright.sources.ticks import ticks
from tidewright.streaming import bars

from .streams import TC, T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {T}, c as (select symbol, epoch_us(ts) // 1000000 // 86400 * 86400 as epoch, arg_min(price, i) as open, max(price) as high, min(price) as low, arg_max(price, i) as close, count(*) as n from t group by 1, 2)
select * from c where epoch + 86400 <= (select epoch(max(ts)) - 3600 from t)""")
def streaming_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.run_once(bars.candles(bars.tick_stream(spark, sf_dir)), "candles")


@query(f"with {TC} select symbol, c, open, high, low, close, n from c where n = 10")
def streaming_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.run_once(bars.tick_bars(bars.tick_stream(spark, sf_dir)), "bars")


@query("select event_type as symbol, count(*) as n from events group by 1")
def streaming_distinct_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.run_once(bars.distinct_ticks(bars.tick_stream(spark, sf_dir)), "ticks").groupBy("symbol").agg(F.count("*").alias("n"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rn.linked(rn.runs(ticks(spark, sf_dir), 3)).filter("time_gap is not null")
    return events.select("symbol", "i", F.col("time_gap").cast("double").alias("gap"), (F.col("direction") > 0).alias("rise"))


@query()
def null_model_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pp.tests(_gaps(spark, sf_dir), "symbol", "i", "gap", "rise"))


@query()
def gap_partition_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pp.partition_effects(_gaps(spark, sf_dir), "symbol", "i", "gap"))
