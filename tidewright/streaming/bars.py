"""Structured Streaming over ticks: candles by time with a watermark, candles by tick count with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.shared import place

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Ticks from files named ``pattern`` as they arrive in ``folder``. Event times get a zone, as watermarks need one."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def candles(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Candles of closed windows; a tick later than ``late`` is dropped."""
    order = F.struct("ts", "event_id")
    rows = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n")
    )
    return rows.select("symbol", F.unix_timestamp("w.start").alias("epoch"), "open", "high", "low", "close", "n")


def distinct_ticks(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Ticks without those that repeat an event within ``late``."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


BAR = "symbol string, c long, open double, high double, low double, close double, n long"
_STATE = "c long, open double, high double, low double, close double, n long"


def tick_bars(stream: DataFrame, size: int = 10) -> DataFrame:
    """Candles of ``size`` ticks as they fill. A symbol's state is its unfinished candle; ticks of one batch are put in
    order of time, and what arrives later than that belongs to later candles."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bar = list(state.get) if state.exists else [0, None, None, None, None, 0]
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for price in rows["price"].tolist():
            c, o, h, low, _, n = bar
            bar = [c, price if n == 0 else o, price if n == 0 else max(h, price), price if n == 0 else min(low, price), price, n + 1]
            if bar[5] == size:
                out.append((key[0], *bar))
                bar = [c + 1, None, None, None, None, 0]
        state.update(tuple(bar))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in BAR.split(", ")])

    return stream.groupBy("symbol").applyInPandasWithState(advance, BAR, _STATE, "append", "NoTimeout")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Everything there is now through ``stream`` into a new table in the shared folder, exactly once."""
    spark = stream.sparkSession
    out = place(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place(spark, f"{name}-progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
