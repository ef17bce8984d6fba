"""Aggregations over candles: statistics, order flow, aggression, buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import chunked, js_round, over, own, stream
from tidewright.sources.ticks import epoch


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def bullish() -> Column:
    return F.col("close") >= F.col("open")


def statistics(candles: DataFrame, order: str) -> DataFrame:
    """One row for each symbol's candles; of the widest or narrowest the first counts."""
    span = F.col("high") - F.col("low")
    wick = span - body()
    return candles.groupBy("symbol").agg(
        F.count("*").alias("candle_count"), F.count_if(bullish()).alias("bullish_count"), F.count_if(~bullish()).alias("bearish_count"),
        F.avg(body()).alias("avg_body_size"), F.avg(wick).alias("avg_wick_size"),
        F.max_by(order, F.struct(span, -F.col(order))).alias("largest_candle"), F.min_by(order, F.struct(span, F.col(order))).alias("smallest_candle"),
        F.max("high").alias("highest_high"), F.min("low").alias("lowest_low"),
        (F.max("epoch") - F.min("epoch")).alias("duration_seconds"),
        F.coalesce(100 * over(F.max_by("close", order) - F.min_by("open", order), F.min_by("open", order)), F.lit(0.0)).alias("momentum_pct"),
        F.coalesce(100 * over(F.stddev_pop(span), F.avg(span)), F.lit(0.0)).alias("volatility_pct"),
    )


def order_flow(candles: DataFrame, order: str) -> DataFrame:
    """Where closes stand within their ranges, summed over each symbol's candles."""
    span = F.when(F.col("high") == F.col("low"), F.lit(1e-9)).otherwise(F.col("high") - F.col("low"))
    rows = candles.withColumn("span", span).withColumn("delta", ((F.col("close") - F.col("low")) / F.col("span") - 0.5) * 2 * F.col("span"))
    bought, sold = F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0)), F.sum(F.when(F.col("delta") > 0, 0.0).otherwise(-F.col("delta")))
    net = F.max_by("close", order) - F.min_by("open", order)
    buying = F.coalesce(100 * over(bought, bought + sold), F.lit(50.0))
    return rows.groupBy("symbol").agg(
        F.max_by("delta", order).alias("delta"), F.sum("delta").alias("cvd"), js_round(100.0 * F.count_if(bullish()) / F.count("*")).alias("imbalance_pct"),
        F.count("*").alias("volume"), over(F.abs(net), F.sum("span")).alias("absorption"), buying.alias("buying_pressure_pct"), (100 - buying).alias("selling_pressure_pct"),
    )


def aggression(ticks: DataFrame, seconds: int = 60, recent: int = 10) -> DataFrame:
    """Buy and sell aggression of each bucket. A tick moves against the tick before it, also over a bucket's edge; the
    intensity compares a bucket's moves with the mean of up to ``recent`` buckets before it."""
    move = own(chunked(ticks, 1).withColumn("d", F.col("price") - F.lag("price").over(stream()))).withColumn("start", F.floor(epoch("ts") / seconds) * seconds)
    up, down = F.col("d") > 0, F.col("d") < 0
    rows = move.groupBy("symbol", "start").agg(
        F.count_if(up).alias("up_ticks"), F.count_if(down).alias("down_ticks"), F.count("*").alias("ticks"),
        F.sum(F.when(up, F.col("d")).otherwise(0.0)).alias("up_mag"), F.sum(F.when(down, -F.col("d")).otherwise(0.0)).alias("down_mag"),
    )
    total = F.col("up_mag") + F.col("down_mag")
    before = Window.partitionBy("symbol").orderBy("start").rowsBetween(-recent, -1)
    tick = F.coalesce((F.col("up_ticks") - F.col("down_ticks")) / F.nullif(F.col("up_ticks") + F.col("down_ticks"), F.lit(0)), F.lit(0.0))
    size = F.coalesce(over(F.col("up_mag") - F.col("down_mag"), total), F.lit(0.0))
    usual = F.coalesce(F.avg(total).over(before), F.when(total > 0, total).otherwise(F.lit(1e-9)))
    rows = rows.withColumn("score", js_round((0.4 * tick + 0.6 * size) * 100))
    rows = rows.withColumn("intensity", F.when(usual > 0, total / usual).otherwise(1.0))
    rows = rows.withColumn("intensity", F.when(F.col("up_ticks") + F.col("down_ticks") > 0, F.col("intensity")).otherwise(0.0))
    strength = F.abs("score")
    side = lambda a, b: F.when(F.col("score") > 0, a).otherwise(b)
    verdict = (
        F.when((strength >= 60) & (F.col("intensity") >= 1.3), side("STRONG BUY AGGRESSION", "STRONG SELL AGGRESSION"))
        .when(strength >= 35, side("MODERATE BUY PRESSURE", "MODERATE SELL PRESSURE"))
        .when(strength >= 15, side("MILD BUY BIAS", "MILD SELL BIAS")).otherwise("NEUTRAL")
    )
    return rows.withColumn("verdict", verdict)


def newest(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The newest ``n`` rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def before(rows: DataFrame, cutoff: int, seconds: int = 0) -> DataFrame:
    """Rows that a replay at epoch ``cutoff`` shows: those whose bucket of ``seconds`` has ended."""
    return rows.filter(F.col("epoch") + seconds <= cutoff)
