"""Sessions, run events and what links them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.indicators import run_lengths
from tidewright.functions.scans import counted
from tidewright.functions.windows import chunked, own, stream
from tidewright.sources.ticks import epoch

MS = 1000


def millis(ts: str = "ts"):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def sessions(ticks: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """``ticks`` with the number of their session, from 0; a gap of more than ``gap_ms`` begins one."""
    rows = chunked(ticks, 1).withColumn("_apart", millis() - F.lag(millis()).over(stream()) > gap_ms)
    return counted(own(rows), F.col("_apart"), "session").drop("_apart")


def runs(ticks: DataFrame, length: int = 5) -> DataFrame:
    """An event at each ``length``-th move in a row with one sign; counting starts anew after an event, and a run starts
    at the tick before its first move."""
    rows = chunked(run_lengths(ticks), length)
    rows = own(rows.withColumn("start_epoch", F.lag(epoch("ts"), length).over(stream())))
    at = rows.filter((F.col("sign") != 0) & (F.col("run_length") % length == 0))
    return at.select(
        F.concat_ws("::", "symbol", F.col("sign").cast("string"), F.col("start_epoch").cast("string")).alias("event_key"),
        "symbol", F.col("sign").alias("direction"), F.lit(length).cast("long").alias("run_length"), F.col("start_epoch").alias("run_start_epoch"),
        epoch("ts").alias("detected_at"), F.col("price").alias("trigger_price"), "i",
    )


def backfill(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Events that aren't stored yet, by symbol, direction and start."""
    return candidates.join(stored.select("event_key"), "event_key", "left_anti")


def linked(events: DataFrame, session: str = "symbol") -> DataFrame:
    """Each event with the one before it in its session: gaps in time and ticks and whether direction alternates; null for
    a session's first."""
    w = Window.partitionBy(session).orderBy("i")
    return events.select(
        "*", F.lag("event_key").over(w).alias("previous_event"), ((F.col("detected_at") - F.lag("detected_at").over(w)) * MS).alias("time_gap"),
        (F.col("i") - F.lag("i").over(w)).alias("tick_gap"), F.when(F.lag("direction").over(w).isNotNull(), (F.col("direction") != F.lag("direction").over(w)).cast("int")).alias("alternating"),
    )


def outcomes(events: DataFrame, ticks: DataFrame, leads: int = 5) -> DataFrame:
    """Each event with the sign of the price's move to each of the next ``leads`` ticks; a label, so it looks ahead."""
    ahead = events.select("*", F.explode(F.sequence(F.lit(1), F.lit(leads))).alias("lead_time")).withColumn("at", F.col("i") + F.col("lead_time"))
    there = ticks.select("symbol", F.col("i").alias("at"), F.col("price").alias("later_price"))
    return ahead.join(there, ["symbol", "at"]).withColumn("outcome", F.signum(F.col("later_price") - F.col("trigger_price")).cast("int")).drop("at")
