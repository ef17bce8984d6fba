"""What is said of a symbol's candles: trend, the last candle, momentum, order flow, levels and warnings, as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import candles as cd
from . import patterns as pt
from .scoring import _trend

#: Candles needed, those that count as recent, and those whose order flow is current.
LEAST, RECENT, FLOW = 20, 10, 20

#: The sentences, in which {words} are filled in.
SAID = {
    "bullish": "The 5-minute timeframe remains in an established bullish trend, with buyers continuing to defend higher lows. Recent candles indicate that bullish momentum is still intact despite minor pullbacks. ",
    "bullish_level": "The current candle is developing above the previous swing low at {price}, suggesting that buyers are absorbing selling pressure rather than allowing a bearish reversal. ",
    "bullish_end": "There is currently no confirmed bearish Break of Structure, so the primary market bias remains upward.",
    "bearish": "The 5-minute timeframe remains in an established bearish trend, with sellers continuing to defend lower highs. Recent candles indicate that bearish momentum is still intact despite minor pullbacks. ",
    "bearish_level": "The current candle is developing below the previous swing high at {price}, suggesting that sellers are absorbing buying pressure rather than allowing a bullish reversal. ",
    "bearish_end": "There is currently no confirmed bullish Break of Structure, so the primary market bias remains downward.",
    "unclear": "The 5-minute timeframe does not currently show a clearly established trend. Recent structure has been mixed, with no decisive break confirming control for either buyers or sellers. This is a lower-confidence environment for trend-following decisions until structure clarifies.",
    "active": "The current candle forming reflects active participation from {side}.",
    "defend_up": "Buyers continue to defend higher prices.",
    "defend_down": "Sellers continue to press price lower.",
    "attempted": "{Other} have attempted to push price {way} but have not gained control.",
    "little": "{Other} have shown little resistance so far this candle.",
    "healthy": "The candle body remains healthy relative to its wick size, indicating sustained {acting} pressure.",
    "small": "The candle body is relatively small relative to its wick size, suggesting hesitant {acting} pressure.",
    "unless": "Unless the candle closes with significant {against} rejection, {side} retain the short-term advantage.",
    "calm": "Price is advancing with controlled volatility.",
    "wild": "Volatility is elevated relative to the recent range, warranting caution.",
    "fresh": "No signs of momentum exhaustion are currently evident.",
    "tired": "The magnitude of the recent move is significant enough that a slowdown or pullback would not be surprising.",
    "pressure_up": "Buying pressure exceeds selling pressure.",
    "pressure_down": "Selling pressure exceeds buying pressure.",
    "distribution": "A significant distribution pattern is visible in recent price action.",
    "no_distribution": "No significant distribution pattern is visible.",
    "collection": "Pullbacks appear to be liquidity collection rather than trend reversal.",
    "mixed": "Recent pullbacks are less clearly one-sided, consistent with the lack of a firmly established trend.",
    "demand": "Smart money is likely defending the recent demand zone.",
    "supply": "Smart money is likely defending the recent supply zone.",
    "warn_up": "Failure to hold the latest higher low. A strong bearish engulfing candle. A confirmed bearish Break of Structure.",
    "warn_down": "Failure to hold the latest lower high. A strong bullish engulfing candle. A confirmed bullish Break of Structure.",
    "warn": "A decisive break of the current range in either direction would establish a new bias.",
}


def said(name: str, **words: Column) -> Column:
    """A sentence with its words filled in."""
    text, parts = SAID[name], []
    for key, word in sorted(words.items(), key=lambda kv: text.index("{" + kv[0] + "}")):
        before, text = text.split("{" + key + "}", 1)
        parts += [F.lit(before), word]
    return F.concat(*parts, F.lit(text)) if parts else F.lit(text)


def priced(price: Column, now: Column) -> Column:
    """A price with as many places as prices of the size of ``now`` are quoted with."""
    return F.when(now < 10, F.format_string("%.4f", price)).when(now < 1000, F.format_string("%.3f", price)).otherwise(F.format_string("%.2f", price))


def commentary(candles: DataFrame) -> DataFrame:
    """A row of sentences for each symbol of ``candles`` (symbol, c, open, high, low, close) that has enough of them."""
    candles = candles.select("symbol", "c", "epoch", "open", "high", "low", "close")
    last = candles.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by(F.struct("open", "high", "low", "close"), "c").alias("k")).filter(F.col("n") >= LEAST)
    now = F.col("k.close")
    stats = cd.statistics(candles, "c").select("symbol", "momentum_pct", "volatility_pct")
    tail = candles.join(last.select("symbol", "n"), "symbol").filter(F.col("c") >= F.col("n") - FLOW).drop("n")
    flow = cd.order_flow(tail, "c").select("symbol", "absorption", "buying_pressure_pct", "selling_pressure_pct")

    recent = F.col("c") >= F.col("n") - RECENT
    broken = lambda kind, way: F.coalesce(F.max(recent & (F.col("type") == kind) & (F.col("direction") == way)), F.lit(False))
    breaks = pt.structure(candles).join(last.select("symbol", "n"), "symbol").groupBy("symbol").agg(
        broken("bos", "bullish").alias("bos_up"), broken("bos", "bearish").alias("bos_down"), broken("choch", "bullish").alias("choch_up"), broken("choch", "bearish").alias("choch_down")
    )
    swing = pt.swing_labels(candles).join(last.select("symbol", now.alias("now")), "symbol")
    low, high, p, one = F.col("type") == "low", F.col("type") == "high", F.col("price"), F.struct("label", "price")
    newest = lambda test, what=one: F.max_by(what, F.when(test, F.col("c")))
    levels = swing.groupBy("symbol").agg(
        F.coalesce(newest(low & (p <= F.col("now"))), newest(low)).alias("support"), F.coalesce(newest(high & (p >= F.col("now"))), newest(high)).alias("resistance"),
        newest(low & F.col("label").isin("HL", "L"), p).alias("held_low"), newest(high & F.col("label").isin("LH", "H"), p).alias("held_high"),
    )
    # a row for each symbol from here on
    rows = last
    for more in (stats, flow, breaks, levels, _trend(candles)):
        rows = rows.join(more, "symbol", "left")
    rows = rows.fillna({"trend": "none", "bos_up": False, "bos_down": False, "choch_up": False, "choch_down": False})

    up, down = (F.col("trend") == "up") & ~F.col("choch_down"), (F.col("trend") == "down") & ~F.col("choch_up")
    label = F.when(up, F.when(F.col("bos_up"), "Bullish Continuation").otherwise("Bullish, Awaiting Confirmation")).when(down, F.when(F.col("bos_down"), "Bearish Continuation").otherwise("Bearish, Awaiting Confirmation"))
    level = lambda name, c: F.when(F.col(c).isNotNull(), said(name, price=priced(F.col(c), now))).otherwise("")
    narrative = F.when(up, F.concat(said("bullish"), level("bullish_level", "held_low"), said("bullish_end")))
    narrative = narrative.when(down, F.concat(said("bearish"), level("bearish_level", "held_high"), said("bearish_end"))).otherwise(said("unclear"))

    k = lambda x: F.col(f"k.{x}")
    body, span, rising = F.abs(k("close") - k("open")), k("high") - k("low"), k("close") >= k("open")
    wick = F.when(rising, k("high") - F.greatest(k("open"), k("close"))).otherwise(F.least(k("open"), k("close")) - k("low"))
    word = lambda a, b: F.when(rising, a).otherwise(b)
    side, other = word("buyers", "sellers"), word("Sellers", "Buyers")
    psychology = F.concat_ws(
        " ", said("active", side=side), F.when(rising, said("defend_up")).otherwise(said("defend_down")),
        F.when((body > 0) & (wick > body * 0.3), said("attempted", Other=other, way=word("lower", "higher"))).otherwise(said("little", Other=other)),
        F.when((span > 0) & (body > 0.45 * span), said("healthy", acting=word("buying", "selling"))).otherwise(said("small", acting=word("buying", "selling"))),
        said("unless", against=word("bearish", "bullish"), side=side),
    )

    moved, buyers = F.col("momentum_pct"), F.col("buying_pressure_pct") > F.col("selling_pressure_pct")
    momentum = F.concat_ws(" ", F.when(F.col("volatility_pct") < 50, said("calm")).otherwise(said("wild")), F.when(F.abs(moved) < 3, said("fresh")).otherwise(said("tired")))
    orders = F.concat_ws(
        " ", F.when(buyers, said("pressure_up")).otherwise(said("pressure_down")), F.when(F.col("absorption") < 0.35, said("distribution")).otherwise(said("no_distribution")),
        F.when(up | down, said("collection")).otherwise(said("mixed")), F.when(buyers, said("demand")).otherwise(said("supply")),
    )
    return rows.select(
        "symbol", F.coalesce(label, F.lit("Transitioning / Unclear")).alias("trend_label"), narrative.alias("trend_narrative"), psychology.alias("candle_psychology"),
        F.when(moved > 0.3, "positive").when(moved < -0.3, "negative").otherwise("flat").alias("momentum_label"), momentum.alias("momentum_observations"),
        F.when(buyers, "buyers").otherwise("sellers").alias("order_flow_control"), orders.alias("order_flow_observations"),
        F.col("support.label").alias("support_label"), F.col("support.price").alias("support_price"), F.col("resistance.label").alias("resistance_label"), F.col("resistance.price").alias("resistance_price"),
        F.when(up, said("warn_up")).when(down, said("warn_down")).otherwise(said("warn")).alias("warning_signs"),
    )
