"""Scores of a symbol's candles: the rules and the weighted dimensions that combine patterns, flow and analogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.windows import js_round, over

from . import candles as cd
from . import patterns as pt

#: The dimensions' weights.
WEIGHTS = {"trend": 0.15, "momentum": 0.12, "structure": 0.15, "liquidity": 0.10, "order_flow": 0.15, "history": 0.13, "genome": 0.10, "alignment": 0.10}


def _trend(candles: DataFrame) -> DataFrame:
    """The trend of a symbol's last four swings."""
    s = pt.swings(candles).groupBy("symbol").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("c", "type", "price")))), 1, 4).alias("s"))
    return s.select("symbol", pt.trend_of(F.reverse("s")).alias("trend"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def summary(candles: DataFrame, finer: DataFrame | None = None) -> DataFrame:
    """A row for each symbol with statistics, flow, trend, the latest findings and analogs; ``finer`` are its candles of a
    lower timeframe."""
    n = candles.groupBy("symbol").agg(F.max("c").alias("last_c"))
    found = pt.structure(candles).join(n, "symbol")
    breaks = found.filter("type in ('bos', 'choch') and c >= last_c - 19").groupBy("symbol").agg(F.count_if(F.col("direction") == "bullish").alias("up_breaks"), F.count("*").alias("breaks"))
    totals = found.groupBy("symbol").agg(F.count_if(F.col("type") == "bos").alias("bos"), F.count_if(F.col("type") == "choch").alias("choch"))
    newest = lambda kind: found.filter(F.col("type") == kind).groupBy("symbol").agg(F.max_by("direction", "c").alias(f"{kind}_direction"), F.max("c").alias(f"{kind}_at"))
    rows = n.join(cd.statistics(candles, "c"), "symbol").join(cd.order_flow(candles, "c"), "symbol")
    parts = [_trend(candles), breaks, totals, *[newest(k) for k in ("bos", "choch", "liquiditySweep")]]
    parts.append(pt.historical_analogs(candles).select("symbol", "current_trend", *[F.col(x).alias(f"h_{x}") for x in ("sample_size", "continued_pct", "reversed_pct")]))
    parts.append(pt.genome_analogs(candles).select("symbol", "current_direction", *[F.col(x).alias(f"g_{x}") for x in ("sample_size", "continued_pct", "reversed_pct")]))
    if finer is not None:
        parts.append(cd.order_flow(finer, "c").select("symbol", F.col("buying_pressure_pct").alias("fine_buying"), F.col("volume").alias("fine_n")))
    out = reduce(lambda a, b: a.join(b, "symbol", "left"), parts, rows)
    return out.fillna({"trend": "none", "bos": 0, "choch": 0})


def probability(rows: DataFrame, bias: Column) -> DataFrame:
    """The chance that ``bias`` (bullish, bearish or other) goes on, with the confidence in it, over ``summary``."""
    way = lambda c, up, down: F.when(c == up, 1.0).when(c == down, -1.0).otherwise(0.0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    trend = way(F.col("trend"), "up", "down")
    sweep = F.when(F.col("liquiditySweep_at") >= F.col("last_c") - 9, way(F.col("liquiditySweep_direction"), "bullish", "bearish"))
    fine = F.when(F.col("fine_buying") >= 50, 1.0).otherwise(-1.0) if "fine_buying" in rows.columns else F.lit(None)
    enough = (F.col("fine_n") >= 20) if "fine_buying" in rows.columns else F.lit(False)
    side = F.when(F.col("trend") == "up", 1.0).otherwise(-1.0)
    dims = {
        "trend": trend, "momentum": clamp(F.col("momentum_pct") / 5, -1, 1), "structure": zero((2 * F.col("up_breaks") - F.col("breaks")) / F.nullif(F.col("breaks"), F.lit(0))), "liquidity": zero(sweep),
        "order_flow": (F.col("buying_pressure_pct") - F.col("selling_pressure_pct")) / 100,
        "history": zero(F.when(F.col("h_sample_size") > 0, way(F.col("current_trend"), "up", "down") * (F.col("h_continued_pct") - F.col("h_reversed_pct")) / 100)),
        "genome": zero(F.when(F.col("g_sample_size") > 0, F.col("current_direction") * (F.col("g_continued_pct") - F.col("g_reversed_pct")) / 100)),
        "alignment": zero(F.when((F.col("trend") != "none") & enough, F.when(fine == side, side).otherwise(-0.5 * side))),
    }
    out = rows.filter("candle_count >= 40").withColumns({f"score_{k}": c for k, c in dims.items()})
    score = sum((F.col(f"score_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("weighted", score).withColumn("bias", bias)
    toward = way(F.col("bias"), "bullish", "bearish")
    out = out.withColumn("p_continue", F.when(toward == 0, 50).otherwise(js_round(clamp(50 + F.col("weighted") * toward * 50, 5, 95))).cast("long"))
    used = sum((F.when(F.col(f"score_{k}") != 0, 1).otherwise(0) for k in WEIGHTS), F.lit(0))
    lead = F.when(F.col("weighted") < 0, -1.0).otherwise(1.0)
    agree = sum((F.when(F.signum(f"score_{k}") == lead, 1).otherwise(0) for k in WEIGHTS), F.lit(0))
    few = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) < 3, 0.85).otherwise(1.0)
    odd = F.when((F.col("volatility_pct") > 80) | (F.col("volatility_pct") < 5), 0.9).otherwise(1.0)
    share = F.coalesce(agree / F.nullif(used, F.lit(0)), F.lit(0.5))
    out = out.withColumn("confidence", js_round(clamp(share * 100 * few("h_sample_size") * few("g_sample_size") * odd, 10, 95)).cast("long"))
    return out.select("symbol", "bias", *[f"score_{k}" for k in WEIGHTS], F.col("weighted").alias("weighted_score"), "p_continue", (100 - F.col("p_continue")).alias("p_reverse"), "confidence")


def rules(rows: DataFrame, recent: int = 5) -> DataFrame:
    """Findings of the rules over ``summary``: symbol, type, direction, confidence."""
    all_breaks = F.col("bos") + F.col("choch")
    ratio = F.coalesce(F.col("bos") / F.nullif(all_breaks, F.lit(0)), F.lit(0.5))
    skew = F.abs(F.col("bullish_count") - F.col("bearish_count")) / F.col("candle_count")
    strength = js_round((ratio * 0.45 + skew * 0.35 + F.least(F.abs("momentum_pct"), F.lit(10.0)) / 10 * 0.20) * 100).cast("double")
    late = lambda k: F.col(f"{k}_at") >= F.col("last_c") - recent
    buying, selling, still = F.col("buying_pressure_pct"), F.col("selling_pressure_pct"), F.col("absorption")
    turn = F.col("choch_direction")
    backed = ((turn == "bullish") & (buying > 55)) | ((turn == "bearish") & (selling > 55))
    swept = (F.col("liquiditySweep_direction") == turn) & (F.abs(F.col("liquiditySweep_at") - F.col("choch_at")) <= 3)
    quiet = (F.col("volatility_pct") < 35) & (still < 0.35) & (F.abs("momentum_pct") < 2)
    kept = js_round((1 - still) * 100).cast("double")
    found = [
        (F.lit(True), F.lit("trendStrength"), F.col("trend"), strength),
        ((F.col("trend") == "up") & (F.col("bos_direction") == "bullish") & late("bos") & (buying > 55), F.lit("bullishContinuation"), F.lit("bullish"), js_round(buying * 0.6 + strength * 0.4).cast("double")),
        ((F.col("trend") == "down") & (F.col("bos_direction") == "bearish") & late("bos") & (selling > 55), F.lit("bearishContinuation"), F.lit("bearish"), js_round(selling * 0.6 + strength * 0.4).cast("double")),
        (late("choch"), F.lit("reversal"), turn, F.least(50.0 + F.when(F.coalesce(swept, F.lit(False)), 25).otherwise(0) + F.when(backed, 15).otherwise(0), F.lit(100.0))),
        (quiet, F.when(F.col("trend") == "up", "distribution").otherwise("accumulation"), F.lit("none"), kept),
        (still < 0.2, F.lit("absorption"), F.lit("none"), kept),
    ]
    each = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(kind.alias("type"), way.alias("direction"), sure.alias("confidence"))) for test, kind, way, sure in found])
    return rows.filter("candle_count >= 10").select("symbol", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("symbol", "f.*")


def biases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The two ladders from ``rules`` and trend to a bias: ``market`` asks for sure continuations and reversals and falls
    back on the trend, ``narrative`` takes any continuation and a trend only with pressure behind it."""
    is_ = lambda *kinds: F.col("type").isin(*kinds)
    each = found.groupBy("symbol").agg(
        F.max(F.when(is_("bullishContinuation"), F.col("confidence"))).alias("up"), F.max(F.when(is_("bearishContinuation"), F.col("confidence"))).alias("down"),
        F.max(F.when(is_("reversal"), F.col("confidence"))).alias("turn"), F.max(F.when(is_("reversal"), F.col("direction"))).alias("turns"), F.max(is_("accumulation", "distribution")).alias("ranges"),
    )
    rows = rows.filter("candle_count >= 10").join(each, "symbol", "left")
    c, turned = F.col, F.when(F.col("turns") == "bullish", "Bullish").otherwise("Bearish")
    market = (
        F.when(c("up") > 60, "Bullish").when(c("down") > 60, "Bearish").when(c("turn") > 65, turned).when(c("ranges"), "Ranging")
        .when(c("trend") == "up", "Bullish").when(c("trend") == "down", "Bearish").otherwise("Neutral")
    )
    narrative = (
        F.when(c("up").isNotNull(), "bullish").when(c("down").isNotNull(), "bearish").when(c("turn") >= 65, F.lower(turned)).when(c("ranges"), "ranging")
        .when((c("trend") == "up") & (c("buying_pressure_pct") > 52), "bullish").when((c("trend") == "down") & (c("selling_pressure_pct") > 52), "bearish").otherwise("neutral")
    )
    return rows.select("symbol", market.alias("market"), narrative.alias("narrative"))


def nearest_levels(candles: DataFrame) -> DataFrame:
    """Support and resistance about the last close, in two ways: the newest swing low at or below it, else the newest low,
    and the newest high at or above it, else the newest; and the newest low below it with the oldest high above it."""
    last = candles.groupBy("symbol").agg(F.max_by("close", "c").alias("now"))
    s = pt.swings(candles).join(last, "symbol")
    low, high, p, now = F.col("type") == "low", F.col("type") == "high", F.col("price"), F.col("now")
    newest = lambda test: F.max_by("price", F.when(test, F.col("c")))
    return s.groupBy("symbol", "now").agg(
        F.coalesce(newest(low & (p <= now)), newest(low)).alias("support"), F.coalesce(newest(high & (p >= now)), newest(high)).alias("resistance"),
        newest(low & (p < now)).alias("strict_support"), F.min_by("price", F.when(high & (p > now), F.col("c"))).alias("first_resistance"),
    )


#: The timeframes of the cascade in seconds, and what is said of each.
CASCADE = {"daily": 86_400, "h4": 14_400, "h1": 3_600, "m15": 900, "m5": 300, "m1": 60}


def cascade(candles: DataFrame, timeframe: str) -> DataFrame:
    """A sentence for each symbol on its candles of one timeframe; what it looks at depends on the timeframe."""
    last = candles.groupBy("symbol").agg(F.max("c").alias("last_c"), F.count("*").alias("n"))
    recent = lambda c: F.coalesce(F.col(c) >= F.col("last_c") - 6, F.lit(False))
    found = pt.structure(candles)
    rows = last.join(_trend(candles), "symbol", "left").fillna({"trend": "none"})
    for kind in ("bos", "choch", "liquiditySweep"):
        rows = rows.join(found.filter(F.col("type") == kind).groupBy("symbol").agg(F.max("c").alias(f"{kind}_at"), F.max_by("direction", "c").alias(f"{kind}_way")), "symbol", "left")
    part = lambda a, b: candles.join(last, "symbol").filter(F.col("c").between(F.col("last_c") + a, F.col("last_c") + b)).drop("last_c", "n")
    for name, a, b in (("now", -5, 0), ("before", -14, -6)):
        rows = rows.join(cd.statistics(part(a, b), "c").select("symbol", F.col("momentum_pct").alias(name)), "symbol", "left")
    trend = F.col("trend")
    named = F.when(trend == "up", "Bullish").when(trend == "down", "Bearish")
    way = lambda c: F.when(F.col(c) == "bullish", "Bullish").otherwise("Bearish")
    if timeframe == "daily":
        said = F.coalesce(F.concat(named, F.lit(" trend remains intact.")), F.lit("No clear directional bias — range-bound conditions."))
    elif timeframe == "h4":
        up = F.when(F.col("now") < 0, "Healthy pullback into demand.").otherwise("Trend continuing, no signs of exhaustion.")
        down = F.when(F.col("now") > 0, "Corrective bounce into supply.").otherwise("Trend continuing, sellers in control.")
        said = F.when(trend == "up", up).when(trend == "down", down).otherwise("No clear directional bias — range-bound conditions.")
    elif timeframe == "h1":
        sides = F.when(F.col("bos_way") == "bullish", "buyers").otherwise("sellers")
        said = F.when(recent("choch_at"), F.concat(way("choch_way"), F.lit(" change of character — control may be shifting.")))
        said = said.when(recent("bos_at"), F.concat(way("bos_way"), F.lit(" BOS confirms "), sides, F.lit(" remain in control.")))
        said = F.coalesce(said, F.concat(named, F.lit(" structure intact, no fresh break yet.")), F.lit("Structure unclear at this level."))
    elif timeframe == "m15":
        said = F.when(recent("liquiditySweep_at"), "Liquidity grab completed.")
        said = F.coalesce(said, F.concat(named, F.lit(" bias, watching for a liquidity reaction.")), F.lit("No liquidity event detected recently."))
    elif timeframe == "m5":
        size, was = F.abs("now"), F.coalesce(F.nullif(F.abs("before"), F.lit(0.0)), F.lit(0.01))
        said = F.when(F.col("now").isNull() | F.col("before").isNull(), "Momentum unclear.").when(size > was * 1.3, "Momentum expanding.").when(size < was * 0.7, "Momentum contracting.").otherwise("Momentum steady.")
    else:
        newest = pt.scan(candles).join(last, "symbol").filter(F.col("c") >= F.col("last_c") - 6).groupBy("symbol").agg(F.max_by("label", F.struct("c", "type")).alias("label"))
        rows = rows.join(newest, "symbol", "left")
        hit = F.concat(F.lit("Execution trigger confirmed — "), F.lower("label"), F.lit(" on the latest candle."))
        said = F.coalesce(hit, F.lit("No immediate execution trigger yet — waiting for confirmation."))
    return rows.select("symbol", F.lit(timeframe).alias("timeframe"), F.when(F.col("n") < 15, "Not enough data loaded for this timeframe.").otherwise(said).alias("verdict"))


def calibrated(trades: DataFrame, dimensions: list[str]) -> DataFrame:
    """Weights from closed trades: where five or more had something to say in a dimension and three or more were right, its
    weight is scaled by twice its reliability within 0.5 and 1.5; then all are made to add up to 1. ``trades`` has a score
    for each dimension and ``won``, 1 or -1."""
    rows = trades.unpivot(["trade_id", "won"], dimensions, "dimension", "score").filter("score is not null and score != 0")
    got = rows.groupBy("dimension").agg(F.count("*").alias("relevant"), F.count_if(F.signum("score") == F.col("won")).alias("agreeing"))
    base = F.create_map(*[x for k in dimensions for x in (F.lit(k), F.lit(WEIGHTS[k]))])
    spark = trades.sparkSession
    rows = spark.createDataFrame([(k,) for k in dimensions], "dimension string").join(got, "dimension", "left").fillna(0)
    factor = F.when((F.col("relevant") >= 5) & (F.col("agreeing") >= 3), clamp(2 * over(F.col("agreeing").cast("double"), F.col("relevant").cast("double")), 0.5, 1.5)).otherwise(1.0)
    rows = rows.withColumn("raw", base[F.col("dimension")] * factor)
    return rows.join(F.broadcast(rows.agg(F.sum("raw").alias("all")))).select("dimension", "relevant", "agreeing", (F.col("raw") / F.col("all")).alias("weight"))
