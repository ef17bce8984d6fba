"""Patterns on candles (symbol, c, epoch, open, high, low, close), c numbering a symbol's candles.

Swings need candles after them and gaps one; findings carry ``confirmed_at``, the candle at which they can be known, and
``causal`` variants use only what is known by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scans import all_carried
from tidewright.functions.windows import chunked, js_round, over, own, stream


def by_candle():
    """Over chunks of a symbol's candles; every use of it cuts them with the neighbours it looks at."""
    return stream("c")


def cut(candles: DataFrame, before: int, after: int = 0) -> DataFrame:
    return chunked(candles, before, after, index="c")


def _sized(candles: DataFrame) -> DataFrame:
    """``candles`` with ``n``, how many their symbol has."""
    return candles.drop("n").join(candles.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")


def bull(k: int = 0) -> Column:
    return at("close", k) >= at("open", k)


def at(x: str, k: int = 0) -> Column:
    return F.lag(x, k).over(by_candle()) if k > 0 else F.lead(x, -k).over(by_candle()) if k < 0 else F.col(x)


def top(k: int = 0) -> Column:
    return F.greatest(at("open", k), at("close", k))


def bottom(k: int = 0) -> Column:
    return F.least(at("open", k), at("close", k))


def _side(c: Column) -> Column:
    return F.when(c, "bullish").otherwise("bearish")


def candlesticks(candles: DataFrame) -> DataFrame:
    """Findings (symbol, type, c, direction) on one candle or two."""
    size, before = top() - bottom(), top(1) - bottom(1)
    upper, lower = F.col("high") - top(), bottom() - F.col("low")
    span = F.col("high") - F.col("low")
    rows = cut(candles, 1).withColumns({
        "engulfing": F.when((bull() != bull(1)) & (top() >= top(1)) & (bottom() <= bottom(1)) & (size > before), _side(bull())),
        "outsideBar": F.when((F.col("high") > at("high", 1)) & (F.col("low") < at("low", 1)), _side(bull())),
        "insideBar": F.when((F.col("high") <= at("high", 1)) & (F.col("low") >= at("low", 1)), "none"),
        "pinBar": F.when(size == 0, None).when((lower >= 2 * size) & (upper <= 0.3 * lower), "bullish").when((upper >= 2 * size) & (lower <= 0.3 * upper), "bearish"),
        "doji": F.when(over(size, span) <= 0.1, "none"),
    })
    return _long(own(rows), "engulfing", "outsideBar", "insideBar", "pinBar", "doji")


def _long(rows: DataFrame, *names: str) -> DataFrame:
    """A row for each of the columns that isn't null."""
    found = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("type"), F.col(n).alias("direction")) for n in names]), lambda x: x["direction"].isNotNull()))
    return rows.select("symbol", "c", found.alias("f")).select("symbol", "f.type", "c", "f.direction")


def swings(candles: DataFrame, lookback: int = 2) -> DataFrame:
    """symbol, c, type, price: candles strictly above or below ``lookback`` neighbours on either side."""
    near = [k for k in range(-lookback, lookback + 1) if k]
    high = reduce(lambda a, b: a & b, [F.col("high") > at("high", k) for k in near])
    low = reduce(lambda a, b: a & b, [F.col("low") < at("low", k) for k in near])
    rows = own(cut(candles, lookback, lookback).withColumns({"is_high": high, "is_low": low}))
    found = F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("type"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("type"), F.col("low").alias("price"))))
    return rows.select("symbol", "c", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("symbol", "c", "s.type", "s.price")


def swing_labels(candles: DataFrame, lookback: int = 2) -> DataFrame:
    """Swings against the swing of their type before: HH, LH, HL or LL; H or L for the first."""
    w = Window.partitionBy("symbol", "type").orderBy("c")
    prior = F.lag("price").over(w)
    high = F.when(prior.isNull(), "H").when(F.col("price") > prior, "HH").otherwise("LH")
    low = F.when(prior.isNull(), "L").when(F.col("price") > prior, "HL").otherwise("LL")
    return swings(candles, lookback).withColumn("label", F.when(F.col("type") == "high", high).otherwise(low))


def trend_of(some: Column) -> Column:
    """Of up to four swings, oldest first: up if the last two highs and lows both rise, down if neither does, else none."""
    def prices(kind: str) -> Column:
        return F.transform(F.filter(some, lambda s: s["type"] == kind), lambda s: s["price"])

    def rises(x: Column) -> Column:
        return F.get(x, F.size(x) - 1) > F.get(x, F.size(x) - 2)

    h, low = prices("high"), prices("low")
    enough = (F.size(h) >= 2) & (F.size(low) >= 2)
    return F.when(enough & rises(h) & rises(low), "up").when(enough & ~rises(h) & ~rises(low), "down").otherwise("none")


def with_structure(candles: DataFrame, lookback: int = 2, causal: bool = False) -> DataFrame:
    """Candles with the last swing high and low before them and the trend of the last four swings; with ``causal`` a swing
    counts only once the candles after it that make it one have closed."""
    s = swings(candles, lookback).withColumn("s", F.struct("type", "price"))
    four = Window.partitionBy("symbol").orderBy("c", "type").rowsBetween(-3, 0)
    s = s.withColumn("trend", trend_of(F.collect_list("s").over(four)))
    by = s.groupBy("symbol", "c").agg(
        F.max(F.when(F.col("type") == "high", F.col("price"))).alias("swing_high"), F.max(F.when(F.col("type") == "low", F.col("price"))).alias("swing_low"),
        F.max_by("trend", "type").alias("swing_trend"),
    )
    if causal:
        by = by.withColumn("c", F.col("c") + lookback)
    rows = candles.join(by, ["symbol", "c"], "left")
    return all_carried(rows, {"last_high": F.col("swing_high"), "last_low": F.col("swing_low"), "trend": F.col("swing_trend")}, "c", inclusive=causal)


def structure(candles: DataFrame, lookback: int = 2, causal: bool = False) -> DataFrame:
    """Breaks of structure, changes of character and liquidity sweeps: symbol, type, c, direction, level."""
    rows = with_structure(candles, lookback, causal)
    up, down = F.col("close") > F.col("last_high"), F.col("close") < F.col("last_low")
    kinds = F.array(
        F.when(up, F.struct(F.when(F.col("trend") == "down", "choch").otherwise("bos").alias("type"), F.lit("bullish").alias("direction"), F.col("last_high").alias("level"))),
        F.when(down, F.struct(F.when(F.col("trend") == "up", "choch").otherwise("bos").alias("type"), F.lit("bearish").alias("direction"), F.col("last_low").alias("level"))),
        F.when((F.col("high") > F.col("last_high")) & (F.col("close") < F.col("last_high")), F.struct(F.lit("liquiditySweep").alias("type"), F.lit("bearish").alias("direction"), F.col("last_high").alias("level"))),
        F.when((F.col("low") < F.col("last_low")) & (F.col("close") > F.col("last_low")), F.struct(F.lit("liquiditySweep").alias("type"), F.lit("bullish").alias("direction"), F.col("last_low").alias("level"))),
    )
    return rows.select("symbol", "c", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f")).select("symbol", "f.type", "c", "f.direction", "f.level")


def zones(candles: DataFrame, times: float = 2, mean_of: int = 10) -> DataFrame:
    """Fair value gaps and order blocks: symbol, type, c, direction, top, bottom, confirmed_at."""
    up, down = at("high", 1) < at("low", -1), at("low", 1) > at("high", -1)
    gap = F.when(up, F.struct(F.lit("bullish").alias("direction"), at("low", -1).alias("top"), at("high", 1).alias("bottom"))).when(
        down, F.struct(F.lit("bearish").alias("direction"), at("low", 1).alias("top"), at("high", -1).alias("bottom"))
    )
    rows = cut(candles, max(mean_of, 6), 1)
    gaps = rows.withColumn("f", gap).filter("own and f is not null").select("symbol", F.lit("fvg").alias("type"), "c", "f.direction", "f.top", "f.bottom", (F.col("c") + 1).alias("confirmed_at"))
    usual = F.avg(F.abs(F.col("close") - F.col("open"))).over(by_candle().rowsBetween(-mean_of, -1))
    moved = (F.col("c") >= mean_of) & (usual > 0) & (F.abs(F.col("close") - F.col("open")) >= times * usual)
    opposite = F.coalesce(*[F.when(bull(k) != bull(), F.struct((F.col("c") - k).alias("c"), top(k).alias("top"), bottom(k).alias("bottom"))) for k in range(1, 7)])
    blocks = rows.withColumn("f", F.when(moved, opposite)).withColumn("direction", _side(bull())).filter("own and f is not null")
    blocks = blocks.select("symbol", F.lit("orderBlock").alias("type"), "f.c", "direction", "f.top", "f.bottom", F.col("c").alias("confirmed_at"))
    return gaps.unionByName(blocks)


LABELS = {
    "engulfing": "Engulfing", "outsideBar": "Outside bar", "insideBar": "Inside bar", "pinBar": "Pin bar", "doji": "Doji", "bos": "Break of structure",
    "choch": "Change of character", "liquiditySweep": "Liquidity sweep", "fvg": "Fair value gap", "orderBlock": "Order block",
}


def scan(candles: DataFrame) -> DataFrame:
    """All findings with a label and a description."""
    found = candlesticks(candles)
    for more in (structure(candles), zones(candles)):
        found = found.unionByName(more.select("symbol", "type", "c", "direction"))
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return found.withColumn("label", names[F.col("type")]).withColumn(
        "description", F.when(F.col("direction") == "none", F.concat(F.col("label"), F.lit(" at candle "), F.col("c"))).otherwise(F.concat_ws(" ", F.initcap("direction"), F.lower("label"), F.lit("at candle"), F.col("c").cast("string")))
    )


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(js_round(100.0 * a / F.nullif(b, F.lit(0))), F.lit(0)).cast("long")


def _tally(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Outcomes of analogs by symbol: how many went on, turned or did neither within 0.1 %."""
    moved = over(F.col("after") - F.col("close"), F.col("close"))
    on, turned = (F.col("sign") * moved) > 0.001, (F.col("sign") * moved) < -0.001
    got = rows.groupBy("symbol").agg(F.count("*").alias("sample_size"), F.count_if(on).alias("continued"), F.count_if(turned).alias("reversed"))
    out = current.join(got, "symbol", "left").fillna(0, ["sample_size", "continued", "reversed"])
    return out.withColumn("neutral", F.col("sample_size") - F.col("continued") - F.col("reversed")).withColumns({"continued_pct": _share(F.col("continued"), F.col("sample_size")), "reversed_pct": _share(F.col("reversed"), F.col("sample_size"))})


def genome_analogs(candles: DataFrame, ahead: int = 6, most: float = 0.6, usual: int = 20) -> DataFrame:
    """How candles went on after three candles shaped like a symbol's last three."""
    span = F.col("high") - F.col("low")
    share = lambda x: F.coalesce(over(x, span), F.lit(0.0))
    rows = cut(_sized(candles), usual, ahead).withColumns({
        "body": share(F.abs(F.col("close") - F.col("open"))), "upper": share(F.col("high") - top()), "lower": share(bottom() - F.col("low")), "way": F.when(bull(), 1).otherwise(-1),
        "span": span, "mean": F.avg(span).over(by_candle().rowsBetween(-(usual - 1), 0)), "after": at("close", -ahead),
    })
    genes = [F.struct(*[at(x, k).alias(x) for x in ("body", "upper", "lower", "way")], over(at("span", k), F.col("mean")).alias("size")) for k in (2, 1, 0)]
    rows = own(rows.withColumn("genome", F.array(*genes)).withColumn("sign", F.col("way")))
    current = rows.filter("c = n - 1 and mean > 0 and n >= 39").select("symbol", F.col("genome").alias("now"), F.col("way").alias("current_direction"))

    def apart(a: Column, b: Column) -> Column:
        squares = sum(((a[x] - b[x]) * (a[x] - b[x]) for x in ("upper", "lower")), (a["body"] - b["body"]) * (a["body"] - b["body"]))
        return squares + F.least(F.lit(1.0), (a["size"] - b["size"]) * (a["size"] - b["size"]) / 4) + F.when(a["way"] != b["way"], 0.5).otherwise(0.0)

    like = rows.filter(f"c >= 22 and c < n - {ahead} and mean > 0").join(current, "symbol")
    far = F.aggregate(F.zip_with("genome", "now", apart), F.lit(0.0), lambda a, x: a + x)
    return _tally(like.filter(F.sqrt(far) <= most), current.drop("now"))


def _signatures(candles: DataFrame, size: int, lookback: int, ahead: int) -> DataFrame:
    """For the window of ``size`` candles that each candle ends: trend of its own swings, share of rising candles, move;
    also the same over the window and the ``ahead`` candles after it."""
    s = swings(candles, lookback).groupBy("symbol", "c").agg(F.sort_array(F.collect_list(F.struct("type", "price"))).alias("s"))
    rows = cut(_sized(candles).join(s, ["symbol", "c"], "left"), size, ahead)

    def trend(first: int, end: int) -> Column:
        inside = F.flatten(F.collect_list("s").over(by_candle().rowsBetween(first + lookback, end - lookback)))
        return trend_of(F.slice(inside, F.greatest(F.size(inside) - 3, F.lit(1)), F.lit(4)))

    whole = by_candle().rowsBetween(-(size - 1), 0)
    rising = F.count_if(bull()).over(whole)
    span = F.col("high") - F.col("low")
    move = over(F.col("close") - F.first("open").over(whole), F.first("open").over(whole))
    return own(rows.withColumns({
        "trend": trend(-(size - 1), 0), "trend_after": trend(-(size - 1), ahead), "ratio": rising / size, "skew": (2 * rising - size) / size, "move": F.coalesce(move, F.lit(0.0)),
        "volatility": F.coalesce(100 * over(F.stddev_pop(span).over(whole), F.avg(span).over(whole)), F.lit(0.0)), "after": at("close", -ahead),
    }))


def historical_analogs(candles: DataFrame, size: int = 12, ahead: int = 8, least: float = 0.75) -> DataFrame:
    """How candles went on after windows with the signature of a symbol's last ``size`` candles."""
    rows = _signatures(candles, size, 1, ahead).withColumn("sign", F.when(F.col("trend") == "up", 1).otherwise(-1))
    current = rows.filter("c = n - 1 and trend != 'none'").select("symbol", F.col("trend").alias("current_trend"), F.col("ratio").alias("r"), F.signum("move").alias("m"))
    like = rows.filter(f"c >= {size - 1} and c < n - {max(ahead, size)} and trend != 'none'").join(current, "symbol")
    alike = F.when(F.col("trend") == F.col("current_trend"), 0.5).otherwise(0.0) + F.when(F.signum("move") == F.col("m"), 0.3).otherwise(0.0) + 0.2 * (1 - F.abs(F.col("ratio") - F.col("r")))
    return _tally(like.filter(alike >= least), current.drop("r", "m"))


def similar_windows(candles: DataFrame, size: int = 12, ahead: int = 8, most: int = 8, far: float = 0.9) -> DataFrame:
    """The ``most`` windows nearest to a symbol's last one, nearest first, with what came of them."""
    rows = _signatures(candles, size, 2, ahead).filter("trend != 'none'")
    size_of = F.least(F.abs(F.col("move") * 100), F.lit(15.0)) / 15
    rows = rows.withColumns({"m": F.signum("move"), "mm": size_of, "v": F.least("volatility", F.lit(100.0)) / 100})
    names = ("trend", "m", "mm", "v", "skew")
    current = rows.filter("c = n - 1").select("symbol", *[F.col(x).alias(f"now_{x}") for x in names])
    off = lambda x: F.abs(F.col(x) - F.col(f"now_{x}"))
    distance = F.when(F.col("trend") == F.col("now_trend"), 0.0).otherwise(0.6) + off("m") * 0.15 + off("mm") * 0.5 + off("v") * 0.3 + off("skew") * 0.4
    like = rows.filter(f"c >= {size - 1} and c <= n - {size + ahead + 1}").join(current, "symbol").withColumn("distance", distance).filter(F.col("distance") <= far)
    w = Window.partitionBy("symbol").orderBy("distance", "c")
    outcome = F.when(F.col("trend_after") == "none", "inconclusive").when(F.col("trend_after") == F.col("trend"), "continued").otherwise("reversed")
    return like.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("symbol", "rank", (F.col("c") - (size - 1)).alias("start_index"), "distance", outcome.alias("outcome"))


def reach(candles: DataFrame, target: float = 1.05, ahead: int = 20) -> DataFrame:
    """How often ``ahead`` candles sufficed to move from the close by the fraction that ``target`` is from 1."""
    far = abs(target - 1)
    forward = by_candle().rowsBetween(1, ahead)
    hit = (F.max("high").over(forward) - F.col("close")) / F.col("close") if target >= 1 else (F.col("close") - F.min("low").over(forward)) / F.col("close")
    rows = own(cut(_sized(candles), 0, ahead).withColumn("hit", hit >= far)).filter(f"c < n - {ahead} and close != 0")
    return rows.groupBy("symbol").agg(js_round(F.least(F.greatest(100.0 * F.count_if("hit") / F.count("*"), F.lit(5.0)), F.lit(95.0))).alias("probability"), F.count("*").alias("sample_size"))
