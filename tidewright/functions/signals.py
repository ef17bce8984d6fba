"""Derived features, market-construct proxies, binary market states and observable contexts, as columns over chunks.

Every frame ends at the current row; the one variant that looks a tick ahead, for parity, says so in its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import full
from .windows import agg, back, chunked, frame, over, own, shared, stream, with_shared

HALO = 64


def _min(a: int, b: int, x: str = "price") -> Column:
    return agg("min", x, a, b)


def _max(a: int, b: int, x: str = "price") -> Column:
    return agg("max", x, a, b)


def _sd(a: int, b: int) -> Column:
    return F.when(_max(a, b) == _min(a, b), 0.0).otherwise(agg("stddev_pop", "price", a, b))


def _at(k: int, x: str = "price") -> Column:
    return back(x, k)


def prepare(ticks: DataFrame, seconds: int = 86_400, size: int | None = None, halo: int = HALO) -> DataFrame:
    """Ticks with their change, direction, running candle of a bucket of ``seconds`` and time in milliseconds. The
    running candle needs its whole bucket, so it is made before rows are cut into chunks."""
    from pyspark.sql import Window

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    start = F.floor(ms / 1000 / seconds) * seconds
    rows = ticks.withColumn("ms", ms).withColumn("candle_start", start).withColumn("candle_end", start + seconds)
    so_far = Window.partitionBy("symbol", "candle_start").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"candle_open": F.first("price").over(so_far), "candle_high": F.max("price").over(so_far), "candle_low": F.min("price").over(so_far)})
    rows = chunked(rows, halo, 1, **({"size": size} if size else {}))
    rows = rows.withColumn("d", F.col("price") - F.lag("price").over(stream()))
    return rows.withColumn("candle_range", F.col("candle_high") - F.col("candle_low"))


def histogram_entropy(n: int, bins: int) -> Column:
    """Entropy in bits of a window's values in bins of equal width; a constant window has none."""
    lo, hi = agg("min", "price", 1 - n), agg("max", "price", 1 - n)
    places = F.transform(agg("collect_list", "price", 1 - n), lambda x: F.least(F.floor((x - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))), F.lit(bins - 1)).cast("int"))
    share = lambda b: F.size(F.filter(places, lambda p: p == b)) / F.lit(float(n))
    total = sum((F.when(share(b) > 0, -share(b) * F.log2(share(b))).otherwise(0.0) for b in range(bins)), F.lit(0.0))
    return full(n, F.when(hi == lo, 0.0).otherwise(total))


DERIVED = {
    "rolling_variance": lambda: full(20, F.when(_max(-19, 0) == _min(-19, 0), 0.0).otherwise(agg("var_samp", "price", 1 - 20))),
    "rolling_entropy": lambda: histogram_entropy(20, 5),
    "rolling_slope": lambda: full(10, sum((_at(9 - k) * ((k - 4.5) / 82.5) for k in range(10)), F.lit(0.0))),
    "rolling_acceleration": lambda: full(10, (F.col("d") - _at(8, "d")) / 8),
    "candle_position_normalized": lambda: over(F.col("price") - F.col("candle_low"), F.col("candle_range")),
}

SURGE = lambda: over(over(F.lit(5.0), (F.col("ms") - _at(5, "ms")).cast("double")), over(F.lit(20.0), (F.col("ms") - _at(20, "ms")).cast("double")))


def _expansion(n: int) -> Column:
    return over(F.col("candle_range"), agg("avg", "candle_range", -n, -1))


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


PROXIES = {
    "local_minimum": lambda: F.when(F.col("i") >= 1, _flag(F.col("price") < _min(-10, -1))).otherwise(0),
    "local_maximum": lambda: F.when(F.col("i") >= 1, _flag(F.col("price") > _max(-10, -1))).otherwise(0),
    "local_extremum": lambda: F.when(F.col("i") >= 1, _flag((F.col("price") < _min(-10, -1)) | (F.col("price") > _max(-10, -1)))).otherwise(0),
    "volatility_ratio": lambda: full(20, over(agg("var_samp", "price", 1 - 5), agg("var_samp", "price", 1 - 20))),
    "volatility_spike": lambda: full(20, _flag(over(agg("var_samp", "price", 1 - 5), agg("var_samp", "price", 1 - 20)) > 2)),
    "range_expansion": lambda: F.when(F.col("i") >= 10, _expansion(10)),
    "tick_rate_surge": lambda: F.when(F.col("i") >= 20, SURGE()),
    "compression_release": lambda: full(15, F.when(
        _max(-14, -5) > _min(-14, -5), _flag(_max(-4, 0) - _min(-4, 0) > 2 * (_max(-14, -5) - _min(-14, -5))))),
    "activity_burst": lambda: F.when(F.col("i") >= 20, _flag((SURGE() > 2) & (_expansion(20) > 1.5))),
}


def _move() -> Column:
    return F.abs(F.col("price") - _at(19))


def _halves() -> tuple[Column, Column]:
    """Moves of the two halves of a window of 20."""
    return _at(10) - _at(19), F.col("price") - _at(9)


def _sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def _up_share(a: int, b: int) -> Column:
    name = f"{a}_{b}".replace("-", "m")
    up = shared(f"_ups_{name}", lambda: F.count_if(F.col("d") > 0).over(frame(a, b)))
    down = shared(f"_downs_{name}", lambda: F.count_if(F.col("d") < 0).over(frame(a, b)))
    return F.coalesce(up / F.nullif(up + down, F.lit(0)), F.lit(0.5))


def _trending(a: int, b: int, move: Column) -> Column:
    return (_sd(a, b) > 0) & (F.abs(move) > 0.5 * _sd(a, b))


def _crossings() -> Column:
    mean = agg("avg", "price", 1 - 20)
    sides = F.transform(agg("collect_list", "price", 1 - 20), lambda x: x - mean)
    return F.size(F.filter(F.zip_with(F.slice(sides, 1, 19), F.slice(sides, 2, 19), lambda a, b: a * b), lambda p: p < 0))


def _state(c: Column) -> Column:
    return full(20, _flag(F.coalesce(c, F.lit(False))))


def _shifted() -> Column:
    a, b = _sd(-19, -10), _sd(-9, 0)
    return F.when(a == 0, b > 0).otherwise((over(b, a) > 1.75) | (over(b, a) < 0.57))


def _flips() -> Column:
    """Sign changes over three thirds of six ticks each."""
    x, y, z = (_sign(_at(12) - _at(18)), _sign(_at(6) - _at(12)), _sign(F.col("price") - _at(6)))
    flip = lambda a, b: F.when((a != 0) & (b != 0) & (a != b), 1).otherwise(0)
    return flip(x, y) + flip(y, z)


STATES = {
    "trend": lambda: _state((_sd(-19, 0) > 0) & (_move() > 0.5 * _sd(-19, 0))),
    "ranging": lambda: _state(F.when(_sd(-19, 0) == 0, F.col("price") == _at(19)).otherwise(_move() < 0.25 * _sd(-19, 0))),
    "high_volatility": lambda: _state(over(_sd(-19, 0), F.abs(agg("avg", "price", 1 - 20))) > 0.02),
    "low_volatility": lambda: _state(over(_sd(-19, 0), F.abs(agg("avg", "price", 1 - 20))) < 0.002),
    "compression": lambda: _state((_sd(-19, -10) > 0) & (_sd(-9, 0) < 0.5 * _sd(-19, -10))),
    "expansion": lambda: _state(_sd(-9, 0) > 2 * _sd(-19, -10)),
    "persistence": lambda: _state(_sign(_halves()[0]) * _sign(_halves()[1]) > 0),
    "reversal": lambda: _state(_sign(_halves()[0]) * _sign(_halves()[1]) < 0),
    "oscillation": lambda: _state(_crossings() >= 3),
    "drift": lambda: _state((_sd(-19, 0) > 0) & _move().between(0.25 * _sd(-19, 0), 0.5 * _sd(-19, 0))),
    "regime_transition": lambda: _state(_trending(-19, -10, _halves()[0]) != _trending(-9, 0, _halves()[1])),
    "mean_reversion": lambda: _state(
        F.abs(F.col("price") - agg("avg", "price", 1 - 20))
        < 0.3 * F.greatest(_max(-19, 0) - agg("avg", "price", 1 - 20), agg("avg", "price", 1 - 20) - _min(-19, 0))),
    "low_persistence": lambda: _state(_flips() >= 2),
    "volatility_shift": lambda: _state(_shifted()),
    "entropy_shift": lambda: _state(F.abs(_up_share(-19, -10) - _up_share(-9, 0)) > 0.3),
    "entropy_shift_looks_ahead": lambda: _state(F.abs(_up_share(-18, -9) - _up_share(-8, 1)) > 0.3),
}


def active(state: str) -> Column:
    return F.when(F.col(state).isNull(), "UNKNOWN").when(F.col(state) == 1, "ACTIVE").otherwise("INACTIVE")


def _third(x: Column, names: tuple[str, str, str]) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(x < 0.33, names[0]).when(x < 0.67, names[1]).otherwise(names[2])


def contexts() -> dict[str, Column]:
    """Over rows that have STATES and ``momentum``."""
    place = over(F.col("price") - F.col("candle_low"), F.col("candle_range"))
    part = over(F.col("ms") / 1000.0 - F.col("candle_start"), (F.col("candle_end") - F.col("candle_start")).cast("double"))
    hour = F.floor(F.col("ms") / 3_600_000) % 24
    return {
        "candle_position": F.when(F.col("candle_range") <= 0, "UNKNOWN").otherwise(_third(place, ("LOWER", "MIDDLE", "UPPER"))),
        "candle_timing": _third(part, ("EARLY", "MID", "LATE")),
        "market_session": F.when(hour < 8, "ASIA").when(hour < 16, "EUROPE").when(hour < 21, "US").otherwise("OFF_HOURS"),
        "volatility_state": F.when(F.col("high_volatility").isNull(), "UNKNOWN").when(F.col("high_volatility") == 1, "HIGH").when(F.col("low_volatility") == 1, "LOW").otherwise("NORMAL"),
        "trend_state": active("trend"), "compression_state": active("compression"), "expansion_state": active("expansion"), "range_state": active("ranging"),
        "momentum_state": F.when(F.col("momentum").isNull(), "UNKNOWN").when(F.col("momentum") > 0, "POSITIVE").when(F.col("momentum") < 0, "NEGATIVE").otherwise("FLAT"),
    }


def _added(ticks: DataFrame, columns: dict, size: int | None) -> DataFrame:
    return own(with_shared(prepare(ticks, size=size), columns))


def derived(ticks: DataFrame, size: int | None = None) -> DataFrame:
    return _added(ticks, DERIVED, size)


def proxies(ticks: DataFrame, size: int | None = None) -> DataFrame:
    return _added(ticks, PROXIES, size)


def states(ticks: DataFrame, size: int | None = None) -> DataFrame:
    return _added(ticks, STATES, size)


def observed(ticks: DataFrame, size: int | None = None) -> DataFrame:
    """Ticks with their contexts."""
    rows = states(ticks, size)
    rows = own(chunked(rows, 10, **({"size": size} if size else {})).withColumn("momentum", F.col("price") - F.lag("price", 10).over(stream())))
    return rows.withColumns(contexts())


def prior_candle(ticks: DataFrame, seconds: int = 86_400) -> DataFrame:
    """What the candle before that of each tick was like: ticks are grouped to candles, and these, far fewer, shifted by
    one and joined back."""
    from pyspark.sql import Window

    rows = ticks.withColumn("candle_start", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000 / seconds) * seconds)
    c = rows.groupBy("symbol", "candle_start").agg(
        F.min_by("price", "i").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "i").alias("close")
    )
    span = F.col("high") - F.col("low")
    what = F.struct(
        F.when(span == 0, "DOJI").when(F.col("close") > F.col("open"), "BULLISH").when(F.col("close") < F.col("open"), "BEARISH").otherwise("DOJI").alias("direction"),
        span.alias("range"), over(F.abs(F.col("close") - F.col("open")), span).alias("body"), over(F.col("high") - F.greatest("open", "close"), span).alias("upper_wick"),
        over(F.least("open", "close") - F.col("low"), span).alias("lower_wick"), over(F.col("close") - F.col("low"), span).alias("close_position"),
    )
    prior = c.select("symbol", "candle_start", F.lag(what).over(Window.partitionBy("symbol").orderBy("candle_start")).alias("p"))
    out = rows.join(prior, ["symbol", "candle_start"])
    return out.select("symbol", "i", "candle_start", F.coalesce("p.direction", F.lit("UNKNOWN")).alias("prior_direction"), *[
        F.col(f"p.{x}").alias(f"prior_{x}") for x in ("range", "body", "upper_wick", "lower_wick", "close_position")
    ])


def clusters(ticks: DataFrame) -> DataFrame:
    """Lengths of the streak of rises or falls that a tick ends."""
    from .indicators import run_lengths

    rows = run_lengths(ticks)
    return rows.select("symbol", "i", F.when(F.col("sign") == 1, F.col("run_length")).otherwise(0).alias("up_cluster"), F.when(F.col("sign") == -1, F.col("run_length")).otherwise(0).alias("down_cluster"))
