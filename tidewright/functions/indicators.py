"""The technical indicators of one price stream. A value is null until its window is full.

Those with bounded windows are columns over chunks; the recursively smoothed ones run in one grouped function over the
same chunks, with a halo after which what came before has no weight left in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .windows import CHUNK, agg, back, chunked, last, over, own, shared, stream, with_shared

HALO = 64
#: Rows before a chunk of recursive averages at least, and for each step of a period: a Wilder average keeps less than 1e-50 of
#: what came before 115 periods, one of averages little more.
LONG_HALO, HALO_PERIODS = 2_000, 125


def full(n: int, value: Column) -> Column:
    return F.when(F.col("i") >= n - 1, value)


def entropy2(*shares: Column) -> Column:
    """Entropy in bits of shares that add up to 1."""
    total = F.lit(0.0)
    for p in shares:
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def _counts(n: int) -> tuple[Column, Column, Column]:
    d = F.col("d")
    tests = {"up": d > 0, "down": d < 0, "still": d == 0}
    return tuple(shared(f"_{k}_{n}", lambda c=c: F.sum(F.when(c, 1).otherwise(0)).over(last(n)).cast("double")) for k, c in tests.items())


def flat(n: int, x: str) -> Column:
    """Whether all values of the window are equal; the zero test of every deviation."""
    return agg("max", x, 1 - n) == agg("min", x, 1 - n)


def sma(n: int) -> Column:
    return full(n, agg("avg", "price", 1 - n))


def wma(n: int) -> Column:
    total = sum((back("price", n - k) * k for k in range(1, n)), F.col("price") * n)
    return full(n, total / (n * (n + 1) / 2))


def cci(n: int) -> Column:
    mean = agg("avg", "price", 1 - n)
    off = F.aggregate(agg("collect_list", "price", 1 - n), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return full(n, F.when(flat(n, "price"), 0.0).otherwise(over(F.col("price") - mean, 0.015 * off)))


def momentum(n: int) -> Column:
    return F.col("price") - back("price", n)


def roc(n: int) -> Column:
    return 100 * over(momentum(n), back("price", n))


def sd(n: int, x: str = "price") -> Column:
    return F.when(flat(n, x), 0.0).otherwise(agg("stddev_pop", x, 1 - n))


def bollinger_width(n: int, k: float = 2) -> Column:
    return full(n, over(2 * k * sd(n), agg("avg", "price", 1 - n)))


def bollinger_position(n: int, k: float = 2) -> Column:
    mean = agg("avg", "price", 1 - n)
    return full(n, F.when(~flat(n, "price"), over(F.col("price") - (mean - k * sd(n)), 2 * k * sd(n))))


def zscore(n: int) -> Column:
    return full(n, F.when(~flat(n, "price"), over(F.col("price") - agg("avg", "price", 1 - n), sd(n))))


def value_range(n: int) -> Column:
    return full(n, agg("max", "price", 1 - n) - agg("min", "price", 1 - n))


def tick_entropy(n: int) -> Column:
    return full(n + 1, entropy2(*[c / n for c in _counts(n)]))


def directional_entropy(n: int) -> Column:
    up, down, _ = _counts(n)
    return full(n + 1, F.when(up + down > 0, entropy2(over(up, up + down), over(down, up + down))))


def tick_imbalance(n: int) -> Column:
    up, down, _ = _counts(n)
    return full(n + 1, (up - down) / n)


def hurst(n: int) -> Column:
    """From the rescaled range of one window of changes."""
    w = agg("collect_list", "d", 1 - n)
    mean = agg("avg", "d", 1 - n)
    acc = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a: Column, x: Column) -> Column:
        c = a["c"] + x - mean
        return F.struct(c.alias("c"), F.least(a["lo"], c).alias("lo"), F.greatest(a["hi"], c).alias("hi"))

    spread = F.aggregate(w, acc, step, lambda a: a["hi"] - a["lo"])
    return full(n + 1, F.when(~flat(n, "d"), F.log(over(spread, sd(n, "d"))) / F.log(F.lit(float(n)))))


def stochastic(n: int) -> Column:
    lo, hi = agg("min", "price", 1 - n), agg("max", "price", 1 - n)
    return full(n, F.when(hi == lo, 50.0).otherwise(100 * over(F.col("price") - lo, hi - lo)))


def autocorrelation(n: int) -> Column:
    """Of n - 1 pairs of neighbouring changes."""
    cov = F.covar_pop("d_before", "d").over(last(n - 1))
    zero = (agg("max", "d", 2 - n) == agg("min", "d", 2 - n)) | (agg("max", "d_before", 2 - n) == agg("min", "d_before", 2 - n))
    return full(n + 1, F.when(zero, 0.0).otherwise(over(cov, agg("stddev_pop", "d", 2 - n) * agg("stddev_pop", "d_before", 2 - n))))


def skew(n: int) -> Column:
    return full(n + 1, F.when(flat(n, "d"), 0.0).otherwise(agg("skewness", "d", 1 - n)))


def excess_kurtosis(n: int) -> Column:
    return full(n + 1, F.when(flat(n, "d"), -3.0).otherwise(agg("kurtosis", "d", 1 - n)))


#: Registered indicators with bounded windows: builder and default period.
WINDOWED = {
    "sma": (sma, 14), "wma": (wma, 14), "cci": (cci, 20), "momentum": (momentum, 10), "roc": (roc, 10),
    "bollinger_width": (bollinger_width, 20), "bollinger_position": (bollinger_position, 20),
    "volatility": (lambda n: full(n, sd(n, "d0")), 14), "range": (value_range, 14), "zscore": (zscore, 20), "entropy": (tick_entropy, 20),
    "hurst": (hurst, 30), "fractal_dimension": (lambda n: 2 - hurst(n), 30), "tick_imbalance": (tick_imbalance, 20),
    "directional_entropy": (directional_entropy, 20), "stochastic_k": (stochastic, 14), "autocorrelation": (autocorrelation, 20),
    "skewness": (skew, 20), "kurtosis": (excess_kurtosis, 20),
}


def prepare(ticks: DataFrame, halo: int = HALO, size: int | None = None) -> DataFrame:
    """Chunks with the change d, null at the first tick, d0, 0 there, and the change before."""
    rows = chunked(ticks, halo, **({"size": size} if size else {}))
    rows = rows.withColumn("d", F.col("price") - F.lag("price").over(stream())).withColumn("d0", F.coalesce("d", F.lit(0.0)))
    return rows.withColumn("d_before", F.lag("d").over(stream()))


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """The windows of ``n`` values, a row for each place from the ``n``-th value on."""
    return sliding_window_view(x, n) if len(x) >= n else np.empty((0, n))


def _late(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` of the last places of ``size``; those before are unknown."""
    return np.concatenate([np.full(size - len(values), np.nan), values])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b``, unknown where b is 0."""
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


def _flat(w: np.ndarray) -> np.ndarray:
    return w.max(axis=1) == w.min(axis=1)


def _spread(w: np.ndarray) -> np.ndarray:
    return np.where(_flat(w), 0.0, w.std(axis=1))


def _bits(*shares: np.ndarray) -> np.ndarray:
    return -sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0) for p in shares)


def _on_prices(f):
    """An indicator of windows of prices, known from the first full one on."""
    return lambda price, n: _late(f(_windows(price, n), price[n - 1 :], n), len(price))


def _on_moves(f):
    """An indicator of windows of ``n`` moves, of which the first price has none."""
    return lambda price, n: _late(f(_windows(np.diff(price), n), n), len(price))


def _directions(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (w > 0).sum(axis=1).astype("f8"), (w < 0).sum(axis=1).astype("f8")


def _cci(w: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    mean = w.mean(axis=1)
    return np.where(_flat(w), 0.0, _ratio(p - mean, 0.015 * np.abs(w - mean[:, None]).mean(axis=1)))


def _hurst(w: np.ndarray, n: int) -> np.ndarray:
    path = np.cumsum(w - w.mean(axis=1)[:, None], axis=1)
    scaled = _ratio(path.max(axis=1) - path.min(axis=1), _spread(w))
    return np.log(np.where(scaled > 0, scaled, np.nan)) / math.log(n)


def _entropy(w: np.ndarray, n: int) -> np.ndarray:
    up, down = _directions(w)
    return _bits(up / n, down / n, (n - up - down) / n)


def _directional(w: np.ndarray, n: int) -> np.ndarray:
    up, down = _directions(w)
    return np.where(up + down > 0, _bits(_ratio(up, up + down), _ratio(down, up + down)), np.nan)


def _moment(w: np.ndarray, k: int, flat: float, less: float) -> np.ndarray:
    c = w - w.mean(axis=1)[:, None]
    return np.where(_flat(w), flat, _ratio((c**k).mean(axis=1), _spread(w) ** k) - less)


def _neighbours(w: np.ndarray, n: int) -> np.ndarray:
    """Correlation of the ``n - 1`` pairs of neighbouring moves."""
    a, b = w[:, :-1], w[:, 1:]
    cov = ((a - a.mean(axis=1)[:, None]) * (b - b.mean(axis=1)[:, None])).mean(axis=1)
    return np.where(_flat(a) | _flat(b), 0.0, _ratio(cov, _spread(a) * _spread(b)))


def _back(price: np.ndarray, n: int) -> np.ndarray:
    return _late(price[:-n], len(price)) if len(price) > n else np.full(len(price), np.nan)


#: The indicators of WINDOWED over the prices of a chunk. Columns of frames, above, are for use among other columns; over whole
#: streams arrays of windows are many times faster, as Spark adds up a sliding frame anew for each row.
ROLLING = {
    "sma": _on_prices(lambda w, p, n: w.mean(axis=1)), "wma": _on_prices(lambda w, p, n: w @ np.arange(1.0, n + 1) / (n * (n + 1) / 2)), "cci": _on_prices(_cci),
    "momentum": lambda price, n: price - _back(price, n), "roc": lambda price, n: 100 * _ratio(price - _back(price, n), _back(price, n)),
    "bollinger_width": _on_prices(lambda w, p, n: _ratio(4 * _spread(w), w.mean(axis=1))), "bollinger_position": _on_prices(lambda w, p, n: _ratio(p - (w.mean(axis=1) - 2 * _spread(w)), 4 * _spread(w))),
    "volatility": lambda price, n: _late(_spread(_windows(np.diff(price, prepend=price[:1]), n)), len(price)), "range": _on_prices(lambda w, p, n: w.max(axis=1) - w.min(axis=1)),
    "zscore": _on_prices(lambda w, p, n: _ratio(p - w.mean(axis=1), _spread(w))), "entropy": _on_moves(_entropy), "hurst": _on_moves(_hurst), "fractal_dimension": _on_moves(lambda w, n: 2 - _hurst(w, n)),
    "tick_imbalance": _on_moves(lambda w, n: ((w > 0).sum(axis=1) - (w < 0).sum(axis=1)) / n), "directional_entropy": _on_moves(_directional),
    "stochastic_k": _on_prices(lambda w, p, n: np.where(_flat(w), 50.0, 100 * _ratio(p - w.min(axis=1), w.max(axis=1) - w.min(axis=1)))),
    "autocorrelation": _on_moves(_neighbours), "skewness": _on_moves(lambda w, n: _moment(w, 3, 0.0, 0.0)), "kurtosis": _on_moves(lambda w, n: _moment(w, 4, -3.0, 3.0)),
}


def with_rolling(rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """The own ``rows`` of chunks (symbol, chunk, own, i, price) with a column for each of ``wanted``, name: (indicator, period), null
    until its window is full. A chunk is a bounded group; where windows over chunks come before, no row moves again."""
    schema = StructType([*rows.schema, *[StructField(n, DoubleType()) for n in wanted]])

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        price = chunk.column("price").to_numpy().astype("f8")
        for name, (kind, n) in wanted.items():
            values = ROLLING[kind](price, n)
            chunk = chunk.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return chunk.filter(chunk.column("own"))

    return rows.groupBy("symbol", "chunk").applyInArrow(run, schema)


def windowed(ticks: DataFrame, names: list[str] | None = None, size: int | None = None, **periods: int) -> DataFrame:
    """``ticks`` with a column for each indicator; ``periods`` overrides the defaults."""
    names = names or list(WINDOWED)
    halo = 2 * max(periods.get(n, WINDOWED[n][1]) for n in names) + 4
    rows = with_rolling(chunked(ticks, halo, **({"size": size} if size else {})), {n: (n, periods.get(n, WINDOWED[n][1])) for n in names})
    return rows.select(*ticks.columns, *names)


def _ema(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()


def _divide(a: np.ndarray, b: np.ndarray, zero: float) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), zero), where=b != 0)


def _wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first ``n`` changes, then each counts one n-th; the change at 0 doesn't exist."""
    out = np.full(len(x), np.nan)
    if len(x) > n:
        seeded = np.concatenate([[x[1 : n + 1].mean()], x[n + 1 :]])
        out[n:] = pd.Series(seeded).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def smooth(p: np.ndarray, first: bool, n: int = 14) -> dict[str, np.ndarray]:
    """The recursive indicators of a stream of prices; ``first`` says whether it is the stream's true beginning."""
    d = np.diff(p, prepend=p[:1])
    e = _ema(p, n)
    slope = np.diff(e, prepend=np.nan)
    line = _ema(p, 12) - _ema(p, 26)
    gain, loss = _wilder(np.maximum(d, 0), n), _wilder(np.maximum(-d, 0), n)
    rs = _divide(gain, loss, np.inf)
    true_range = np.abs(d)
    tr = _ema(true_range, n)
    plus = 100 * _divide(_ema(np.maximum(d, 0), n), tr, 0.0)
    minus = 100 * _divide(_ema(np.maximum(-d, 0), n), tr, 0.0)
    mean20 = pd.Series(p).rolling(20).mean().to_numpy()
    return {
        "ema": e, "ema_slope": slope, "macd": line - _ema(line, 9),
        "rsi": np.where(np.isnan(gain), np.nan, 100 - 100 / (1 + rs)),
        "adx": _ema(100 * _divide(np.abs(plus - minus), plus + minus, 0.0), n), "atr": tr,
        "keltner_width": np.where(mean20 != 0, _divide(2 * _ema(true_range, 20), mean20, np.nan), np.nan),
    }


RECURSIVE = ("ema", "ema_slope", "macd", "rsi", "adx", "atr", "keltner_width")


def recursive_chunks(ticks: DataFrame, period: int, size: int | None = None) -> DataFrame:
    """``ticks`` (symbol, i, price) in chunks whose halo outlasts the memory of averages of ``period``; chunks are longer than it."""
    halo = max(LONG_HALO, HALO_PERIODS * period)
    return chunked(ticks.select("symbol", "i", "price"), halo, size=size or max(5 * CHUNK, 2 * halo))


def recursive(ticks: DataFrame, size: int | None = None, period: int = 14) -> DataFrame:
    """``ticks`` (symbol, i, price) with the recursively smoothed indicators."""
    rows = recursive_chunks(ticks, period, size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        for name, values in smooth(part["price"].to_numpy(), bool(part["i"].iat[0] == 0), period).items():
            part[name] = pd.array(values, dtype="Float64")
            part.loc[np.isnan(values), name] = pd.NA
        return part[part["own"]][["symbol", "i", "price", *RECURSIVE]]

    fields = "symbol string, i long, price double, " + ", ".join(f"{n} double" for n in RECURSIVE)
    return rows.groupBy("symbol", "chunk").applyInPandas(run, fields)


def run_lengths(ticks: DataFrame, size: int | None = None) -> DataFrame:
    """``ticks`` with d, its sign and run_length, the number of moves in a row with one sign; a flat move is 1.

    Runs have no bounded length: a run begins where the sign changes, and a move's place in its run is its distance from
    the latest beginning, which is carried over chunks."""
    from .scans import carried

    size = {"size": size} if size else {}
    rows = chunked(ticks, 2, **size).withColumn("d", F.col("price") - F.lag("price").over(stream())).withColumn("sign", F.signum("d").cast("int"))
    begins = F.when(F.col("sign").isNotNull() & ((F.col("sign") == 0) | ~F.col("sign").eqNullSafe(F.lag("sign").over(stream()))), F.col("i"))
    rows = own(rows.withColumn("_begins", begins))
    rows = carried(rows, F.col("_begins"), "run_start", **size).drop("_begins")
    return rows.withColumn("run_length", F.when(F.col("sign").isNotNull(), F.col("i") - F.col("run_start") + 1))
