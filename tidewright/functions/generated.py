"""The generated features: 178 columns over the indicators of the last three ticks.

A tick's indicators are read at three places, 3 (two ticks ago), 2 and 1 (now). Families are written as rules over
indicator names; a feature is null where an indicator it needs is, but means, counts and votes leave nulls out. Features
are keyed by number, as some share a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import Values, coalesce, greatest, least, nullif, signum, size, when
from .indicators import LONG_HALO, _divide, _ema, _wilder
from .windows import CHUNK, chunked, own, stream

KEYS = ("price", "macd", "signal", "hist", "chop", "cci", "pctb", "upper", "lower", "mid", "pdi", "ndi", "adx", "rsi", "atr", "stoch", "stoch_d", "roc", "ema5", "ema10", "ema20")
NOW = (3, 2, 1)


def windows(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` of each window of ``n`` values, each by itself: running sums would carry the rounding of values long gone."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, n))
    return out


def snapshot(p: np.ndarray) -> dict[str, np.ndarray]:
    """The indicators of each tick of a stream of prices."""
    s, d = pd.Series(p), np.diff(p, prepend=p[:1])
    tr = _ema(np.abs(d), 14)
    macd = _ema(p, 12) - _ema(p, 26)
    signal = _ema(macd, 9)
    pdi, ndi = (100 * _divide(_ema(np.maximum(x, 0), 14), tr, 0.0) for x in (d, -d))
    still = lambda w: w.max(axis=1) == w.min(axis=1)
    mid, sd = windows(p, 20, lambda w: w.mean(axis=1)), windows(p, 20, lambda w: np.where(still(w), 0.0, w.std(axis=1)))
    lo, hi = s.rolling(14).min().to_numpy(), s.rolling(14).max().to_numpy()
    stoch = np.where(hi > lo, 100 * _divide(p - lo, hi - lo, 0.5), np.where(np.isnan(hi), np.nan, 50.0))
    off = windows(p, 20, lambda w: np.where(still(w), 0.0, np.abs(w - w.mean(axis=1)[:, None]).mean(axis=1)))
    gain, loss = _wilder(np.maximum(d, 0), 14), _wilder(np.maximum(-d, 0), 14)
    moved = windows(np.abs(d), 14, lambda w: w.sum(axis=1))
    chop = 100 * np.log10(np.maximum(_divide(moved, hi - lo, np.nan), 1e-12)) / np.log10(14)
    with np.errstate(invalid="ignore"):
        return {
            "macd": macd, "signal": signal, "hist": macd - signal, "chop": chop, "cci": np.where(off > 0, _divide(p - mid, 0.015 * off, 0.0), np.where(np.isnan(off), np.nan, 0.0)),
            "pctb": _divide(p - (mid - 2 * sd), 4 * sd, np.nan), "upper": mid + 2 * sd, "lower": mid - 2 * sd, "mid": mid, "pdi": pdi, "ndi": ndi,
            "adx": _ema(100 * _divide(np.abs(pdi - ndi), pdi + ndi, 0.0), 14), "rsi": np.where(np.isnan(gain), np.nan, 100 - 100 / (1 + _divide(gain, loss, np.inf))), "atr": tr,
            "stoch": stoch, "stoch_d": windows(stoch, 3, lambda w: w.mean(axis=1)), "roc": 100 * _divide(p - s.shift(10).to_numpy(), s.shift(10).to_numpy(), np.nan),
            "ema5": _ema(p, 5), "ema10": _ema(p, 10), "ema20": _ema(p, 20),
        }


def _in_chunks(ticks: DataFrame, keep: tuple[str, ...], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """symbol, i and what is to ``keep`` of ``ticks`` with ``columns``, name: (one of KEYS, how many ticks before), null where missing."""
    rows = chunked(ticks.select("symbol", "i", "price", *keep), LONG_HALO)
    schema = StructType([*(rows.schema[c] for c in ("symbol", "i", *keep)), *(StructField(n, DoubleType()) for n in columns)])

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        price = chunk.column("price").to_numpy().astype("f8")
        made = {"price": price, **snapshot(price)}
        out = chunk.select(["symbol", "i", *keep])
        for name, (key, back) in columns.items():
            # a chunk has more ticks before its own than features look back
            x = np.concatenate([np.full(min(back, len(price)), np.nan), made[key][: max(len(price) - back, 0)]])
            out = out.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(x) if key == "price" else ~np.isfinite(x)))
        return out.filter(chunk.column("own"))

    return rows.groupBy("symbol", "chunk").applyInArrow(run, schema)


def snapshots(ticks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``ticks`` with a column for each of KEYS; missing values are null. Columns to ``keep`` come along."""
    return _in_chunks(ticks, keep, {k: (k, 0) for k in KEYS})


def v(key: str, at: int) -> Column:
    return F.col(f"{key}_{at}")


def slope(f, a: int, b: int) -> Column:
    return f(b) - f(a)


def bend(f) -> Column:
    return (f(1) - f(2)) - (f(2) - f(3))


def known(values: list[Column]) -> Column:
    """How many aren't null. Like the other rules on three places it is plain arithmetic: functions of arrays are interpreted, row by row."""
    return reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in values])


def plus(values: list[Column]) -> Column:
    """The sum of those that aren't null, 0 if all are."""
    return reduce(lambda a, b: a + b, [coalesce(x, 0.0) for x in values], 0.0)


def mean(values: list[Column]) -> Column:
    return plus(values) / nullif(known(values), 0)


def spread(values: list[Column]) -> Column:
    return greatest(*values) - least(*values)


def between(values: list[Column], test) -> list[Column]:
    """``test`` of each two neighbours among the three ``values`` that aren't null; it is null for pairs that are none."""
    a, b, c = values
    return [test(a, b), test(b, c), when(b.isNull(), test(a, c))]


def clamped(a: Column, b: Column) -> Column:
    """``a / b`` within 3 on either side; null where ``b`` is almost 0 or ``a`` is null, which least and greatest would
    pass over."""
    return when((size(b) > 1e-9) & a.isNotNull(), greatest(least(a / nullif(b, 0.0), 3.0), -3.0))


def sign(x: Column) -> Column:
    return signum(x)


def flag(c: Column) -> Column:
    return c.cast("double")


def all_of(f, test) -> Column:
    return flag(reduce(lambda a, b: a & b, [coalesce(test(f(k)), False) for k in NOW]))


def crossed(f) -> list[Column]:
    """For each of the two steps whether the sign of ``f`` changes; not where it is missing."""
    return [coalesce(sign(f(a)) != sign(f(b)), False) for a, b in ((3, 2), (2, 1))]


def total(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("double") for c in flags])


def opposed(price, indicator) -> Column:
    """1 where the price falls while the indicator rises, -1 the other way round, else 0."""
    p, x = slope(price, 3, 1), slope(indicator, 3, 1)
    return when(p.isNotNull() & x.isNotNull(), when((p < 0) & (x > 0), 1.0).when((p > 0) & (x < 0), -1.0).otherwise(0.0))


def definitions(v=v) -> list[tuple[str, str, Column]]:
    """(label, family, column) of each feature, in order of its number; ``v`` gives an indicator at a place, as a column or as Values."""
    out: list[tuple[str, str, Column]] = []

    def of(key: str):
        return lambda at: v(key, at)

    def less(a: str, b: str):
        return lambda at: v(a, at) - v(b, at)

    def add(family: str, **features: Column) -> None:
        out.extend((label, family, c) for label, c in features.items())

    width, di, gap, k_d = less("upper", "lower"), less("pdi", "ndi"), less("macd", "signal"), less("stoch", "stoch_d")
    p_mid, price, at_mean = less("price", "mid"), of("price"), lambda key: mean([v(key, k) for k in NOW])
    centred = lambda key, c: lambda at: v(key, at) - c
    for key in ("macd", "signal", "hist", "chop", "cci", "pctb", "pdi", "ndi", "adx", "rsi", "atr", "stoch", "roc", "ema5", "ema20"):
        for a, b in ((3, 2), (2, 1), (3, 1)):
            add("Slope", **{f"{key} slope {a}-{b}": slope(of(key), a, b)})
    for key in ("macd", "hist", "cci", "rsi", "adx", "stoch"):
        add("Accel", **{f"{key} accel": bend(of(key))})
    levels = [("rsi-50", centred("rsi", 50), (1, 2, 3)), ("cci/100", lambda k: v("cci", k) / 100, (1, 2)), ("stoch-50", centred("stoch", 50), (1, 2)), ("di spread", di, (1, 2, 3)), ("adx", of("adx"), (1, 2))]
    levels += [("pctb-0.5", centred("pctb", 0.5), (1, 2)), ("roc", of("roc"), (1, 2)), ("macd", of("macd"), (1,)), ("hist", of("hist"), (1, 2)), ("chop-50", centred("chop", 50), (1,))]
    levels += [("ema5-ema20", less("ema5", "ema20"), (1, 2)), ("ema5-ema10", less("ema5", "ema10"), (1,))]
    for label, f, places in levels:
        for k in places:
            add("Level", **{f"{label} {k}": f(k)})

    hist = [v("hist", k) for k in NOW]
    flips = total([coalesce(x, False) for x in between([sign(x) for x in hist], lambda a, b: a != b)])
    add("Hist", **{
        "hist mean": at_mean("hist"), "hist sum": when(known(hist) > 0, plus(hist)), "hist bend": bend(of("hist")), "hist sign flips": when(known(hist) > 1, flips),
        "hist all positive": all_of(of("hist"), lambda x: x > 0), "hist all negative": all_of(of("hist"), lambda x: x < 0), "hist late accel": v("hist", 1) - mean([v("hist", 3), v("hist", 2)]),
    })
    chop = of("chop")
    add("Chop", **{"chop mean": at_mean("chop"), "chop delta": slope(chop, 3, 1), "chop range": spread([chop(k) for k in NOW]), "chop accel": bend(chop), "chop falling": flag(slope(chop, 3, 1) < 0), "chop late drop": slope(chop, 2, 1)})
    cci = of("cci")
    seen = [cci(k) for k in NOW]
    always = lambda test: reduce(lambda a, b: a & b, [coalesce(x, True) for x in between(seen, test)])
    add("CCI", **{
        "cci mean": at_mean("cci"), "cci delta": slope(cci, 3, 1), "cci accel again": bend(cci), "cci abs max": greatest(*map(size, seen)),
        "cci monotone": when(known(seen) >= 2, flag(always(lambda a, b: b >= a) | always(lambda a, b: b <= a))), "cci momentum": slope(cci, 2, 1) * sign(cci(1)),
    })
    norm = lambda k: when(v("mid", k) > 0, width(k) / nullif(v("mid", k), 0.0) * 100)
    pctb = of("pctb")
    add("BB", **{f"bb width {k}": width(k) for k in (1, 2, 3)}, **{
        "bb width delta": slope(width, 3, 1), "bb width accel": bend(width), "bb norm width 1": norm(1), "bb norm width 2": norm(2), "bb squeeze 1": flag(width(1) / nullif(v("mid", 1), 0.0) * 100 < 0.05),
        "pctb-0.5 3": pctb(3) - 0.5, "pctb slope 3-1 again": slope(pctb, 3, 1), "pctb slope 2-1 again": slope(pctb, 2, 1), "pctb accel": bend(pctb), "price-mid 1": p_mid(1), "price-mid 2": p_mid(2),
        "price-mid/width 1": when(width(1) > 0, p_mid(1) / nullif(width(1), 0.0)),
    })
    add("MACD", **{f"macd gap {k}": gap(k) for k in (1, 2, 3)}, **{
        "macd gap expanding": flag(size(gap(1)) > size(gap(2))), "macd cross": flag(crossed(gap)[0] | crossed(gap)[1]), "macd mean": at_mean("macd"), "macd accel again": bend(of("macd")),
    })
    atr, roc, rsi = of("atr"), of("roc"), of("rsi")
    add("Price", **{
        "price velocity 3-1": slope(price, 3, 1), "price velocity 2-1": slope(price, 2, 1), "price accel": bend(price), "price range": spread([price(k) for k in NOW]), "atr 1": atr(1), "atr 2": atr(2), "atr delta": slope(atr, 3, 1),
        "atr accel": bend(atr), "velocity/atr": clamped(slope(price, 3, 1), atr(1)), "price-ema5 1": less("price", "ema5")(1), "price-ema20 1": less("price", "ema20")(1), "price-ema5/atr 1": clamped(less("price", "ema5")(1), atr(1)),
        "price-ema20/atr 1": clamped(less("price", "ema20")(1), atr(1)), "ema5-ema20 1 again": less("ema5", "ema20")(1), "ema5-ema10 1 again": less("ema5", "ema10")(1), "ema10-ema20 1": less("ema10", "ema20")(1), "roc 1 again": roc(1),
        "roc 2 again": roc(2), "roc accel": bend(roc), "atr ratio 1/3": clamped(atr(1), atr(3)),
    })
    add("RSI", **{"rsi mean": at_mean("rsi"), "rsi accel again": bend(rsi), "rsi late slope": slope(rsi, 2, 1), "rsi early slope": slope(rsi, 3, 2), "rsi deviation 1": size(rsi(1) - 50), "rsi direction x size 1": slope(rsi, 2, 1) * sign(rsi(1) - 50)})
    add("Stoch", **{"stoch k-d 1": k_d(1), "stoch k-d 2": k_d(2), "stoch k accel": bend(of("stoch"))})
    add("DMI", **{"adx mean": at_mean("adx"), "adx accel again": bend(of("adx")), "di spread accel": bend(di)})

    early, late = slope(price, 3, 2), slope(price, 2, 1)
    moves = known([price(k) for k in NOW])
    both = (early - late) * (early - late) / 4
    reversion = when(atr(1) > 0, less("price", "ema20")(1) / nullif(atr(1), 0.0))
    crossings = [c for f in (gap, centred("stoch", 50), centred("rsi", 50), di) for c in crossed(f)]
    add("Regime", **{
        "bb contraction": bend(width), "atr expansion": slope(atr, 3, 1), "atr expansion/atr 1": clamped(slope(atr, 3, 1), atr(1)), "volatility late/early": clamped(atr(1), atr(3)),
        "price disorder": when(moves == 3, both).when(moves == 2, 0.0), "persistence": when(early.isNotNull() & late.isNotNull(), when((early > 0) & (late > 0), 1.0).when((early < 0) & (late < 0), -1.0).otherwise(0.0)),
        "reversion distance 1": size(reversion), "reversion signed 1": reversion, "crossovers": total(crossings), "price curvature/atr": clamped(bend(price), atr(1)), "macd curvature": bend(of("macd")), "bb curvature/atr": clamped(bend(width), atr(1)),
    })
    shrink = 1 - width(1) / nullif(width(3), 0.0)
    e5, e10, e20 = (v(k, 1) for k in ("ema5", "ema10", "ema20"))
    align = when((e5 > e10) & (e10 > e20), 1.0).when((e5 < e10) & (e10 < e20), -1.0).when(e5.isNotNull() & e10.isNotNull() & e20.isNotNull(), 0.0)
    add("Interact", **{
        "adx x di spread 1": di(1) * v("adx", 1) / 100, "chop x hist 1": (50 - v("chop", 1)) * v("hist", 1), "rsi x hist 1": (rsi(1) - 50) * v("hist", 1), "pctb x cci 1": (pctb(1) - 0.5) * cci(1),
        "velocity/atr x di 1": when(atr(1) > 0, slope(price, 3, 1) / nullif(atr(1), 0.0) * di(1) / 100), "ema alignment x macd 1": align * v("macd", 1), "hist accel x cci 1": bend(of("hist")) * cci(1) / 100,
        "bb contraction x roc": shrink * roc(1), "stoch x rsi 1": (v("stoch", 1) - 50) * (rsi(1) - 50) / 2500, "adx x bb contraction": shrink * v("adx", 1) / 100,
    })
    vote = {"rsi": centred("rsi", 50), "hist": of("hist"), "di": di, "pctb": centred("pctb", 0.5), "roc": roc, "macd": of("macd"), "k_d": k_d}
    votes = lambda names, k: [sign(vote[n](k)) for n in names.split()]
    cast = votes("rsi hist di pctb roc macd", 1)
    count = lambda test: total([coalesce(test(x), False) for x in cast])
    add("Agreement", **{
        "consensus 1": mean(votes("rsi hist di pctb roc macd k_d", 1)), "consensus 2": mean(votes("rsi hist di roc macd", 2)),
        "agreement 1": greatest(count(lambda x: x > 0), count(lambda x: x < 0)) / nullif(known(cast), 0), "consensus shift": mean(votes("rsi hist roc macd", 1)) - mean(votes("rsi hist roc macd", 3)),
        "turning 2-1": total([coalesce(sign(v(k, 1)) != sign(v(k, 2)), False) for k in ("hist", "rsi", "macd", "cci", "roc")]),
    })
    add("Diverge", **{"macd against price": flag(sign(slope(price, 3, 1)) != sign(slope(of("macd"), 3, 1))), "macd divergence": opposed(price, of("macd")), "rsi divergence": opposed(price, of("rsi")), "stoch divergence": opposed(price, of("stoch"))})
    return out


def features(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (symbol, i and KEYS) as symbol, i, what is to ``keep`` and f000 to f177."""
    rows = chunked(rows, 3)
    rows = rows.select("symbol", "i", *keep, "chunk", "own", *[F.lag(k, at - 1).over(stream()).alias(f"{k}_{at}") if at > 1 else F.col(k).alias(f"{k}_1") for k in KEYS for at in NOW])
    return _defined(own(rows), keep)


def of_prices(p: np.ndarray, first: int) -> list[Values]:
    """The features of the prices ``p`` of a stream from place ``first`` on, as ``features`` of their ``snapshots``. Over arrays a rule is a
    few passes; as columns the 178 of them took most of the time that features took."""
    made = {"price": p, **snapshot(p)}

    @cache
    def at(key: str, place: int) -> Values:
        back = place - 1
        x = made[key][first - back : len(p) - back] if back <= first else np.concatenate([np.full(min(back, len(p)), np.nan), made[key][: max(len(p) - back, 0)]])[first:]
        return Values(x, ~np.isnan(x) if key == "price" else np.isfinite(x))

    return [c.cast("double") for _, _, c in definitions(at)]


NAMES = tuple(f"f{n:03d}" for n in range(len(definitions(lambda key, at: Values(np.zeros(1))))))


def of_ticks(ticks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The features of ``ticks`` (symbol, i, price), as ``features`` of their ``snapshots``; the chunk that makes a tick's indicators has
    those of the ticks before it as well, so rows move and are sorted once."""
    rows = chunked(ticks.select("symbol", "i", "price", *keep), LONG_HALO)
    schema = StructType([*(rows.schema[c] for c in ("symbol", "i", *keep)), *(StructField(n, DoubleType()) for n in NAMES)])

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        first = int((~chunk.column("own").to_numpy()).sum())
        out = chunk.slice(first).select(["symbol", "i", *keep])
        for name, x in zip(NAMES, of_prices(chunk.column("price").to_numpy().astype("f8"), first), strict=True):
            out = out.append_column(name, x.arrow())
        return out

    return rows.groupBy("symbol", "chunk").applyInArrow(run, schema)


def packed(ticks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of ``ticks`` (symbol, i, price and what is to ``keep``): symbol, chunk and the ticks in order, with those before it that
    indicators reach."""
    rows = chunked(ticks.select("symbol", "i", "price", *keep), LONG_HALO)
    return rows.groupBy("symbol", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "price", *keep))).alias("ticks"))


def unpacked(batch: pa.RecordBatch, keep: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], list[Values]]]:
    """Of each row of ``packed``: what was to ``keep`` of the chunk's own ticks, and their features."""
    lists = batch.column("ticks")
    for k, chunk in enumerate(batch.column("chunk").to_pylist()):
        ticks = lists[k].values
        first = int(np.searchsorted(ticks.field("i").to_numpy(), chunk * CHUNK))
        if first < len(ticks):
            price = ticks.field("price").to_numpy(zero_copy_only=False).astype("f8")
            yield {c: ticks.field(c).to_numpy(zero_copy_only=False)[first:] for c in keep}, of_prices(price, first)


def _defined(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return rows.select("symbol", "i", *keep, *[c.cast("double").alias(f"f{n:03d}") for n, (_, _, c) in enumerate(definitions())])
