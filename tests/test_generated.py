"""The generated features against plain Python: indicators by loops, features from three snapshots."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import generated as gn


def ema(x, n):
    out, a = [], 2 / (n + 1)
    for v in x:
        out.append(v if not out else a * v + (1 - a) * out[-1])
    return out


def wilder(x, n):
    """x[0] belongs to no move."""
    out = [None] * len(x)
    for t in range(n, len(x)):
        out[t] = sum(x[1 : n + 1]) / n if t == n else (out[t - 1] * (n - 1) + x[t]) / n
    return out


def indicators(p):
    n = len(p)
    d = [0.0] + [b - a for a, b in zip(p, p[1:])]
    tr = ema([abs(x) for x in d], 14)
    macd = [a - b for a, b in zip(ema(p, 12), ema(p, 26))]
    signal = ema(macd, 9)
    share = lambda x: [100 * (a / b if b else 0.0) for a, b in zip(ema([max(v, 0) for v in x], 14), tr)]
    pdi, ndi = share(d), share([-v for v in d])
    adx = ema([100 * (abs(a - b) / (a + b) if a + b else 0.0) for a, b in zip(pdi, ndi)], 14)
    gain, loss = wilder([max(v, 0) for v in d], 14), wilder([max(-v, 0) for v in d], 14)
    e5, e10, e20 = ema(p, 5), ema(p, 10), ema(p, 20)
    rows, stoch = [], []
    for t in range(n):
        r = dict.fromkeys(gn.KEYS)
        r |= {"price": p[t], "macd": macd[t], "signal": signal[t], "hist": macd[t] - signal[t], "pdi": pdi[t], "ndi": ndi[t], "adx": adx[t], "atr": tr[t], "ema5": e5[t], "ema10": e10[t], "ema20": e20[t]}
        if t >= 19:
            w = p[t - 19 : t + 1]
            mid = sum(w) / 20
            sd = math.sqrt(sum((x - mid) ** 2 for x in w) / 20)
            off = sum(abs(x - mid) for x in w) / 20
            r |= {"mid": mid, "upper": mid + 2 * sd, "lower": mid - 2 * sd, "pctb": (p[t] - (mid - 2 * sd)) / (4 * sd) if sd else None, "cci": (p[t] - mid) / (0.015 * off) if off else 0.0}
        if t >= 13:
            w = p[t - 13 : t + 1]
            lo, hi = min(w), max(w)
            r["stoch"] = 100 * (p[t] - lo) / (hi - lo) if hi > lo else 50.0
            moved = sum(abs(x) for x in d[t - 13 : t + 1])
            r["chop"] = 100 * math.log10(moved / (hi - lo)) / math.log10(14) if hi > lo else None
        stoch.append(r["stoch"])
        if t >= 15:
            r["stoch_d"] = sum(stoch[t - 2 :]) / 3
        if t >= 10:
            r["roc"] = 100 * (p[t] - p[t - 10]) / p[t - 10]
        if gain[t] is not None:
            r["rsi"] = 100.0 if loss[t] == 0 else 100 - 100 / (1 + gain[t] / loss[t])
        rows.append(r)
    return rows


def sign(x):
    return None if x is None else float((x > 0) - (x < 0))


def op(f, *xs):
    return None if any(x is None for x in xs) else f(*xs)


def sub(a, b):
    return op(lambda x, y: x - y, a, b)


def div(a, b):
    return op(lambda x, y: x / y if y else None, a, b)


def clamp(a, b):
    return op(lambda x, y: max(-3.0, min(3.0, x / y)) if abs(y) > 1e-9 else None, a, b)


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def expected(s):
    """Label to value; ``s`` has the snapshots at 3 (oldest), 2 and 1."""
    g = lambda k: lambda at: s[at][k]
    slope = lambda f, a, b: sub(f(b), f(a))
    bend = lambda f: sub(sub(f(1), f(2)), sub(f(2), f(3)))
    less = lambda a, b: lambda at: sub(s[at][a], s[at][b])
    off = lambda k, c: lambda at: op(lambda x: x - c, s[at][k])
    width, di, gap, kd = less("upper", "lower"), less("pdi", "ndi"), less("macd", "signal"), less("stoch", "stoch_d")
    p, atr, roc, rsi, cci, chop, hist, pctb, adx = (g(k) for k in ("price", "atr", "roc", "rsi", "cci", "chop", "hist", "pctb", "adx"))
    all3 = lambda f: [f(k) for k in (3, 2, 1)]
    seen = lambda f: [x for x in all3(f) if x is not None]
    out = {}
    for k in ("macd", "signal", "hist", "chop", "cci", "pctb", "pdi", "ndi", "adx", "rsi", "atr", "stoch", "roc", "ema5", "ema20"):
        for a, b in ((3, 2), (2, 1), (3, 1)):
            out[f"{k} slope {a}-{b}"] = slope(g(k), a, b)
    for k in ("macd", "hist", "cci", "rsi", "adx", "stoch"):
        out[f"{k} accel"] = bend(g(k))
    for k in (1, 2, 3):
        out |= {f"rsi-50 {k}": off("rsi", 50)(k), f"di spread {k}": di(k), f"cci/100 {k}": op(lambda x: x / 100, cci(k)), f"stoch-50 {k}": off("stoch", 50)(k), f"adx {k}": adx(k), f"pctb-0.5 {k}": off("pctb", 0.5)(k), f"roc {k}": roc(k)}
        out |= {f"macd {k}": g("macd")(k), f"hist {k}": hist(k), f"chop-50 {k}": off("chop", 50)(k), f"ema5-ema20 {k}": less("ema5", "ema20")(k), f"ema5-ema10 {k}": less("ema5", "ema10")(k), f"bb width {k}": width(k), f"macd gap {k}": gap(k)}
    h = seen(hist)
    signs = [sign(x) for x in h]
    flips = lambda f: [sign(f(a)) != sign(f(b)) if None not in (f(a), f(b)) else False for a, b in ((3, 2), (2, 1))]
    out |= {
        "hist mean": mean(h), "hist sum": sum(h) if h else None, "hist bend": bend(hist), "hist sign flips": float(sum(a != b for a, b in zip(signs, signs[1:]))) if len(h) > 1 else None,
        "hist all positive": float(len(h) == 3 and all(x > 0 for x in h)), "hist all negative": float(len(h) == 3 and all(x < 0 for x in h)), "hist late accel": sub(hist(1), mean([hist(3), hist(2)])),
        "chop mean": mean(all3(chop)), "chop delta": slope(chop, 3, 1), "chop range": op(lambda: max(seen(chop)) - min(seen(chop))) if seen(chop) else None, "chop accel": bend(chop), "chop falling": op(lambda x: float(x < 0), slope(chop, 3, 1)), "chop late drop": slope(chop, 2, 1),
        "cci mean": mean(all3(cci)), "cci delta": slope(cci, 3, 1), "cci abs max": max(map(abs, seen(cci))) if seen(cci) else None, "cci momentum": op(lambda x, y: x * y, slope(cci, 2, 1), sign(cci(1))),
        "cci monotone": float(sorted(seen(cci)) == seen(cci) or sorted(seen(cci))[::-1] == seen(cci)) if len(seen(cci)) >= 2 else None,
        "bb width delta": slope(width, 3, 1), "bb width accel": bend(width), "bb norm width 1": op(lambda w, m: w / m * 100 if m > 0 else None, width(1), s[1]["mid"]), "bb norm width 2": op(lambda w, m: w / m * 100 if m > 0 else None, width(2), s[2]["mid"]),
        "bb squeeze 1": op(lambda w, m: float(w / m * 100 < 0.05), width(1), s[1]["mid"]), "pctb accel": bend(pctb), "price-mid 1": less("price", "mid")(1), "price-mid 2": less("price", "mid")(2), "price-mid/width 1": op(lambda a, w: a / w if w > 0 else None, less("price", "mid")(1), width(1)),
        "macd gap expanding": op(lambda a, b: float(abs(a) > abs(b)), gap(1), gap(2)), "macd cross": float(any(flips(gap))), "macd mean": mean(all3(g("macd"))),
        "price velocity 3-1": slope(p, 3, 1), "price velocity 2-1": slope(p, 2, 1), "price accel": bend(p), "price range": max(seen(p)) - min(seen(p)), "atr 1": atr(1), "atr 2": atr(2), "atr delta": slope(atr, 3, 1), "atr accel": bend(atr), "velocity/atr": clamp(slope(p, 3, 1), atr(1)),
        "price-ema5 1": less("price", "ema5")(1), "price-ema20 1": less("price", "ema20")(1), "price-ema5/atr 1": clamp(less("price", "ema5")(1), atr(1)), "price-ema20/atr 1": clamp(less("price", "ema20")(1), atr(1)), "ema10-ema20 1": less("ema10", "ema20")(1), "roc accel": bend(roc), "atr ratio 1/3": clamp(atr(1), atr(3)),
        "rsi mean": mean(all3(rsi)), "rsi late slope": slope(rsi, 2, 1), "rsi early slope": slope(rsi, 3, 2), "rsi deviation 1": op(lambda x: abs(x - 50), rsi(1)), "rsi direction x size 1": op(lambda a, b: a * sign(b - 50), slope(rsi, 2, 1), rsi(1)),
        "stoch k-d 1": kd(1), "stoch k-d 2": kd(2), "stoch k accel": bend(g("stoch")), "adx mean": mean(all3(adx)), "di spread accel": bend(di),
    }
    early, late, moves = slope(p, 3, 2), slope(p, 2, 1), seen(p)
    back = div(less("price", "ema20")(1), atr(1)) if atr(1) and atr(1) > 0 else None
    out |= {
        "bb contraction": bend(width), "atr expansion": slope(atr, 3, 1), "atr expansion/atr 1": clamp(slope(atr, 3, 1), atr(1)), "volatility late/early": clamp(atr(1), atr(3)), "price disorder": (early - late) ** 2 / 4 if len(moves) == 3 else 0.0 if len(moves) == 2 else None,
        "persistence": op(lambda a, b: 1.0 if a > 0 and b > 0 else -1.0 if a < 0 and b < 0 else 0.0, early, late), "reversion distance 1": op(abs, back), "reversion signed 1": back, "crossovers": float(sum(sum(flips(f)) for f in (gap, off("stoch", 50), off("rsi", 50), di))),
        "price curvature/atr": clamp(bend(p), atr(1)), "macd curvature": bend(g("macd")), "bb curvature/atr": clamp(bend(width), atr(1)),
    }
    shrink = op(lambda x: 1 - x, div(width(1), width(3)))
    e = [s[1][k] for k in ("ema5", "ema10", "ema20")]
    align = 1.0 if e[0] > e[1] > e[2] else -1.0 if e[0] < e[1] < e[2] else 0.0
    mul = lambda *xs: op(lambda *v: math.prod(v), *xs)
    votes = lambda ks, at: [sign({"rsi": off("rsi", 50), "hist": hist, "di": di, "pctb": off("pctb", 0.5), "roc": roc, "macd": g("macd"), "k_d": kd}[k](at)) for k in ks.split()]
    cast = [x for x in votes("rsi hist di pctb roc macd", 1) if x is not None]
    turned = [sign(s[1][k]) != sign(s[2][k]) if None not in (s[1][k], s[2][k]) else False for k in ("hist", "rsi", "macd", "cci", "roc")]
    against = lambda k: op(lambda a, b: 1.0 if a < 0 < b else -1.0 if b < 0 < a else 0.0, slope(p, 3, 1), slope(g(k), 3, 1))
    out |= {
        "adx x di spread 1": mul(di(1), adx(1), 0.01), "chop x hist 1": op(lambda c, x: (50 - c) * x, chop(1), hist(1)), "rsi x hist 1": mul(off("rsi", 50)(1), hist(1)), "pctb x cci 1": mul(off("pctb", 0.5)(1), cci(1)),
        "velocity/atr x di 1": mul(div(slope(p, 3, 1), atr(1)), di(1), 0.01) if atr(1) and atr(1) > 0 else None, "ema alignment x macd 1": align * s[1]["macd"], "hist accel x cci 1": mul(bend(hist), cci(1), 0.01), "bb contraction x roc": mul(shrink, roc(1)),
        "stoch x rsi 1": mul(off("stoch", 50)(1), off("rsi", 50)(1), 1 / 2500), "adx x bb contraction": mul(shrink, adx(1), 0.01),
        "consensus 1": mean(votes("rsi hist di pctb roc macd k_d", 1)), "consensus 2": mean(votes("rsi hist di roc macd", 2)), "agreement 1": max(sum(x > 0 for x in cast), sum(x < 0 for x in cast)) / len(cast) if cast else None,
        "consensus shift": sub(mean(votes("rsi hist roc macd", 1)), mean(votes("rsi hist roc macd", 3))), "turning 2-1": float(sum(turned)),
        "macd against price": op(lambda a, b: float(a != b), sign(slope(p, 3, 1)), sign(slope(g("macd"), 3, 1))), "macd divergence": against("macd"), "rsi divergence": against("rsi"), "stoch divergence": against("stoch"),
    }
    return out


@pytest.mark.parametrize("kind", ["walk", "flat"])
def test_all_generated_features_equal_plain_python(spark, kind):
    rng = random.Random(9)
    p = [100.0]
    for t in range(90):
        p.append(p[-1] if kind == "flat" and 20 < t < 60 else p[-1] + rng.choice([-1.5, -0.5, 0.0, 0.5, 1.5]))
    rows = spark.createDataFrame([("A", i, x) for i, x in enumerate(p)], "symbol string, i long, price double")
    got = {r.i: r for r in gn.features(gn.snapshots(rows)).collect()}
    snap = indicators(p)
    labels = [label for label, _, _ in gn.definitions()]
    assert len(labels) == 178 and sorted(got) == list(range(len(p)))
    compared = set()
    for t in range(2, len(p)):
        want = expected({3: snap[t - 2], 2: snap[t - 1], 1: snap[t]})
        for n, label in enumerate(labels):
            key = label if label in want else label.removesuffix(" again")
            a, b = got[t][f"f{n:03d}"], want[key]
            compared.add(n)
            if (a is None) != (b is None) or (a is not None and abs(a - b) > 1e-6 * max(1, abs(b))):
                raise AssertionError((t, n, label, a, b))
    assert len(compared) == 178


def test_snapshots_leave_missing_values_null(spark):
    rows = spark.createDataFrame([("A", i, 5.0) for i in range(3)], "symbol string, i long, price double")
    r = gn.snapshots(rows).filter(F.col("i") == 2).first()
    assert r.mid is None and r.chop is None and r.ema5 == 5.0


def test_features_of_ticks_move_rows_once_and_interpret_nothing(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(s, i, None if i % 37 == 36 else 5.0 if i < 25 else rng.choice([5.0, 6.0, 7.5])) for s, n in (("A", 120), ("B", 1), ("C", 2)) for i in range(n)], "symbol string, i long, price double")
    made = gn.of_ticks(rows)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "lambdafunction" not in text
    by = lambda df: sorted(tuple(r) for r in df.collect())
    assert by(made) == by(gn.features(gn.snapshots(rows))) and made.count() == 123


def test_gaps_among_three_places_are_passed_over(spark):
    rows = spark.createDataFrame([(1, 1.0, None, -2.0), (2, None, None, 3.0), (3, 1.0, 1.0, 2.0), (4, None, None, None)], "k int, a double, b double, c double")
    x = [F.col(c) for c in "abc"]
    flips = gn.total([F.coalesce(t, F.lit(False)) for t in gn.between([gn.sign(v) for v in x], lambda a, b: a != b)])
    got = rows.orderBy("k").select(gn.known(x), gn.mean(x), gn.spread(x), flips, gn.plus(x)).collect()
    assert [tuple(r) for r in got] == [(2, -0.5, 3.0, 1.0, -1.0), (1, 3.0, 0.0, 0.0, 3.0), (3, 4 / 3, 1.0, 0.0, 4.0), (0, None, None, 0.0, 0.0)]
