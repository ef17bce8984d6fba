"""Analogs against plain Python over random candles."""

import math
import random

from tidewright.operators import patterns as pt


def candles(n, seed):
    rng, out, close = random.Random(seed), [], 100.0
    for c in range(n):
        o = close
        close = round(o + rng.choice([-1, 1]) * rng.random() * 1.2 + 0.3 * math.sin(c / 9), 4)
        out.append((o, round(max(o, close) + rng.random() * 0.5, 4), round(min(o, close) - rng.random() * 0.5, 4), close))
    return out


def swings(k, a, b, look):
    """Swings of candles a to b, neighbours included on both sides."""
    out = []
    for j in range(a + look, b - look + 1):
        near = [k[i] for i in range(j - look, j + look + 1) if i != j]
        out += [("high", k[j][1])] * all(k[j][1] > x[1] for x in near) + [("low", k[j][2])] * all(k[j][2] < x[2] for x in near)
    return out


def trend(some):
    h, low = ([p for t, p in some[-4:] if t == kind] for kind in ("high", "low"))
    if len(h) < 2 or len(low) < 2:
        return "none"
    ups = (h[-1] > h[-2], low[-1] > low[-2])
    return "up" if all(ups) else "down" if not any(ups) else "none"


def near(x):
    return math.floor(x + 0.5)


def test_historical_analogs_and_similar_windows(spark):
    data = {s: candles(160, k) for k, s in enumerate("abcdefghijklmnopqrstuvwxyz")}
    rows = [(s, c, c * 60, *map(float, x), 10) for s, k in data.items() for c, x in enumerate(k)]
    df = spark.createDataFrame(rows, "symbol string, c long, epoch long, open double, high double, low double, close double, n long")
    history = {r.symbol: r for r in pt.historical_analogs(df).collect()}
    windows = {}
    for r in pt.similar_windows(df).collect():
        windows.setdefault(r.symbol, {})[r.rank] = (r.start_index, r.distance, r.outcome)
    sign = lambda x: (x > 0) - (x < 0)
    for s, k in data.items():
        n, size = len(k), 12

        def signature(e, look):
            w = k[e - size + 1 : e + 1]
            spans = [x[1] - x[2] for x in w]
            mean = sum(spans) / size
            rising = sum(x[3] >= x[0] for x in w)
            return {
                "trend": trend(swings(k, e - size + 1, e, look)), "move": (w[-1][3] - w[0][0]) / w[0][0], "ratio": rising / size, "skew": (2 * rising - size) / size,
                "v": min(100, 100 * math.sqrt(sum((x - mean) ** 2 for x in spans) / size) / mean) / 100,
            }

        now = signature(n - 1, 1)
        if now["trend"] == "none":
            assert s not in history
        else:
            hits = []
            for e in range(size - 1, n - size):
                x = signature(e, 1)
                if x["trend"] != "none" and 0.5 * (x["trend"] == now["trend"]) + 0.3 * (sign(x["move"]) == sign(now["move"])) + 0.2 * (1 - abs(x["ratio"] - now["ratio"])) >= 0.75:
                    hits.append((1 if x["trend"] == "up" else -1) * (k[e + 8][3] - k[e][3]) / k[e][3])
            on, turned = sum(h > 0.001 for h in hits), sum(h < -0.001 for h in hits)
            r = history[s]
            assert (r.current_trend, r.sample_size, r.continued, r.reversed, r.neutral) == (now["trend"], len(hits), on, turned, len(hits) - on - turned)
            assert (r.continued_pct, r.reversed_pct) == ((near(100 * on / len(hits)), near(100 * turned / len(hits))) if hits else (0, 0))
        now = signature(n - 1, 2)
        found = []
        for e in range(size - 1, n - size - 8):
            x = signature(e, 2)
            if "none" in (x["trend"], now["trend"]):
                continue
            size_of = lambda y: min(15, abs(y["move"] * 100)) / 15
            d = 0.6 * (x["trend"] != now["trend"]) + 0.15 * abs(sign(x["move"]) - sign(now["move"])) + 0.5 * abs(size_of(x) - size_of(now)) + 0.3 * abs(x["v"] - now["v"]) + 0.4 * abs(x["skew"] - now["skew"])
            if d <= 0.9:
                later = trend(swings(k, e - size + 1, e + 8, 2))
                found.append((d, e - size + 1, "inconclusive" if later == "none" else "continued" if later == x["trend"] else "reversed"))
        got = windows.get(s, {})
        assert len(got) == min(8, len(found))
        for place, (d, start, outcome) in enumerate(sorted(found)[:8], 1):
            assert got[place][0] == start and math.isclose(got[place][1], d, abs_tol=1e-9) and got[place][2] == outcome
    assert history and windows
