"""Rules and the probability engine against plain Python over random summaries."""

import math
import random

import pytest

from tidewright.operators import scoring as sc

WEIGHTS = {"trend": 0.15, "momentum": 0.12, "structure": 0.15, "liquidity": 0.10, "order_flow": 0.15, "history": 0.13, "genome": 0.10, "alignment": 0.10}
SCHEMA = """symbol string, candle_count long, last_c long, trend string, momentum_pct double, volatility_pct double, absorption double, bullish_count long, bearish_count long, bos long, choch long,
bos_direction string, bos_at long, choch_direction string, choch_at long, liquiditySweep_direction string, liquiditySweep_at long, buying_pressure_pct double, selling_pressure_pct double, up_breaks long, breaks long,
current_trend string, h_sample_size long, h_continued_pct double, h_reversed_pct double, current_direction int, g_sample_size long, g_continued_pct double, g_reversed_pct double, fine_buying double, fine_n long"""


def near(x):
    return math.floor(x + 0.5)


def summaries(n):
    rng = random.Random(17)
    side = lambda: rng.choice(["bullish", "bearish"])
    out = []
    for k in range(n):
        c, buy = rng.choice([5, 30, 60, 90]), rng.choice([rng.uniform(30, 70), 58.0, 42.0, 50.0])
        up = rng.randrange(c + 1)
        gone = lambda *x: x if rng.random() < 0.75 else (None,) * len(x)
        breaks = rng.choice([None, rng.randrange(1, 8)])
        out.append((
            f"s{k}", c, c - 1, rng.choice(["up", "down", "none"]), rng.choice([rng.uniform(-14, 14), 0.5]), rng.choice([rng.uniform(1, 99), 20.0]), rng.choice([rng.random(), 0.1, 0.3]), up, c - up, rng.randrange(4), rng.randrange(4),
            *gone(side(), c - 1 - rng.randrange(12)), *gone(side(), c - 1 - rng.randrange(12)), *gone(side(), c - 1 - rng.randrange(12)), buy, 100 - buy, None if breaks is None else rng.randrange(breaks + 1), breaks,
            *gone(rng.choice(["up", "down", "none"]), rng.randrange(6), rng.uniform(0, 60), rng.uniform(0, 40)), *gone(rng.choice([1, -1]), rng.randrange(6), rng.uniform(0, 60), rng.uniform(0, 40)), *gone(rng.uniform(20, 80), rng.choice([10, 20, 40])),
        ))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = summaries(250)
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame(rows, SCHEMA), [dict(zip(names, r, strict=True)) for r in rows]


def plain_rules(r):
    if r["candle_count"] < 10:
        return []
    both = r["bos"] + r["choch"]
    ratio = r["bos"] / both if both else 0.5
    strength = near((ratio * 0.45 + abs(r["bullish_count"] - r["bearish_count"]) / r["candle_count"] * 0.35 + min(abs(r["momentum_pct"]), 10) / 10 * 0.2) * 100)
    late = lambda k: r[f"{k}_at"] is not None and r[f"{k}_at"] >= r["last_c"] - 5
    buy, sell, still, turn = r["buying_pressure_pct"], r["selling_pressure_pct"], r["absorption"], r["choch_direction"]
    out = [("trendStrength", r["trend"], strength)]
    if r["trend"] == "up" and r["bos_direction"] == "bullish" and late("bos") and buy > 55:
        out.append(("bullishContinuation", "bullish", near(buy * 0.6 + strength * 0.4)))
    if r["trend"] == "down" and r["bos_direction"] == "bearish" and late("bos") and sell > 55:
        out.append(("bearishContinuation", "bearish", near(sell * 0.6 + strength * 0.4)))
    if late("choch"):
        swept = r["liquiditySweep_direction"] == turn and abs(r["liquiditySweep_at"] - r["choch_at"]) <= 3
        backed = (turn == "bullish" and buy > 55) or (turn == "bearish" and sell > 55)
        out.append(("reversal", turn, min(100, 50 + 25 * swept + 15 * backed)))
    if r["volatility_pct"] < 35 and still < 0.35 and abs(r["momentum_pct"]) < 2:
        out.append(("distribution" if r["trend"] == "up" else "accumulation", "none", near((1 - still) * 100)))
    if still < 0.2:
        out.append(("absorption", "none", near((1 - still) * 100)))
    return out


def test_rules(frame):
    df, rows = frame
    got = {}
    for r in sc.rules(df).collect():
        got.setdefault(r.symbol, []).append((r.type, r.direction, r.confidence))
    seen = set()
    for r in rows:
        want = plain_rules(r)
        seen |= {x[0] for x in want}
        assert sorted(got.get(r["symbol"], [])) == sorted(want)
    assert len(seen) == 7


def plain_probability(r, bias):
    sign = lambda x, up, down: 1.0 if x == up else -1.0 if x == down else 0.0
    clamp = lambda x, a, b: max(a, min(b, x))
    part = lambda p, way: way * (r[f"{p}_continued_pct"] - r[f"{p}_reversed_pct"]) / 100 if (r[f"{p}_sample_size"] or 0) > 0 else 0.0
    lead = 1.0 if r["trend"] == "up" else -1.0
    fine = None if r["fine_n"] is None else 1.0 if r["fine_buying"] >= 50 else -1.0
    s = {
        "trend": sign(r["trend"], "up", "down"), "momentum": clamp(r["momentum_pct"] / 5, -1, 1), "structure": (2 * r["up_breaks"] - r["breaks"]) / r["breaks"] if r["breaks"] else 0.0,
        "liquidity": sign(r["liquiditySweep_direction"], "bullish", "bearish") if r["liquiditySweep_at"] is not None and r["liquiditySweep_at"] >= r["last_c"] - 9 else 0.0,
        "order_flow": (r["buying_pressure_pct"] - r["selling_pressure_pct"]) / 100, "history": part("h", sign(r["current_trend"], "up", "down")), "genome": part("g", r["current_direction"] or 0),
        "alignment": 0.0 if r["trend"] == "none" or (r["fine_n"] or 0) < 20 else lead if fine == lead else -0.5 * lead,
    }
    weighted = sum(s[k] * w for k, w in WEIGHTS.items())
    way = sign(bias, "bullish", "bearish")
    go = 50 if way == 0 else near(clamp(50 + weighted * way * 50, 5, 95))
    used = [x for x in s.values() if x]
    agree = sum((x > 0) - (x < 0) == (-1 if weighted < 0 else 1) for x in s.values())
    sure = (agree / len(used) if used else 0.5) * 100
    for p in "hg":
        sure *= 0.85 if (r[f"{p}_sample_size"] or 0) < 3 else 1
    return s, go, near(clamp(sure * (0.9 if r["volatility_pct"] > 80 or r["volatility_pct"] < 5 else 1), 10, 95))


def test_probability(frame):
    from pyspark.sql import functions as F

    df, rows = frame
    bias = F.when(F.col("trend") == "up", "bullish").when(F.col("trend") == "down", "bearish").otherwise("neutral")
    got = {r.symbol: r for r in sc.probability(df, bias).collect()}
    assert set(got) == {r["symbol"] for r in rows if r["candle_count"] >= 40}
    for r in rows:
        if r["candle_count"] < 40:
            continue
        s, go, sure = plain_probability(r, {"up": "bullish", "down": "bearish"}.get(r["trend"], "neutral"))
        g = got[r["symbol"]]
        assert all(math.isclose(g[f"score_{k}"], v, abs_tol=1e-9) for k, v in s.items()), (r, s, g)
        assert (g.p_continue, g.p_reverse, g.confidence) == (go, 100 - go, sure)
