"""Candidates over data and the adaptive campaign, by hand and against plain shuffles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewright.operators import candidates as cn
from tidewright.operators import discovery as ds
from tidewright.operators import funnel as fn
from tidewright.operators import procedures as pr


def walk(spark, n=400, seed=7):
    rng, price, rows = random.Random(seed), 100.0, []
    for symbol in ("a", "b"):
        for i in range(n):
            price += rng.choice([-1.0, 0.0, 1.0, 2.0, -2.0])
            rows.append((symbol, i, f"2024-01-01 {i // 60 % 24:02}:{i % 60:02}:00", price))
    return spark.createDataFrame(rows, "symbol string, i long, ts string, price double").withColumn("ts", F.to_timestamp_ntz("ts"))


def spec(kind, parts, period=None, context=None, name=None):
    return Row(type=kind, name=name or "+".join(parts), period=period, parts=parts, context=context)


def test_composites_and_conditionals_follow_from_their_parts(spark):
    ticks = walk(spark).cache()
    specs = [
        spec("indicator", ["ema"], 14), spec("indicator", ["sma"], 10), spec("state", ["trend"], 20), spec("state", ["high_volatility"], 20),
        spec("composite", ["trend", "high_volatility"], 20), spec("conditional", ["trend"], 20, "momentum_state", "trend|momentum_state"),
        spec("conditional", ["up_cluster"], 10, "prior_candle", "up_cluster|prior_candle"), spec("proxy", ["up_cluster"], 10),
    ]
    wide = cn.series(ticks, specs).groupBy("symbol", "i").pivot("candidate").agg(F.first("value")).orderBy("symbol", "i").collect()
    price = {(r.symbol, r.i): r.price for r in ticks.collect()}
    assert len(wide) == 800
    for r in wide:
        k = (r.symbol, r.i)
        assert r["trend+high_volatility"] == (None if r.trend is None else float(r.trend != 0 and r.high_volatility != 0))
        moved = None if r.i < 10 else price[k] - price[r.symbol, r.i - 10]
        assert r["trend|momentum_state"] == (r.trend if moved is not None and moved > 0 else None)
        assert r.sma_10 is None if r.i < 9 else abs(r.sma_10 - sum(price[r.symbol, r.i - j] for j in range(10)) / 10) < 1e-9
        assert r["up_cluster|prior_candle"] is None  # one day has no candle before it
    e = price["a", 0]
    for i in range(1, 400):
        e += 2 / 15 * (price["a", i] - e)
        assert abs(wide[i].ema_14 - e) < 1e-9


def test_all_registered_candidates_are_the_same_in_small_chunks(spark):
    ticks = walk(spark, 300)
    specs = ds.candidates(spark, (10, 30)).filter("type <> 'event'").collect()
    few = [s for s in specs if s["name"] in ("hurst", "macd", "adx", "run_length", "trend+ranging", "local_minimum|expansion_state", "volatility_spike", "entropy_shift")]
    whole, cut = (cn.series(ticks, few, size).orderBy("symbol", "i", "candidate").collect() for size in (None, 90))
    assert len(whole) == len(cut) > 5000
    for a, b in zip(whole, cut, strict=True):
        assert (a.value is None) == (b.value is None) and (a.value is None or math.isclose(a.value, b.value, abs_tol=1e-9)), a


@pytest.mark.parametrize("bad", [spec("indicator", ["nothing"], 10), spec("event", ["time_gap"]), spec("conditional", ["trend"], 20, "weather")])
def test_what_ticks_cannot_show_is_refused(spark, bad):
    with pytest.raises(cn.Unresolvable):
        cn.series(walk(spark, 5), [bad])


def values(spark, rows):
    return spark.createDataFrame([("f", float(v), int(y)) for v, y in rows], "feature string, value double, label int")


def test_thresholds_are_values_at_exact_places(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.randrange(2)) for _ in range(203)]
    got = {r.share: (r.threshold, r.n) for r in fn.thresholds(values(spark, rows)).collect()}
    ordered = sorted(v for v, _ in rows)
    assert got == {s: (ordered[max(0, int(s * 203) - 1)], 203) for s in fn.SHARES}
    assert fn.generated(values(spark, rows[:9])).count() == 0 and fn.generated(values(spark, rows)).count() == 7


def test_drawn_tables_are_those_of_shuffled_labels(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, 120)
    y = (rng.random(120) < 0.25 + 0.1 * x).astype(int)
    sizes = np.bincount(x, minlength=4)
    made = fn.shuffled(np.random.default_rng(1), sizes, int(y.sum()), 4000)
    assert (made.sum(axis=1) == y.sum()).all() and (made <= sizes).all()
    plain = np.array([np.bincount(x, weights=rng.permutation(y), minlength=4) for _ in range(4000)])
    assert np.abs(made.mean(0) - plain.mean(0)).max() < 0.2 and np.abs(made.std(0) - plain.std(0)).max() < 0.15
    rows = values(spark, zip(x.tolist(), y.tolist()))
    table = fn.tables(rows, fn.generated(rows))
    got = {r.candidate: r for r in table.collect()}
    seen = float(fn.bits(sizes, np.bincount(x, weights=y, minlength=4)[None, :].astype("i8"))[0])
    assert math.isclose(got["f__raw"].score, seen, abs_tol=1e-12)
    p = {r.candidate: r.p for r in fn.shuffle_test(table, 2000, 42).collect()}
    plainly = (1 + (fn.bits(sizes, plain.astype("i8")) >= seen).sum()) / 4001
    assert abs(p["f__raw"] - plainly) < 0.02 and len(p) == 7
    assert p == {r.candidate: r.p for r in fn.shuffle_test(table.repartition(5), 2000, 42).collect()}


def test_tables_of_billions_are_drawn_too():
    sizes = np.array([4 * 10**10, 10**10, 3])
    made = fn.shuffled(np.random.default_rng(2), sizes, 2 * 10**10, 500)
    assert (made.sum(axis=1) == 2 * 10**10).all() and (made >= 0).all() and (made <= sizes).all()
    share = 2 * 10**10 / sizes.sum()
    assert abs(made[:, 1].mean() - 10**10 * share) < 3 * 10**4 and 0.5 < made[:, 1].std() / math.sqrt(10**10 * share * (1 - share) * 0.8) < 2


def test_campaign_finds_what_is_planted_and_nothing_else(spark):
    rng = random.Random(3)
    rows = [(k, rng.random(), rng.random(), float(rng.randrange(3)), rng.randrange(2)) for k in range(600)]
    rows = [(k, a, b + 0.8 * y, c if k % 4 else None, y) for k, a, b, c, y in rows]
    df = spark.createDataFrame(rows, "k long, noise double, signal double, lacking double, y int")
    features = ("noise", "signal", "lacking")
    got = {r.candidate: r for r in fn.campaign(df, "k", F.col("y"), "fam", features).collect()}
    assert len(got) == 14 and not any(c.startswith("lacking") for c in got)
    assert {c for c, r in got.items() if r["round"] >= 2} == {r.candidate for r in sorted(got.values(), key=lambda r: -r.score)[:3]}
    won = [r for r in got.values() if r["round"] == 4]
    assert won and all(r.candidate.startswith("signal") and r.lockbox and r.deep_p <= r.alpha_spent for r in won)
    assert all(r.cheap_p is None and r.deep_p is None for r in got.values() if r["round"] == 1)
    summary = fn.verdict(spark.createDataFrame(list(got.values()), "candidate string, feature string, kind string, direction string, threshold double, rows long, positives long, sizes array<long>, hits array<long>, score double, cheap_p double, deep_p double, family string, alpha_spent double, round int, outcome string, lockbox string")).first()
    assert summary.decision == "DISCOVERY_CANDIDATE" and summary.round1 == 14
    shuffled = df.withColumn("y", F.pmod(F.xxhash64("k"), F.lit(2)).cast("int"))
    none = fn.campaign(shuffled, "k", F.col("y"), "fam", features)
    assert none.filter("round = 4").count() == 0 and fn.verdict(none).first().decision == "NULL_RESULT"
    with pytest.raises(fn.InsufficientData):
        fn.screening(df.limit(29), "k", F.col("y"), features)


def test_series_are_summed_up_as_columns(spark):
    ticks = walk(spark)
    specs = [spec("indicator", ["sma"], 10), spec("indicator", ["run_length"], 14), spec("state", ["trend"], 20), spec("conditional", ["trend"], 20, "momentum_state", "trend|momentum_state")]
    got = cn.summary(cn.wide(ticks, specs), [cn.label(s) for s in specs], 5)
    assert "Expand" not in got._jdf.queryExecution().toString()
    rows = cn.series(ticks, specs).withColumn("value", F.round("value", 5))
    plain = rows.groupBy("symbol", "candidate").agg(F.count("value").alias("known"), F.avg("value").alias("mean"), F.count_if(F.col("value") != 0).alias("active"))
    by = lambda df: sorted(df.collect(), key=lambda r: (r.symbol, r.candidate))
    for a, b in zip(by(got), by(plain), strict=True):
        assert a[:3] == b[:3] and a.active == b.active and math.isclose(a["mean"], b["mean"], rel_tol=1e-12)


def test_information_of_columns_is_that_of_rows(spark):
    rng = random.Random(9)
    odd = [float("nan"), float("inf"), -float("inf"), None, -0.0, 4e-6, 5e-6, 0.015625, 1e300]
    rows = [(k % 2, rng.random(), odd[rng.randrange(len(odd))], odd[3 + rng.randrange(5)], None, 7.0, round(rng.gauss(0, 1) + k % 2, 3)) for k in range(3000)]
    names = ["plain", "odd", "small|x", "lacking", "flat", "a+b"]
    df = spark.createDataFrame(rows, "label int, plain double, odd double, `small|x` double, lacking double, flat double, `a+b` double").repartition(5)
    wide = {r.feature: r for r in pr.core(pr.columns_information).run_columns(df, {n: "state" for n in names}).collect()}
    long = df.unpivot(["label"], [F.col(f"`{n}`") for n in names], "feature", "value").withColumn("value", F.round("value", 5)).filter("value is not null")
    plain = pr.core().run(long, spark.createDataFrame([(n, "state") for n in names], "feature string, type string")).collect()
    assert len(plain) == len(wide) == 5 and wide["a+b"].information > 0.05
    for r in plain:
        assert wide[r.feature].pairs == r.pairs and wide[r.feature].rises == r.rises and abs(wide[r.feature].information - r.information) < 1e-12, r.feature
    with pytest.raises(pr.Unregistered):
        pr.core(pr.columns_information).run_columns(df, {"plain": "state", "odd": "rumour"})


@pytest.mark.parametrize("name", ["candidate_series", "candidate_information"])
def test_no_query_makes_a_row_of_each_candidate_and_tick(spark, monkeypatch, name):
    from tidewright.plans import candidates as queries

    made = []
    monkeypatch.setattr(queries, "stored", lambda df, _: made.append(df) or df)
    made.append(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not any("Expand" in df._jdf.queryExecution().toString() for df in made)
