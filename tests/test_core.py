import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import indicators as ind
from tidewright.functions import signals as sg
from tidewright.functions import windows as wd
from tidewright.operators import candles as cd
from tidewright.operators import governance as gv
from tidewright.operators import machines as mc
from tidewright.operators import patterns as pt
from tidewright.operators import point_process as pp
from tidewright.operators import resampling as rs
from tidewright.operators import runs as rn
from tidewright.operators import snapshots as sn
from tidewright.operators import statistics as st
from tidewright.sources import ledger as lg
from tidewright.sources.shared import place
from tidewright.sources.ticks import candles_by_count, index_by_day

SF = "/root/testdata/sf0.001"


def stream(spark, prices, gap_s=1, symbol="A"):
    rows = [(symbol, i, i, float(p), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=gap_s * i)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "i", "event_id", "price", "ts"]))
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def walk(n, seed=1):
    return np.round(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n)), 2)


def test_chunks_change_nothing(spark):
    t = stream(spark, walk(500))
    for f in (ind.windowed, ind.recursive, sg.states, sg.proxies, sg.derived):
        whole, cut = (f(t, size=s).orderBy("i").toPandas() for s in (10_000, 128 if f is not ind.recursive else 300))
        for c in whole.columns:
            if whole[c].dtype.kind == "f":
                np.testing.assert_allclose(whole[c].to_numpy("f8"), cut[c].to_numpy("f8"), rtol=1e-9, atol=1e-9, err_msg=c)


def test_indicators_on_flat_and_short_streams(spark):
    out = ind.windowed(stream(spark, [5.0] * 40)).orderBy("i").toPandas().iloc[-1]
    assert (out["cci"], out["stochastic_k"], out["skewness"], out["kurtosis"], out["autocorrelation"], out["volatility"]) == (0, 50, 0, -3, 0, 0)
    assert pd.isna(out["zscore"]) and pd.isna(out["bollinger_position"]) and pd.isna(out["hurst"]) and pd.isna(out["directional_entropy"])
    assert ind.windowed(stream(spark, [5.0, 6.0])).select("sma").filter("sma is not null").count() == 0
    assert ind.windowed(stream(spark, [1.0]).limit(0)).count() == 0


def test_rsi_by_hand(spark):
    up = ind.recursive(stream(spark, range(1, 30))).orderBy("i").toPandas()
    assert up["rsi"].isna().sum() == 14 and up["rsi"].iloc[-1] == 100
    assert up["ema"].iloc[0] == 1 and math.isclose(up["ema"].iloc[1], 1 + 2 / 15)


def test_run_events_restart(spark):
    t = stream(spark, [1, 2, 3, 4, 5, 6, 7, 8, 7, 7, 6])
    got = rn.runs(t, 3).orderBy("i").toPandas()
    assert got["i"].tolist() == [3, 6] and got["direction"].tolist() == [1, 1]
    assert column(ind.run_lengths(t), "run_length") == [None, 1, 2, 3, 4, 5, 6, 7, 1, 1, 1]


def test_sessions_split_over_the_gap_only(spark):
    t = stream(spark, [1, 2, 3], gap_s=30)
    assert column(rn.sessions(t), "session") == [0, 0, 0]
    assert column(rn.sessions(stream(spark, [1, 2, 3], gap_s=31)), "session") == [0, 1, 2]


def test_backfill_and_links(spark):
    found = rn.runs(stream(spark, list(range(13))), 3)
    assert rn.backfill(found, found.filter("i <= 6")).count() == 2
    links = rn.linked(found).orderBy("i").toPandas()
    assert links["tick_gap"].isna().tolist() == [True, False, False, False] and links["time_gap"].tolist()[1] == 3000


def test_day_index_equals_plain_numbering(spark):
    rows = spark.createDataFrame([("A", d, k) for d in (1, 2, 3) for k in range(4)], "s string, d int, k int")
    got = index_by_day(rows, ["s"], ["d", "k"], F.col("d"), "i").orderBy("d", "k").toPandas()
    assert got["i"].tolist() == list(range(12))


def test_path_features_by_hand(spark):
    h = [100, 102, 99, 105, 101, 98, 103, 100, 104, 102, 99, 101, 103, 100, 102, 98, 105, 103, 100, 104]
    a = [100, 101] * 10
    rows = spark.createDataFrame([(1, [float(x) for x in h]), (2, [float(x) for x in a])], "i int, h array<double>")
    got = rows.select("i", sn.path_features(F.col("h")).alias("f")).select("i", "f.*").orderBy("i").toPandas()
    one, two = got.iloc[0], got.iloc[1]
    assert (one["ncf_net_displacement"], one["ncf_abs_path_length"]) == (4, 64) and math.isclose(one["ncf_mean_first_diff"], 4 / 19)
    assert (two["ncf_up_tick_count"], two["ncf_down_tick_count"], two["ncf_reversal_count"], two["ncf_max_run_len"]) == (10, 9, 18, 1)
    assert math.isclose(two["ncf_std_first_diff"], math.sqrt(380) / 19) and math.isclose(two["ncf_dir_entropy"], -(10 / 19 * math.log(10 / 19) + 9 / 19 * math.log(9 / 19)))


def candle(spark, rows):
    return spark.createDataFrame([("A", i, i * 60, *map(float, r)) for i, r in enumerate(rows)], "symbol string, c long, epoch long, open double, high double, low double, close double")


def test_candle_patterns_by_hand(spark):
    c = candle(spark, [(10, 11, 8, 9), (8.5, 12, 8, 11), (11, 11.5, 9, 11.2), (5, 5, 5, 5), (7, 7.2, 4, 7.1)])
    got = {(r.type, r.c, r.direction) for r in pt.candlesticks(c).collect()}
    assert ("engulfing", 1, "bullish") in got and ("pinBar", 2, "bullish") in got and ("pinBar", 4, "bullish") in got
    assert not any(t == "doji" and i == 3 for t, i, _ in got)
    assert cd.statistics(c, "c").toPandas()["candle_count"].iat[0] == 5


def test_causal_structure_never_sees_an_unconfirmed_swing(spark):
    c = candle(spark, [(x, x + 1, x - 1, x) for x in (1, 2, 5, 3, 2, 6, 7, 3, 1, 9)])
    seen = pt.with_structure(c, 2, causal=True).orderBy("c").toPandas()
    assert seen["last_high"].isna().tolist()[:4] == [True] * 4 and seen["last_high"].iat[4] == 6
    assert pt.with_structure(c, 2).orderBy("c").toPandas()["last_high"].iat[3] == 6


def test_wealth_and_hysteresis(spark):
    t = spark.createDataFrame([("f", 1, 0.001), ("f", 2, 0.9), ("f", 3, 0.02)], "family string, k long, p double")
    got = gv.wealth(t, "family", "k", "p").orderBy("seq").toPandas()
    assert np.allclose(got["wealth_after"], [0.0375, 0.01875, 0.009375]) and got["rejected"].tolist() == [True, False, False]
    e = spark.createDataFrame([("s", i, v) for i, v in enumerate([True, True, False, True, True, True, True, False])], "s string, k int, raw boolean")
    got = gv.hysteresis(e, "s", "k", "raw", 3).orderBy("k").toPandas()
    assert got["state_after"].tolist() == ["stable"] * 5 + ["drifted"] * 3 and got["published"].tolist().index(True) == 5


def test_ladder_allowed_moves_and_fingerprints(spark):
    rows = spark.createDataFrame([(1, 0.2, 5), (2, 0.01, 1), (3, 0.01, 9)], "k int, p double, n int")
    got = gv.verdict_ladder(rows, [("insignificant", F.col("p") > 0.05), ("too few", F.col("n") < 5)], "passed").orderBy("k").toPandas()
    assert got["verdict"].tolist() == ["insignificant", "too few", "passed"]
    moves = [(1, k, to) for k, to in enumerate(["Registration", "Discovery", "FeatureGeneration", "Discovery", "Discovery", "Replication", "Lockbox"])] + [(2, 0, "Discovery"), (2, 1, "Registration"), (None, 0, "Registration")]
    got = mc.lifecycle(spark.createDataFrame(moves, "h int, k int, to string"), "h", "k", "to", F.col("k") == 4).orderBy("h", "k").toPandas()
    assert got["valid"].tolist() == [True, True, False, True, True, True, True, True, False, True]
    assert got[got["h"] == 1]["seq"].tolist()[:3] != [0, 1, 2] and got[got["h"] == 1]["from"].tolist()[1:4] == ["Registration", "Registration", "FeatureGeneration"] and got["refused"].tolist()[2] == "transition"
    keys = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "m map<string,string>").select(gv.fingerprint(F.col("m")).alias("f"), gv.family_key("fam", F.lit("R_100"), F.col("m")).alias("k"))
    assert keys.distinct().count() == 1 and keys.first().k == "fam:R_100:a=2,b=1"


def test_ledger_rules(spark):
    log = lg.Ledger(spark, place(spark, "ledger"), "id string, seq long, v double", ["id", "seq"])
    row = lambda *r: spark.createDataFrame(list(r), log.schema)
    log.append(row(("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)))
    with pytest.raises(lg.DuplicateKey):
        log.append(row(("a", 1, 9.0)))
    kept = {(r.id, r.seq): (r.v, r.created) for r in log.write_once(row(("a", 1, 9.0), ("c", 0, 4.0))).collect()}
    assert kept == {("a", 1): (2.0, False), ("c", 0): (4.0, True)}
    assert {(r.id, r.v) for r in log.latest(["id"], "seq").collect()} == {("a", 2.0), ("b", 3.0), ("c", 4.0)}
    assert [r.seq for r in log.newest("seq", 1, id="a").collect()] == [1]
    box = spark.createDataFrame([("x", None), ("y", 5)], "k string, at_ long")
    used = lg.consume(box, "k", "at_", spark.createDataFrame([("x", 7), ("x", 6), ("y", 9)], "k string, at long"))
    assert {(r.k, r.at_) for r in used.collect()} == {("x", 6), ("y", 5)}


def test_duplicate_and_gap_policies(spark):
    rows = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 3.0), ("s", 2, None)], "s string, t int, v double").withColumn("n", F.monotonically_increasing_id())
    count = lambda p: lg.deduplicate(rows, ["s", "t"], "n", p).count()
    assert (count("keep_first"), count("keep_last"), count("reject"), count("average")) == (2, 2, 1, 2)
    assert column(lg.forward_filled(rows, "s", "n", "v"), "v", "n") == [1.0, 3.0, 3.0]


def test_statistics_by_hand(spark):
    assert np.allclose(st.mulberry(42, 3), [0.6011037519201636, 0.44829055899754167, 0.8524657934904099])
    v = spark.createDataFrame([("f", i, float(i), int(i >= 4)) for i in range(8)], "feature string, id int, value double, label int")
    got = st.ranked(v, "id").first()
    assert math.isclose(got["mutual_information"], 1) and math.isclose(got["split_gain"], 0.5) and got["delta"] == 4
    assert st.rank_biserial(v).first()["r"] == 1 and st.kolmogorov_smirnov(v, F.col("label") == 1, "value", ["feature"]).first()["statistic"] == 1
    one = spark.range(1).select(st.normal_cdf(F.lit(1.96)).alias("c"), st.achieved_power(F.lit(0.0), F.lit(1.0), 1.96).alias("p")).first()
    assert math.isclose(one.c, 0.975, abs_tol=1e-4) and math.isclose(one.p, 0.05, abs_tol=1e-3)
    b = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "k int, p double")
    assert np.allclose(st.benjamini_hochberg(b, "k", "p").orderBy("k").toPandas()["adjusted_p"], [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    e = spark.createDataFrame([("f", 0, 1.0, 1.0), ("f", 1, -1.0, 1.0), ("g", 0, 1.0, 1.0)], "feature string, partition int, effect double, overall double")
    assert {r.feature: r.stability for r in st.stability(e).collect()} == {"f": 0.5, "g": None}


def test_permutation_and_bootstrap_recover_dependence(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    rows = pd.DataFrame({"s": ["dep"] * 300 + ["ind"] * 300, "i": list(range(300)) * 2, "x": np.r_[x, x], "y": np.r_[x + rng.normal(0, 0.1, 300), rng.normal(size=300)]})
    df = spark.createDataFrame(rows)
    p = {r.s: r.p_value for r in rs.permutation_test(df, ["s"], "i", "x", "y", 99).collect()}
    assert p["dep"] == 0.01 < p["ind"]
    b = {r.s: r for r in rs.bootstrap(df, ["s"], "i", "x", "y", 200).collect()}
    assert b["dep"].low > 0.9 and b["ind"].low < 0 < b["ind"].high


def test_point_processes_recover_what_made_them():
    rng = np.random.default_rng(5)
    assert pp.poisson(rng.exponential(2, 200), rng)[1] > 0.05
    assert pp.poisson(0.5 + rng.random(300), rng)[1] < 0.05 and pp.renewal(0.5 + rng.random(300))[1]
    states = np.repeat(rng.random(20) < 0.5, 15)
    mixed = np.where(states, rng.exponential(0.2, 300), rng.exponential(5, 300))
    found = pp.hierarchy(mixed, rng.random(300) < 0.5, times=20)
    assert found["verdict"] in ("hawkes", "hidden states") and found["independent"] is False and found["distribution"] is None
    assert pp.hierarchy(rng.exponential(2, 200), rng.random(200) < 0.5, times=5)["hawkes_p"] is None
    rises = rng.random(200) < 0.5
    assert pp.labelled(np.where(rises, rng.exponential(1, 200), rng.exponential(4, 200)), rises, rng)[1] < 0.05


def test_aggression_verdicts(spark):
    t = stream(spark, [1, 2, 3, 4, 5, 4, 5, 4])
    got = cd.aggression(t, 4).orderBy("start").toPandas()
    assert got["up_ticks"].tolist() == [3, 2] and got["score"].tolist() == [100, 0] and got["verdict"].tolist()[1] == "NEUTRAL"


def test_flagship_and_short_candles(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert column(candles_by_count(stream(spark, range(25))), "n", "c") == [10, 10, 5]


def test_burst_metrics_by_hand(spark):
    from tidewright.operators import bursts as bs

    m = bs.metrics(stream(spark, [float(p) for p in (5, 6, 7, 7, 8, 9, 8)])).orderBy("i").toPandas()
    assert m["td"].tolist() == [0, 0, 0, 3, 4, 5, 4]  # flat ticks take the last direction; nothing before four ticks
    assert m["run"].tolist() == [0, 0, 0, 3, 4, 5, 1] and m["run_dir"].tolist()[-1] == -1
    up = (4 + 1) / (5 + 2)  # ups followed: by ups four times, by a down once
    assert math.isclose(m["persistence"].iat[-1], up + 0.5 - 1) and math.isclose(m["p_run"].iat[-1], up**4)
    assert m["exhaustion"].iat[3] == 22  # 34 * 3 / 8 for the run and 36 * 1 / 4 for extremes


def test_one_open_signal_blocks_others(spark):
    from tidewright.operators import bursts as bs

    rng = np.random.default_rng(1)
    ready = np.flatnonzero(rng.random(400) < 0.3).tolist()
    want, last = [], -9
    for i in ready:
        if i - last >= 4:
            want.append(i)
            last = i
    rows = spark.createDataFrame([("a", i) for i in ready], "symbol string, i long")
    assert sorted(r.i for r in bs.unblocked(rows).collect()) == want


def test_closure_reaches_any_depth(spark):
    chain = [(i, i + 1) for i in range(12)] + [(0, 5), (20, 21), (21, 20)]
    got = {(r.node, r.ancestor): r.distance for r in gv.closure(spark.createDataFrame(chain, "child long, parent long")).collect()}
    hop = lambda i, j: min(j - i, 1 + j - 5) if i == 0 and j >= 5 else j - i
    want = {(i, j): hop(i, j) for i in range(12) for j in range(i + 1, 13)}
    assert got == want | {(20, 21): 1, (21, 20): 1, (20, 20): 2, (21, 21): 2}


def test_signals_fire_and_block_as_a_plain_loop_says(spark):
    from tidewright.operators import bursts as bs

    rng, p, way = np.random.default_rng(12), [500.0], 1
    for t in range(3000):
        way = way if rng.random() < 0.93 else -way
        p.append(p[-1] + way * (1 + 0.6 * (t % 7)) * (0.5 + rng.random()))
    df = stream(spark, p)
    rows = bs.metrics(df).orderBy("i").toPandas()
    got = {r.i: r for r in bs.signals(df).collect()}
    fired, last = [], -100
    for i in rows[rows["ready"]]["i"]:
        if i - last >= bs.HORIZON - 1:
            fired.append(i)
            last = i
    assert len(fired) > 1 and sorted(got) == fired
    for i in fired:
        side, ahead = int(np.sign(rows["td"][i])), p[i : i + bs.HORIZON]
        moves = [p[k] - p[k - 1] for k in range(i, min(len(p), i + bs.HORIZON))]
        floor = bs.NOISE * np.mean(np.abs(moves))
        won = not any(np.sign(m) == -side and abs(m) > floor for m in moves) and np.sign(ahead[-1] - ahead[0]) == side
        assert (got[i].direction, got[i].result) == (side, "pend" if len(ahead) < bs.HORIZON else "win" if won else "loss")


def test_biases_take_the_first_rung_that_holds(spark):
    from tidewright.operators import scoring as sc

    cases = {  # symbol: trend, buying pressure, findings, market, narrative
        "a": ("up", 50, [("bullishContinuation", "bullish", 61)], "Bullish", "bullish"), "b": ("up", 60, [("bearishContinuation", "bearish", 55)], "Bullish", "bearish"),
        "c": ("down", 40, [("reversal", "bullish", 65)], "Bearish", "bullish"), "d": ("none", 40, [("reversal", "bearish", 90), ("accumulation", "none", 80)], "Bearish", "bearish"),
        "e": ("up", 60, [("distribution", "none", 70)], "Ranging", "ranging"), "f": ("up", 53, [], "Bullish", "bullish"), "g": ("down", 47, [], "Bearish", "bearish"), "h": ("up", 52, [], "Bullish", "neutral"), "i": ("none", 90, [], "Neutral", "neutral"),
    }
    rows = spark.createDataFrame([(k, 20, t, float(b), 100.0 - b) for k, (t, b, *_) in cases.items()], "symbol string, candle_count int, trend string, buying_pressure_pct double, selling_pressure_pct double")
    found = spark.createDataFrame([(k, *f[:2], float(f[2])) for k, c in cases.items() for f in c[2]], "symbol string, type string, direction string, confidence double")
    assert {r.symbol: (r.market, r.narrative) for r in sc.biases(rows, found).collect()} == {k: c[3:] for k, c in cases.items()}


def test_cascade_says_what_each_timeframe_looks_at(spark):
    from tidewright.operators import scoring as sc

    def candles(closes):
        # a turn belongs to one candle, which reaches a little further than the next
        rows = [("A", i, i * 60, a, b + 0.1 if b >= a else a, a if b >= a else b - 0.1, b, 10) for i, (a, b) in enumerate(zip(closes, closes[1:]))]
        return spark.createDataFrame(rows, "symbol string, c long, epoch long, open double, high double, low double, close double, n long")

    up = [100 + 2.0 * (k // 8) + (k % 8 if k % 8 <= 5 else 10 - k % 8) for k in range(45)]
    said = {tf: sc.cascade(candles(up), tf).first().verdict for tf in sc.CASCADE}
    assert said["daily"] == "Bullish trend remains intact." and said["h4"].startswith(("Healthy", "Trend continuing")) and said["m5"].startswith("Momentum")
    assert {sc.cascade(candles(up[:10]), tf).first().verdict for tf in sc.CASCADE} == {"Not enough data loaded for this timeframe."}


def test_confirmation_finds_what_is_there_and_says_when_it_is_unsure(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(150)
    rows = [("dep", i, float(a), float(a + 0.3 * b)) for i, (a, b) in enumerate(zip(x, rng.standard_normal(150)))] + [("ind", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, rng.standard_normal(150)))] + [("few", i, 1.0, float(i)) for i in range(59)]
    got = {r.s: r for r in rs.confirmation(spark.createDataFrame(rows, "s string, i int, x double, y double"), ["s"], "i", "x", "y", 199, 300).collect()}
    assert set(got) == {"dep", "ind"} and got["dep"].p_value == 1 / 200 and got["dep"].warnings == "least p" and got["dep"].ci_lower > 0.9
    assert math.isclose(got["dep"].effect, np.corrcoef([r[2] for r in rows[:150]], [r[3] for r in rows[:150]])[0, 1]) and got["ind"].p_value > 0.01 and got["ind"].ci_lower < 0 < got["ind"].ci_upper


def test_data_without_an_effect_is_seldom_found(spark):
    from tidewright.operators import discovery as ds

    got = ds.null_trials(spark, 60).groupBy("kind").agg(F.count("*").alias("n"), F.avg((F.col("p_value") <= 0.05).cast("double")).alias("found")).collect()
    assert {r.kind for r in got} == set(ds.NULLS) and all(r.n == 60 and r.found < 0.2 for r in got)


def test_searches_find_the_best_of_a_known_landscape():
    from tidewright.operators import search as se

    worth = (3.0, -2.0, 1.0, 0.5, -1.0, 2.0)
    score = lambda masks: {m: sum(w for w, on in zip(worth, m, strict=True) if on) / 10 for m in masks}
    best = tuple(w > 0 for w in worth)
    assert se.evolved(score, 6, generations=40)[0] == best
    mask, value, visits = se.tree_search(score, 6, playouts=600)
    assert mask[0] and value > 0.4 and visits[1] > visits[0] and sum(visits.values()) == 600


def test_arrays_and_frames_give_the_same_indicators(spark):
    """Each indicator once over arrays of a chunk and once over frames, on moves, flat stretches, zeros and a short stream."""
    rng = random.Random(12)
    price, rows = 50.0, []
    for i in range(260):
        price += 0.0 if 90 <= i < 150 else rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0])
        rows.append(("a", i, 0.0 if 200 <= i < 203 else round(price, 2)))
    rows += [("b", i, 3.0 + i) for i in range(6)]
    ticks = spark.createDataFrame(rows, "symbol string, i long, price double")
    assert set(ind.ROLLING) == set(ind.WINDOWED)
    by_array = {(r.symbol, r.i): r for r in ind.windowed(ticks, size=70).collect()}
    frames = wd.own(wd.with_shared(ind.prepare(ticks), {n: lambda b=b, p=p: b(p) for n, (b, p) in ind.WINDOWED.items()})).collect()
    assert len(frames) == len(by_array) == 266
    for r in frames:
        for n in ind.WINDOWED:
            x, y = by_array[r.symbol, r.i][n], r[n]
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-7 * max(1, abs(y))), (n, r.symbol, r.i, x, y)


def test_long_periods_forget_what_is_before_their_halo(spark):
    rng = random.Random(1)
    price, rows = 100.0, []
    for i in range(9000):
        price += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
        rows.append(("a", i, price))
    ticks = spark.createDataFrame(rows, "symbol string, i long, price double")
    for period, size in ((40, 1000), (60, 700)):
        whole, cut = (ind.recursive(ticks, size=n, period=period).orderBy("i").toPandas() for n in (10_000, size))
        for name in ind.RECURSIVE:
            a, b = whole[name].astype("f8"), cut[name].astype("f8")
            assert (a.isna() == b.isna()).all() and np.nanmax(np.abs(a - b)) < 1e-9, name
    assert ind.recursive(ticks, period=500).filter("rsi is not null").count() == 8500
