"""Burst metrics and signals against a plain loop over ticks, in chunks and as a stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import bursts as bs
from tidewright.streaming import live


def prices() -> dict[str, list[float]]:
    """Streams with bursts, a run and a flat stretch longer than any buffer, and one too short for anything."""
    rng = np.random.default_rng(3)
    walk, way = [500.0], 1
    for t in range(9000):
        way = way if rng.random() < 0.93 else -way
        walk.append(walk[-1] + way * (1 + 0.6 * (t % 7)) * (0.5 + rng.random()))
    steady = [float(100 + k) for k in range(900)] + [1000.0] * 900 + [1001.0, 1003.0] + [1003.0 - (k % 3) for k in range(300)]
    smooth = np.convolve(rng.normal(size=1500), np.ones(14) / 14, "valid").tolist()
    return {"walk": walk, "steady": steady, "smooth": smooth, "short": [1.0, 2.0, 2.0], "one": [1.0]}


def loop(p: list[float]) -> tuple[list[dict], list[tuple]]:
    """Each tick's metrics and the signals, from the last 600 ticks, one tick after another."""
    raw = [0] + [int(np.sign(b - a)) for a, b in zip(p, p[1:])]
    mag = [0.0] + [abs(b - a) for a, b in zip(p, p[1:])]
    d = []
    for r in raw:
        d.append(r if r or not d else d[-1])
    rows, ages, signals, fired = [], {"broke": None, "speeds": None}, [], -9
    for j in range(len(p)):
        w = min(14, j + 1)
        m = dict.fromkeys(("td", "td_pct", "drift", "accel", "run", "run_dir", "exhaustion", "persistence", "low"), 0) | {"p_run": 0.0625}
        if j >= 3:
            td, total = sum(d[j - w + 1 : j + 1]), sum(mag[j - w + 1 : j + 1])
            seg = p[max(0, j - 2 * max(2, w // 2) + 1) : j + 1]
            a, b = seg[: len(seg) // 2], seg[len(seg) // 2 :]
            pace = lambda x: (x[-1] - x[0]) / (len(x) - 1) if len(x) > 1 else 0.0
            run = 0
            while run < min(600, j + 1) and d[j] and d[j - run] == d[j]:
                run += 1
            fade = 0.0
            if run >= 4:
                sizes = mag[j - run + 1 : j + 1]
                e, late = np.mean(sizes[: run // 2]) or 1e-9, np.mean(sizes[run // 2 :])
                fade = min(1.0, max(0.0, (e - late) / e))
            best, fails = -math.inf, 0
            for x in p[max(0, j - 5) : j + 1]:
                fails += not x * d[j] > best
                best = max(best, x * d[j])
            seq = [x for x in d[max(0, j - 59) : j + 1] if x]
            pairs = list(zip(seq, seq[1:]))
            mean, low = {}, {}
            for s in (1, -1):
                n, k = sum(x == s for x, _ in pairs), pairs.count((s, s))
                mean[s] = (k + 1) / (n + 2)
                low[s] = max(0.0, mean[s] - 1.28 * math.sqrt(mean[s] * (1 - mean[s]) / (n + 3))) ** 4
            side = int(np.sign(td))
            m = {
                "td": td, "td_pct": td / w * 100, "drift": int(np.sign(p[j] - p[max(0, j - 29)])), "accel": (pace(b) - pace(a)) * side / (total / w or 1e-9), "run": run, "run_dir": d[j],
                "exhaustion": math.floor(100 * (0.34 * min(1, run / 8) + 0.30 * fade + (0.36 * fails / min(6, j + 1) if d[j] else 0)) + 0.5), "persistence": mean[1] + mean[-1] - 1,
                "p_run": mean[side] ** 4 if side else max(mean.values()) ** 4, "low": low[side] if side else max(low.values()),
            }
        for name, on in (("broke", abs(m["td_pct"]) >= 35), ("speeds", m["accel"] > 0.02)):
            ages[name] = (0 if ages[name] is None else ages[name] + 1) if on else None
        side = int(np.sign(m["td"]))
        fresh = [x is not None and x <= 3 for x in ages.values()]
        m["met"] = sum([*fresh, m["exhaustion"] <= 55, m["run_dir"] == side and 2 <= m["run"] <= 6, m["drift"] == side, m["persistence"] >= 0.03, m["low"] * 100 >= 8])
        if m["met"] == 7 and side and j - fired >= 4:
            fired, size = j, mag[j : j + 5]
            won = not any(r == -side and s > 0.2 * np.mean(size) for r, s in zip(raw[j : j + 5], size)) and np.sign(p[min(j + 4, len(p) - 1)] - p[j]) == side
            signals.append((j, side, math.floor(m["p_run"] * 100 + 0.5), raw[j : j + 5].count(side), "pend" if j + 5 > len(p) else "win" if won else "loss"))
        rows.append(m)
    return rows, signals


@pytest.fixture(scope="module")
def stream(spark):
    rows = [(s, i, x) for s, p in prices().items() for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "symbol string, i long, price double")


def test_metrics_equal_a_plain_loop(stream):
    got = bs.metrics(stream).toPandas().sort_values("i")
    for s, p in prices().items():
        g, want = got[got["symbol"] == s].to_dict("records"), loop(p)[0]
        assert len(g) == len(want)
        for r, w in zip(g, want):
            assert (r["td"], r["drift"], r["run"], r["run_dir"], r["conditions_met"]) == (w["td"], w["drift"], w["run"], w["run_dir"], w["met"]), (s, r, w)
            assert r["exhaustion"] == w["exhaustion"]
            for a, b in (("td_pct", "td_pct"), ("accel_aligned", "accel"), ("persistence", "persistence"), ("p_run", "p_run"), ("p_run_low", "low")):
                assert math.isclose(r[a], w[b], rel_tol=1e-9, abs_tol=1e-9), (s, a, r, w)
    steady = got[got["symbol"] == "steady"]
    assert steady["run"].max() == bs.LONGEST and steady["run_dir"].iloc[1700] == 1


def test_chunks_give_what_the_whole_stream_does():
    p = np.array(prices()["steady"])
    move = np.diff(p, prepend=p[0])
    d = np.maximum.accumulate(np.where(move != 0, np.arange(len(p)), 0))
    d = np.sign(move).astype(int)[d]
    whole, part = (bs.measured(np.arange(k, len(p)), p[k:], d[k:], np.abs(move[k:])) for k in (0, 500))
    assert all(np.allclose(whole[n][500 + bs.HALO :], part[n][bs.HALO :]) for n in whole)


@pytest.mark.parametrize("batches", [1, 7])
def test_streamed_signals_equal_batch_and_loop(spark, stream, tmp_path, batches):
    want = {(s, *x) for s, p in prices().items() for x in loop(p)[1]}
    got = {tuple(r) for r in bs.signals(stream).select("symbol", "i", "direction", "prob", "in_direction", "result").collect()}
    assert got == want and len(want) > 10 and {x[5] for x in want} >= {"win", "loss"}
    rows = [(s, i, x) for s, p in prices().items() for i, x in enumerate(p)]
    rows = sorted(rows, key=lambda r: r[1])
    schema = "symbol string, event_id long, price double"
    for k in range(batches):
        spark.createDataFrame(rows[k * len(rows) // batches : (k + 1) * len(rows) // batches], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withColumn("ts", F.timestamp_seconds("event_id"))
    out = f"file://{tmp_path}/out"
    live.signals(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(x for x in want if x[5] != "pend")
