"""Early bursts in a tick stream: metrics of the last ticks, the seven conditions of a signal, and what came of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scans import carried
from tidewright.functions.windows import chunked, frame, js_round, own, stream

#: Widths in ticks and thresholds.
WIDTH, TREND, MODEL, HORIZON = 14, 30, 60, 5
IMBALANCE, EXHAUSTED, YOUNG, FRESH, ACCEL, PERSISTENCE, LEAST_RUN, NOISE, FULL_RUN = 35, 55, 6, 3, 0.02, 0.03, 8, 0.2, 8
#: Weights of run length, fading moves and failed extremes in exhaustion.
FADE = (0.34, 0.30, 0.36)
#: A run counts at most LONGEST ticks, the length of the buffer that is looked at; HALO rows before a chunk tell all of it.
LONGEST = 600
HALO = LONGEST + MODEL

METRICS = "td_pct double, flow_pct double, drift int, accel_aligned double, run int, run_dir int, exhaustion long, persistence double, p_run double, p_run_low double, conditions_met int, ready boolean"


def _trailing(x: np.ndarray, n: int) -> np.ndarray:
    """A row for each of ``x``: it and the ``n - 1`` before it, 0 where there is none."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1, x.dtype), x]), n)


def _slope(p: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Change a tick from end to end of the ``size`` prices from ``start`` on."""
    last = np.minimum(start + np.maximum(size, 1) - 1, len(p) - 1)
    return np.where(size > 1, (p[last] - p[start]) / np.maximum(size - 1, 1), 0.0)


def _upto(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def measured(i: np.ndarray, p: np.ndarray, d: np.ndarray, mag: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of consecutive ticks numbered ``i`` with prices ``p``, carried directions ``d`` and sizes of moves ``mag``; right
    from the stream's beginning on, or after the first HALO ticks. What batches and streams compute alike."""
    j = np.arange(len(p))
    w = np.minimum(i + 1, WIDTH).astype(int)
    w = np.minimum(w, j + 1)
    td, mags, flow = _trailing(d, WIDTH).sum(axis=1), _trailing(mag, WIDTH).sum(axis=1), _trailing(d * mag, WIDTH).sum(axis=1)
    side = np.sign(td)
    # the last 2k ticks, k half the width but two at least, in halves of which each has a velocity from end to end
    size = np.minimum(2 * np.maximum(2, w // 2), w)
    half = np.maximum(size // 2, 1)
    start = j - size + 1
    accel = _slope(p, np.minimum(start + half, j), size - half) - _slope(p, start, half)
    aligned = accel * side / np.where(mags > 0, mags / w, 1e-9)
    # a run: how far back the direction stays what it is, and whether its moves fade
    begins = np.maximum.accumulate(np.where(np.append(True, d[1:] != d[:-1]), j, 0))
    run = np.where(d == 0, 0, np.minimum(j - begins + 1, LONGEST))
    cut, sums = run // 2, _upto(mag)
    early = (sums[j - run + 1 + cut] - sums[j - run + 1]) / np.maximum(cut, 1)
    late = (sums[j + 1] - sums[j - run + 1 + cut]) / np.maximum(run - cut, 1)
    early = np.where(early > 0, early, 1e-9)
    fading = np.where(run >= 4, np.clip((early - late) / early, 0.0, 1.0), 0.0)
    # of the last six prices those that set no new extreme in the run's direction
    there = _trailing(np.ones(len(p), bool), 6)
    lead = np.where(there, _trailing(p, 6) * d[:, None], -np.inf)
    best = np.maximum.accumulate(np.concatenate([np.full((len(p), 1), -np.inf), lead[:, :-1]], axis=1), axis=1)
    failed = (there & ~(lead > best)).sum(axis=1) / there.sum(axis=1)
    exhaustion = np.floor(100 * (FADE[0] * np.minimum(1.0, run / FULL_RUN) + FADE[1] * fading + np.where(d != 0, FADE[2] * failed, 0.0)) + 0.5)
    # a chain of two states: how often a move is followed by one like it, with a uniform prior and a bound below it
    before = np.append(0, d[:-1])
    since = np.maximum(j - MODEL + 2, 0)
    count = lambda a, b: (u := _upto((before == a) & (d == b)))[j + 1] - u[since]
    chance, low = {}, {}
    for way in (1, -1):
        same, n = count(way, way), count(way, way) + count(way, -way)
        chance[way] = (same + 1) / (n + 2)
        low[way] = np.maximum(0.0, chance[way] - 1.28 * np.sqrt(chance[way] * (1 - chance[way]) / (n + 3))) ** (HORIZON - 1)
    pick = lambda x: np.where(side > 0, x[1], np.where(side < 0, x[-1], np.maximum(x[1], x[-1])))
    known = i >= 3
    zero = lambda x: np.where(known, x, 0)
    out = {
        "td": zero(td), "td_pct": zero(td / w * 100), "flow_pct": zero(np.where(mags > 0, flow / np.where(mags > 0, mags, 1) * 100, 0.0)),
        "drift": zero(np.nan_to_num(np.sign(p - p[np.maximum(j - TREND + 1, 0)]))), "accel_aligned": zero(aligned), "run": zero(run), "run_dir": zero(d), "exhaustion": zero(exhaustion),
        "persistence": zero(chance[1] + chance[-1] - 1), "p_run": np.where(known, pick({k: c ** (HORIZON - 1) for k, c in chance.items()}), 0.0625), "p_run_low": zero(pick(low)),
    }
    # fresh: the condition holds and didn't at one of the FRESH + 1 ticks before
    fresh = lambda c: c & ~_trailing(c, FRESH + 2).all(axis=1)
    side = np.sign(out["td"])
    conditions = [
        fresh(np.abs(out["td_pct"]) >= IMBALANCE), fresh(out["accel_aligned"] > ACCEL), out["exhaustion"] <= EXHAUSTED, (out["run_dir"] == side) & (out["run"] >= 2) & (out["run"] <= YOUNG),
        out["drift"] == side, out["persistence"] >= PERSISTENCE, out["p_run_low"] * 100 >= LEAST_RUN,
    ]
    met = np.sum(conditions, axis=0)
    return out | {"conditions_met": met, "ready": (met == len(conditions)) & (side != 0)}


def metrics(ticks: DataFrame) -> DataFrame:
    """``ticks`` (symbol, i, price) with td_pct, flow_pct, drift, accel_aligned, run, run_dir, exhaustion, persistence and
    the model's chance of a run; rows with fewer than four ticks so far have neutral ones.

    A flat tick takes the direction of the last move, however far back that is. A null price is no move; what needs it is null,
    its drift 0."""
    change = F.col("price") - F.lag("price").over(stream())
    rows = chunked(ticks.select("symbol", "i", "price"), 1).withColumns({"raw": F.coalesce(F.signum(change), F.lit(0.0)).cast("int"), "mag": F.coalesce(F.abs(change), F.lit(0.0))})
    rows = carried(own(rows), F.when(F.col("raw") != 0, F.col("raw")), "dir")
    schema = f"symbol string, i long, price double, raw int, mag double, td int, {METRICS}"
    types = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        at, p, mag = (chunk.column(c).to_numpy() for c in ("i", "price", "mag"))
        made = measured(at, p.astype("f8"), chunk.column("dir").fill_null(0).to_numpy().astype("i8"), mag)
        keep = chunk.column("own").to_numpy()
        out = chunk.select(["symbol", "i", "price", "raw", "mag"]).filter(chunk.column("own"))
        for name, values in made.items():
            v = values[keep].astype({"int": "i4", "long": "i8", "double": "f8", "boolean": bool}[types[name]])
            out = out.append_column(name, pa.array(v, arrow[types[name]], from_pandas=True))
        return out

    return chunked(rows.select("symbol", "i", F.col("price").cast("double").alias("price"), "raw", "mag", "dir"), HALO).groupBy("symbol", "chunk").applyInArrow(run, schema)


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v, lambda a: a / F.greatest(F.size(x), F.lit(1)))


def unblocked(rows: DataFrame, gap: int = HORIZON - 1) -> DataFrame:
    """Of ``rows`` (symbol, i) those that fire: the first, and each that is ``gap`` ticks or more after the last that did.
    Rows less than ``gap`` apart make an island, and what fires in one doesn't depend on others; islands are short."""
    w = Window.partitionBy("symbol").orderBy("i")
    apart = F.coalesce(F.col("i") - F.lag("i").over(w) >= gap, F.lit(True))
    islands = rows.select("symbol", "i", apart.alias("apart")).withColumn("island", F.sum(F.col("apart").cast("int")).over(w))
    start = F.array().cast("array<bigint>")
    take = lambda a, i: F.when(F.coalesce(i - F.try_element_at(a, F.lit(-1)) >= gap, F.lit(True)), F.concat(a, F.array(i))).otherwise(a)
    fired = islands.groupBy("symbol", "island").agg(F.sort_array(F.collect_list("i")).alias("at"))
    return fired.select("symbol", F.explode(F.aggregate("at", start, take)).alias("i"))


def signals(ticks: DataFrame) -> DataFrame:
    """A row for each signal: symbol, i, direction, prob, in_direction and result. While one is open no other fires. It
    wins if over HORIZON ticks no opposite move exceeds NOISE of the mean move and the price has gone its way; a signal
    with fewer ticks after it is open: result pend."""
    rows = metrics(ticks)
    fired = unblocked(rows.filter("ready"))
    ahead = chunked(ticks.select("symbol", "i", "price"), 1, HORIZON - 1)
    move = F.col("price") - F.lag("price").over(stream())
    ahead = ahead.withColumn("move", F.coalesce(move, F.lit(0.0)))
    ahead = own(ahead.withColumn("next", F.collect_list(F.struct("price", "move")).over(frame(0, HORIZON - 1)))).select("symbol", "i", "next")
    out = fired.join(rows.select("symbol", "i", F.signum("td").cast("int").alias("direction"), js_round(F.col("p_run") * 100).alias("prob")), ["symbol", "i"]).join(ahead, ["symbol", "i"])
    floor = NOISE * _mean(F.transform("next", lambda x: F.abs(x["move"])))
    against = F.exists("next", lambda x: (F.signum(x["move"]) == -F.col("direction")) & (F.abs(x["move"]) > floor))
    net = F.element_at("next", -1)["price"] - F.get("next", F.lit(0))["price"]
    won = ~against & (F.signum(net) == F.col("direction"))
    result = F.when(F.size("next") < HORIZON, "pend").when(won, "win").otherwise("loss")
    along = F.size(F.filter("next", lambda x: F.signum(x["move"]) == F.col("direction")))
    return out.select("symbol", "i", "direction", "prob", along.alias("in_direction"), result.alias("result"))
