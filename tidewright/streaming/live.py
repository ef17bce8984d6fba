"""Live candles and aggression as streams with state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import bursts
from tidewright.sources.versions import Versions

#: Rows that a stream's function works on at once.
SLICE = 50_000

CANDLE = "symbol string, granularity long, epoch long, open double, high double, low double, close double, seq long"

_NUMBERS = {"epoch": "i8", "open": "f8", "high": "f8", "low": "f8", "close": "f8", "seq": "i8"}


def live_candles(messages: DataFrame) -> DataFrame:
    """Those of ``messages`` (CANDLE, ``seq`` their order of arrival) that count: a message updates its series' newest candle or
    begins a newer one; one of an older candle came too late. A series' state is the time of its newest candle."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # numbers only, without a copy in order: the key's names are the same in all rows
        parts: dict[str, list] = {c: [] for c in _NUMBERS}
        for b in batches:
            for c, kind in _NUMBERS.items():
                parts[c].append(b[c].to_numpy(kind))
        rows = {c: np.concatenate(parts.pop(c)) for c in _NUMBERS}
        order = np.argsort(rows["seq"], kind="stable")
        newest = np.maximum.accumulate(np.append(state.get[0] if state.exists else np.iinfo("i8").min, rows["epoch"][order]))
        state.update((int(newest[-1]),))
        order = order[rows["epoch"][order] >= newest[:-1]]
        for k in range(0, max(len(order), 1), SLICE):
            part = {c: x[order[k : k + SLICE]] for c, x in rows.items()}
            yield pd.DataFrame({"symbol": [key[0]] * len(part["seq"]), "granularity": np.full(len(part["seq"]), key[1], "i8"), **part})

    return messages.groupBy("symbol", "granularity").applyInPandasWithState(advance, CANDLE, "newest long", "append", "NoTimeout")


def newest_candles(counted: DataFrame) -> DataFrame:
    """Each candle as its last message left it."""
    return counted.groupBy("symbol", "granularity", "epoch").agg(F.max_by(F.struct("open", "high", "low", "close"), "seq").alias("_c"), F.max("seq").alias("seq")).select("symbol", "granularity", "epoch", "_c.*", "seq")


def upserted(stream: DataFrame, store: Versions, progress: str):
    """Start writing the candles of ``stream`` (of ``live_candles``) into ``store``, whose keys are symbol, granularity and epoch. A batch
    that is run again changes nothing, as only messages newer than what is stored count."""

    def write(batch: DataFrame, _: int) -> None:
        def make(now: DataFrame) -> DataFrame:
            have = now.select("symbol", "granularity", "epoch", F.col("seq").alias("_have"))
            return newest_candles(batch).join(have, ["symbol", "granularity", "epoch"], "left").filter(F.col("_have").isNull() | (F.col("seq") > F.col("_have")))

        store.change(make)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", progress)


AGGRESSION = "symbol string, start long, up_ticks long, down_ticks long, ticks long, up_mag double, down_mag double, score long, intensity double, verdict string"
_STATE = "start long, up_ticks long, down_ticks long, ticks long, up_mag double, down_mag double, price double, recent string"


def judged(up_ticks: int, down_ticks: int, up_mag: float, down_mag: float, recent: list[float]) -> tuple[int, float, str]:
    """Score, intensity and verdict of a candle, against the moves of the candles before it."""
    ticks, total = up_ticks + down_ticks, up_mag + down_mag
    if not ticks:
        return 0, 0.0, "NEUTRAL"
    score = math.floor((0.4 * (up_ticks - down_ticks) / ticks + 0.6 * ((up_mag - down_mag) / total if total else 0.0)) * 100 + 0.5)
    usual = sum(recent) / len(recent) if recent else total
    intensity = total / usual if usual > 0 else 1.0
    side, size = ("BUY", "UP") if score > 0 else ("SELL", "DOWN"), abs(score)
    if size >= 60 and intensity >= 1.3:
        return score, intensity, f"STRONG {side[0]} AGGRESSION"
    verdict = f"MODERATE {side[0]} PRESSURE" if size >= 35 else f"MILD {side[0]} BIAS" if size >= 15 else "NEUTRAL"
    return score, intensity, verdict


def aggression(stream: DataFrame, seconds: int = 60, recent: int = 10) -> DataFrame:
    """Buy and sell aggression of each bucket of ``stream`` (symbol, ts, event_id, price) once a later one begins. A symbol's state is
    its open bucket, its last price and the moves of the last ``recent`` buckets. Ticks of one batch are put in order of
    time; one that comes later than that counts to the open bucket."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        start, *sums, last, before = state.get if state.exists else (None, 0, 0, 0, 0.0, 0.0, None, "[]")
        before = json.loads(before)
        price = rows["price"].to_numpy("f8")
        move = np.diff(price, prepend=price[0] if last is None else last)
        bucket = rows["bucket"].to_numpy("i8")
        bucket = np.maximum.accumulate(bucket if start is None else np.maximum(bucket, start))
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            at, d = int(bucket[a]), move[a:b]
            if start is not None and at > start:
                out.append((key[0], start, *sums, *judged(sums[0], sums[1], sums[3], sums[4], before)))
                before = [*before, sums[3] + sums[4]][-recent:]
                sums = [0, 0, 0, 0.0, 0.0]
            start = at
            more = [int((d > 0).sum()), int((d < 0).sum()), b - a, float(d[d > 0].sum()), float(-d[d < 0].sum())]
            sums = [x + y for x, y in zip(sums, more, strict=True)]
        state.update((start, *sums, float(price[-1]), json.dumps(before)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in AGGRESSION.split(", ")])

    rows = stream.withColumn("bucket", F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return rows.groupBy("symbol").applyInPandasWithState(advance, AGGRESSION, _STATE, "append", "NoTimeout")


SIGNAL = "symbol string, i long, direction int, prob long, in_direction int, result string"
_SIGNAL_STATE = "prices binary, directions binary, seen long, carry int, open long, side int, prob long"


def signals(stream: DataFrame) -> DataFrame:
    """Burst signals of ``stream`` (symbol, ts, event_id, price), each once its horizon is over; see ``bursts.signals``, which gives the
    same rows and those still open. A symbol's state is its last HALO prices with their directions, how many ticks there were,
    the direction that flat ticks take and the open signal, during which no other fires. Ticks of one batch are put in order
    of time, later ones are taken as they come."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # of a batch no more is kept than time, number and price; its metrics are made slice by slice, as if slices were batches
        parts = [(b["ts"].to_numpy("M8[ns]"), b["event_id"].to_numpy("i8"), b["price"].to_numpy("f8")) for b in batches]
        ts, number, price = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((number, ts))
        del ts, number
        kept = state.get if state.exists else (b"", b"", 0, 0, -1, 0, 0)
        for k in range(0, len(order), SLICE):
            kept, out = settled(key[0], price[order[k : k + SLICE]], kept)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SIGNAL.split(", ")])
        state.update(kept)

    def settled(symbol: str, new: np.ndarray, kept: tuple) -> tuple[tuple, list]:
        prices, directions, seen, carry, fired, side, prob = kept
        old = np.frombuffer(prices, "f8")
        p = np.concatenate([old, new])
        move = np.nan_to_num(np.diff(p, prepend=p[:1]))
        raw = np.sign(move[len(old) :]).astype("i8")
        place = np.maximum.accumulate(np.where(raw != 0, np.arange(1, len(raw) + 1), 0))
        d = np.concatenate([np.frombuffer(directions, "i1").astype("i8"), np.append(carry, raw)[place]])
        first = seen - len(old)
        at = np.arange(first, first + len(p))
        # sizes of the moves before what is kept count nowhere, as no window reaches that far
        made = bursts.measured(at, p, d, np.abs(move))
        out, total, last = [], seen + len(raw), bursts.HORIZON - 1

        def settle() -> None:
            here = slice(fired - first, fired - first + bursts.HORIZON)
            size, way = np.abs(move[here]), np.sign(move[here])
            broken = ((way == -side) & (size > bursts.NOISE * size.mean())).any()
            won = not broken and np.sign(p[here][-1] - p[here][0]) == side
            out.append((symbol, fired, side, prob, int((way == side).sum()), "win" if won else "loss"))

        for k in (np.flatnonzero(made["ready"][len(old) :]) + seen).tolist():
            if fired >= 0 and k - fired < last:
                continue
            if fired >= 0:
                settle()
            fired, side, prob = k, int(np.sign(made["td"][k - first])), math.floor(made["p_run"][k - first] * 100 + 0.5)
        if fired >= 0 and fired + last < total:
            settle()
            fired = -1
        keep = slice(max(0, len(p) - bursts.HALO), None)
        return (p[keep].tobytes(), d[keep].astype("i1").tobytes(), total, int(d[-1]), fired, side, prob), out

    return stream.groupBy("symbol").applyInPandasWithState(advance, SIGNAL, _SIGNAL_STATE, "append", "NoTimeout")
