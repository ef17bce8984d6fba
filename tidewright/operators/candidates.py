"""Candidates joined to data: each specification of the registry as a series over ticks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewright.functions import indicators as ind
from tidewright.functions import signals as sg
from tidewright.functions.windows import over, own, rounded_array, with_shared

from .discovery import combined, conditional

#: What each context must say where a conditional candidate names no category of its own.
REQUIRED = {
    "candle_position": "UPPER", "candle_timing": "EARLY", "prior_candle": "BULLISH", "market_session": "US", "volatility_state": "HIGH", "trend_state": "ACTIVE",
    "compression_state": "ACTIVE", "expansion_state": "ACTIVE", "range_state": "ACTIVE", "momentum_state": "POSITIVE",
}

#: States that the contexts of the same row are made from.
_BEHIND = ("high_volatility", "low_volatility", "trend", "compression", "expansion", "ranging")

class Unresolvable(ValueError):
    """A candidate names no series that ticks have."""


def column(name: str, period: int | None, kind: str) -> str:
    """The column of a candidate's part; indicators have one for each period."""
    return f"{name}_{period}" if kind == "indicator" else name


def smoothed(ticks: DataFrame, wanted: list[tuple[str, int]], size: int | None = None) -> DataFrame:
    """(symbol, i) with a column for each recursively smoothed indicator and period of ``wanted``, all in one pass over chunks."""
    periods = sorted({p for _, p in wanted})
    rows = ind.recursive_chunks(ticks, periods[-1], size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        price, first, mine = part["price"].to_numpy("f8"), bool(part["i"].iat[0] == 0), part["own"].to_numpy(bool)
        out = {"symbol": part["symbol"].to_numpy()[mine], "i": part["i"].to_numpy()[mine]}
        made = {p: ind.smooth(price, first, p) for p in periods}
        for name, p in wanted:
            values = made[p][name][mine]
            out[column(name, p, "indicator")] = pd.arrays.FloatingArray(values, np.isnan(values))
        return pd.DataFrame(out)

    fields = "symbol string, i long, " + ", ".join(f"{column(n, p, 'indicator')} double" for n, p in wanted)
    return rows.groupBy("symbol", "chunk").applyInPandas(run, fields)


def observed(ticks: DataFrame, candidates: list[Row], size: int | None = None) -> DataFrame:
    """``ticks`` (symbol, i, ts, price) with the columns that ``candidates`` are made of, and no others: windows of all kinds
    in one pass over chunks, then what is recursive, runs without bound or of whole candles, joined by symbol and place."""
    parts = {(c["type"], n, c["period"]) for c in candidates if c["type"] == "indicator" for n in c["parts"]}
    plain = {n for c in candidates if c["type"] != "indicator" for n in c["parts"]}
    contexts = {c["context"] for c in candidates if c["context"]}
    unknown = sorted(({n for _, n, _ in parts} - {*ind.ROLLING, *ind.RECURSIVE, "run_length"}) | (plain - {*sg.STATES, *sg.PROXIES, "up_cluster", "down_cluster"}) | (contexts - set(REQUIRED)))
    if unknown:
        raise Unresolvable(f"no series over ticks for {unknown}")
    windows = {n: sg.STATES[n] for n in sg.STATES if n in plain or (contexts and n in _BEHIND)}
    windows |= {n: sg.PROXIES[n] for n in sg.PROXIES if n in plain}
    if contexts:
        windows["momentum"] = lambda: ind.momentum(10)
    halo = max([sg.HALO, *(2 * p + 4 for _, n, p in parts if n in ind.ROLLING)])
    rows = with_shared(sg.prepare(ticks, size=size, halo=halo), windows)
    rolling = {column(n, p, "indicator"): (n, p) for _, n, p in sorted(parts) if n in ind.ROLLING}
    rows = own(ind.with_rolling(rows, rolling) if rolling else rows)
    if contexts:
        rows = rows.withColumns({n: c for n, c in sg.contexts().items() if n in contexts})
    if "prior_candle" in contexts:
        rows = rows.join(sg.prior_candle(ticks).select("symbol", "i", F.col("prior_direction").alias("prior_candle")), ["symbol", "i"])
    recursive = sorted((n, p) for _, n, p in parts if n in ind.RECURSIVE)
    if recursive:
        rows = rows.join(smoothed(ticks, recursive, size), ["symbol", "i"])
    lengths = sorted(p for _, n, p in parts if n == "run_length")
    if lengths or plain & {"up_cluster", "down_cluster"}:
        run = ind.run_lengths(ticks, size)
        made = {column("run_length", p, "indicator"): F.col("run_length").cast("double") for p in lengths}
        made |= {n: F.when(F.col("sign") == s, F.col("run_length")).otherwise(0) for n, s in (("up_cluster", 1), ("down_cluster", -1)) if n in plain}
        rows = rows.join(run.select("symbol", "i", *[c.alias(n) for n, c in made.items()]), ["symbol", "i"])
    return rows


def value(candidate: Row) -> Column:
    """A candidate's series over what it is made of: the part itself; all (or any, or the weighted sum) of its parts, null
    where one is; its part where the context says what it must."""
    parts = [F.col(column(n, candidate["period"], candidate["type"])).cast("double") for n in candidate["parts"]]
    if candidate["type"] == "composite":
        return combined("conjunction", parts)
    if candidate["type"] == "conditional":
        return conditional(parts[0], F.coalesce(F.col(candidate["context"]) == REQUIRED[candidate["context"]], F.lit(False)))
    return parts[0]


def label(candidate: Row) -> str:
    return column(candidate["name"], candidate["period"], candidate["type"])


def wide(ticks: DataFrame, candidates: list[Row], size: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, i) with the columns of ``ticks`` to ``keep`` and one for each of ``candidates``, its series over ``ticks``, null where it
    isn't known yet. The specifications are few, and Catalyst computes what they share once."""
    return observed(ticks, candidates, size).select("symbol", "i", *keep, *[value(c).alias(label(c)) for c in candidates])


def series(ticks: DataFrame, candidates: list[Row], size: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, i, candidate, value): the columns of ``wide`` as rows, of which there are as many as ticks times candidates."""
    return wide(ticks, candidates, size, keep).unpivot(["symbol", "i", *keep], [label(c) for c in candidates], "candidate", "value")


def summary(rows: DataFrame, names: list[str], places: int) -> DataFrame:
    """(symbol, candidate, known, mean, active) of the columns ``names`` of ``rows`` (symbol), rounded to ``places``: where each is known, its
    mean and where it isn't 0. Batches are added up column by column, so no value becomes a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols = b.column("symbol").dictionary_encode(null_encoding="encode")
            at, n = symbols.indices.to_numpy(), len(symbols.dictionary)
            made = []
            for name in names:
                column = b.column(name)
                known, x = column.is_valid().to_numpy(zero_copy_only=False), rounded_array(column.fill_null(0.0).to_numpy(), places)
                # an unknown value counts as 0 here, which adds nothing and isn't active
                made.append((np.bincount(at[known], minlength=n), np.bincount(at, x, n), np.bincount(at[x != 0], minlength=n)))
            known, total, active = (np.concatenate(c) for c in zip(*made, strict=True))
            symbol = symbols.dictionary.take(pa.array(np.tile(np.arange(n), len(names))))
            yield pa.RecordBatch.from_arrays([symbol, pa.array(np.repeat(names, n)), pa.array(known), pa.array(total), pa.array(active)], ["symbol", "candidate", "known", "total", "active"])

    parts = rows.select("symbol", *[F.col(f"`{n}`") for n in names]).mapInArrow(run, "symbol string, candidate string, known long, total double, active long")
    out = parts.groupBy("symbol", "candidate").agg(*[F.sum(c).alias(c) for c in ("known", "total", "active")])
    return out.select("symbol", "candidate", "known", over(F.col("total"), F.col("known")).alias("mean"), "active")
