"""Permutation by circular shifts, bootstrap intervals and the confirmation report, for series of any length.

A series is cut into blocks of consecutive pairs, each one row of arrays. A shift pairs a block with the two or three blocks that
it falls on, which give partial sums or counts; a resample gives each pair a weight that a hash of the resample's and the
pair's numbers draws, so a block's part of it needs no other block. Spark adds up what blocks give; no series is one group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scans import running
from tidewright.functions.windows import over
from tidewright.sources.shared import stored

from .statistics import mulberry

#: Pairs of a block: a task holds two blocks' values at a time, a megabyte.
BLOCK = 65_536
#: Resamples that are weighed at a time, as their weights are a matrix with the block's pairs.
SLAB = 64
#: Statistics of a shift this close to what was seen count as equal: their sums are added up in another order.
TIE = 1e-9
_M = 0xFFFFFFFF
#: What a 32-bit number must reach for a Poisson weight of mean 1 to be 1, 2, 3 and so on.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k))) for k in range(1, 12)]


def shifts(n: int, times: int, seed: int) -> np.ndarray:
    """``times`` shifts of a series of ``n`` that stay a twentieth of it away from none, drawn with repetition."""
    low = max(1, int(0.05 * n))
    return low + np.floor(mulberry(seed, times) * (n - 2 * low)).astype("i8")


def _mix(x: np.ndarray) -> np.ndarray:
    """The public 32-bit mixing function lowbias32."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def weights(first: int, count: int, resamples: range, seed: int) -> np.ndarray:
    """A row for each of ``resamples``: the Poisson weights of the pairs numbered from ``first`` on."""
    i = np.arange(first, first + count, dtype="u8")
    pair = _mix((i & np.uint64(_M)).astype("u4") ^ _mix((i >> np.uint64(32)).astype("u4")))
    draw = _mix(np.array([(seed + t * 0x9E3779B9) & _M for t in resamples], "u4"))
    return np.searchsorted(np.array(POISSON, "u8"), _mix(pair[None, :] ^ draw[:, None]), side="right")


def series(rows: DataFrame, keys: list[str], order: str, x: str, y: str, size: int = BLOCK) -> DataFrame:
    """A row for each of ``keys`` and block: its number ``_a``, arrays x and y of its pairs in ``order``, and of the whole series n,
    means, deviations and bounds. Pairs that lack a value (null, or not a number) are left out and leave no gap. It is stored,
    as both sides of the shifts and the resamples read it."""
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = rows.filter(whole(x) & whole(y)).select(*keys, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = running(pairs, keys, ["_o"], {"_k": F.lit(1)}).select(*keys, (F.col("_k") - 1).alias("_k"), "_x", "_y")
    pairs = stored(pairs, "pairs")
    totals = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), *[f(f"_{c}").alias(f"{name}_{c}") for c in "xy" for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    )
    made = pairs.groupBy(*keys, F.floor(F.col("_k") / size).alias("_a")).agg(F.array_sort(F.collect_list(F.struct("_k", "_x", "_y"))).alias("_p"))
    made = made.select(*keys, "_a", F.col("_p._x").alias("x"), F.col("_p._y").alias("y")).join(totals, keys)
    return stored(made, "blocks")


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has: blocks are few and small beside the work on them, so they aren't coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def standard(blocks: DataFrame) -> DataFrame:
    """``blocks`` with values as deviations from the mean in standard deviations; 0 where a series is constant."""
    scaled = lambda c: F.transform(c, lambda v: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((v - F.col(f"mean_{c}")) / F.col(f"sd_{c}")))
    return blocks.withColumns({c: scaled(c) for c in "xy"})


def binned(blocks: DataFrame, bins: int = 8) -> DataFrame:
    """``blocks`` with values as numbers of bins of equal width; 0 where a series is constant."""
    cut = lambda c: F.transform(c, lambda v: F.coalesce(F.least(F.floor(over(v - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1)), F.lit(0)).cast("double"))
    return blocks.withColumns({c: cut(c) for c in "xy"})


def shifted(blocks: DataFrame, keys: list[str], times: int, seed: int, size: int = BLOCK, bins: int | None = None) -> DataFrame:
    """For each of ``keys`` and shift ``_k`` (0 is none, then 1 to ``times``) what x gives with y moved circularly by that much: the sum of
    products ``_v``, or with ``bins`` the number ``_v`` of pairs in each ``_cell`` that isn't empty. A block of x meets the blocks of y
    that some shift moves onto it, at most twice ``times`` and two, whatever the series' length."""

    @F.pandas_udf("array<long>")
    def partners(n: pd.Series, a: pd.Series) -> pd.Series:
        def one(n: int, a: int) -> np.ndarray:
            s = np.append(0, shifts(n, times, seed))
            low, high = a * size, min((a + 1) * size, n)
            out = []
            for d in (s, s - n):
                at, to = np.maximum(low - d, 0), np.minimum(high - d, n)
                out += [at[at < to] // size, (to[at < to] - 1) // size]
            return np.unique(np.concatenate(out))

        return pd.Series([one(*p) for p in zip(n.tolist(), a.tolist())])

    def run(pair: pa.Table) -> pa.Table:
        head = pair.select(keys).slice(0, 1)
        n, a, b = (pair.column(c)[0].as_py() for c in ["n", "_a", "_b"])
        x, y = (pair.column(c).combine_chunks().flatten().to_numpy() for c in "xy")
        ks, cells, values = [], [], []
        for k, s in enumerate([0, *shifts(n, times, seed).tolist()]):
            for d in ((s, s - n) if s else (0,)):
                low, high = max(a * size, b * size + d), min(a * size + len(x), b * size + len(y) + d)
                if low >= high:
                    continue
                u, v = x[low - a * size : high - a * size], y[low - d - b * size : high - d - b * size]
                if bins is None:
                    ks.append([k]), cells.append([0]), values.append([float(u @ v)])
                else:
                    counts = np.bincount((u * bins + v).astype(int), minlength=bins * bins)
                    some = np.flatnonzero(counts)
                    ks.append([k] * len(some)), cells.append(some), values.append(counts[some].astype("f8"))
        flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        out = {"_k": flat(ks, pa.int32()), "_cell": flat(cells, pa.int32()), "_v": flat(values, pa.float64())}
        same = head.take(pa.array(np.zeros(len(out["_k"]), "i8")))
        return pa.table({**{c: same.column(c) for c in keys}, **out})

    left = blocks.select(*keys, "n", "_a", "x", F.explode(partners("n", "_a")).alias("_b"))
    pairs = left.join(blocks.select(*keys, F.col("_a").alias("_b"), "y"), [*keys, "_b"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    parts = _dealt(pairs, [*keys, "_a", "_b"]).groupBy(*keys, "_a", "_b").applyInArrow(run, f"{fields}, _k int, _cell int, _v double")
    return parts.groupBy(*keys, "_k", "_cell").agg(F.sum("_v").alias("_v"))


def _against(stats: DataFrame, keys: list[str], times: int) -> DataFrame:
    """``stats`` (keys, _k, n, _s) as what was seen, the share of shifts that reach it, and their mean and variance."""
    seen = stats.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("_k") == 0, F.col("_s"))).alias("statistic"))
    rows = stats.filter("_k > 0").join(seen.drop("n"), keys)
    far = F.count_if(F.col("_s") >= F.col("statistic") - TIE)
    null = rows.groupBy(*keys).agg(((1 + far) / (1 + times)).alias("p_value"), F.avg("_s").alias("null_mean"), F.var_samp("_s").alias("null_variance"))
    return seen.join(null, keys)


def _correlations(blocks: DataFrame, keys: list[str], times: int, seed: int, size: int) -> DataFrame:
    sizes = blocks.groupBy(*keys).agg(F.max("n").alias("n"))
    # a sum of products is missing only where a block had none, which no shift has
    return shifted(standard(blocks), keys, times, seed, size).join(sizes, keys).select(*keys, "_k", "n", (F.col("_v") / F.col("n")).alias("r"))


def permutation_test(rows: DataFrame, keys: list[str], order: str, x: str, y: str, times: int = 1000, seed: int = 42, bins: int = 8, size: int = BLOCK) -> DataFrame:
    """Mutual information in bits of two series for each of ``keys``, in bins of equal width, and its one-sided p-value under
    circular shifts. Series of fewer than three pairs give no row."""
    blocks = series(rows, keys, order, x, y, size).filter("n >= 3")
    cells = stored(shifted(binned(blocks, bins), keys, times, seed, size, bins), "cells")
    n = blocks.groupBy(*keys).agg(F.max("n").alias("n"))
    # a shift moves pairs, not values: the margins are those of the unshifted table
    unmoved = cells.filter("_k = 0")
    row = unmoved.groupBy(*keys, F.floor(F.col("_cell") / bins).alias("_x")).agg(F.sum("_v").alias("_row"))
    column = unmoved.groupBy(*keys, (F.col("_cell") % bins).alias("_y")).agg(F.sum("_v").alias("_column"))
    joint = cells.withColumns({"_x": F.floor(F.col("_cell") / bins), "_y": F.col("_cell") % bins}).join(row, [*keys, "_x"]).join(column, [*keys, "_y"]).join(n, keys)
    part = F.col("_v") / F.col("n") * F.log2(F.col("_v") * F.col("n") / (F.col("_row") * F.col("_column")))
    stats = joint.groupBy(*keys, "_k").agg(F.max("n").alias("n"), F.greatest(F.sum(part), F.lit(0.0)).alias("_s"))
    return _against(stats, keys, times).select(*keys, "n", "statistic", "p_value")


def shift_test(rows: DataFrame, keys: list[str], order: str, x: str, y: str, times: int = 1000, seed: int = 42, size: int = BLOCK) -> DataFrame:
    """As ``permutation_test`` for the size of Pearson's r, with mean and variance of what the shifts give."""
    blocks = series(rows, keys, order, x, y, size).filter("n >= 3")
    return _shift_test(blocks, keys, times, seed, size)


def _shift_test(blocks: DataFrame, keys: list[str], times: int, seed: int, size: int) -> DataFrame:
    stats = stored(_correlations(blocks, keys, times, seed, size), "shifts").withColumn("_s", F.abs("r"))
    effect = stats.filter("_k = 0").select(*keys, F.col("r").alias("effect"))
    return _against(stats, keys, times).join(effect, keys).select(*keys, "n", "statistic", "effect", "p_value", "null_mean", "null_variance")


def resampled(blocks: DataFrame, keys: list[str], times: int, seed: int, size: int = BLOCK) -> DataFrame:
    """Pearson's ``r`` of each of ``keys`` and resample ``_t``, whose pairs have Poisson weights of mean 1; 0 where it is constant."""
    names = ["w", "wx", "wy", "wxx", "wyy", "wxy"]

    def run(block: pa.Table) -> pa.Table:
        x, y = (block.column(c).combine_chunks().flatten().to_numpy() for c in "xy")
        terms = np.stack([np.ones(len(x)), x, y, x * x, y * y, x * y], axis=1)
        first = block.column("_a")[0].as_py() * size
        slabs = [weights(first, len(x), range(t, min(t + SLAB, times)), seed) @ terms for t in range(0, times, SLAB)]
        sums = np.concatenate(slabs)
        same = block.select(keys).take(pa.array(np.zeros(times, "i8")))
        return pa.table({**{c: same.column(c) for c in keys}, "_t": pa.array(np.arange(times, dtype="i4")), **{c: pa.array(sums[:, j]) for j, c in enumerate(names)}})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    parts = _dealt(standard(blocks).select(*keys, "_a", "x", "y"), [*keys, "_a"]).groupBy(*keys, "_a").applyInArrow(run, f"{fields}, _t int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy(*keys, "_t").agg(*[F.sum(c).alias(c) for c in names])
    mean = {c: F.col(c) / F.nullif(F.col("w"), F.lit(0.0)) for c in names[1:]}
    spread = lambda c: F.greatest(mean[f"w{c}{c}"] - mean[f"w{c}"] * mean[f"w{c}"], F.lit(0.0))
    both = spread("x") * spread("y")
    r = F.when(both > 1e-24, (mean["wxy"] - mean["wx"] * mean["wy"]) / F.sqrt(both)).otherwise(0.0)
    return sums.select(*keys, "_t", F.coalesce(r, F.lit(0.0)).alias("r"))


def _interval(draws: DataFrame, keys: list[str], times: int, level: float) -> DataFrame:
    """Percentile interval, standard error and skewness of ``draws``; a key has ``times`` of them."""
    tail = (1 - level) / 2
    at: Column = F.sort_array(F.collect_list("r"))
    place = lambda q: F.element_at(at, max(1, math.ceil(round(q * times, 6))))
    skew = F.coalesce(F.nanvl(F.skewness("r"), F.lit(0.0)), F.lit(0.0)) * ((times - 1) / times) ** 1.5
    return draws.groupBy(*keys).agg(place(tail).alias("low"), place(1 - tail).alias("high"), F.stddev_samp("r").alias("error"), skew.alias("skewness"))


def bootstrap(rows: DataFrame, keys: list[str], order: str, x: str, y: str, times: int = 2000, seed: int = 43, level: float = 0.95, size: int = BLOCK) -> DataFrame:
    """Pearson's r for each of ``keys`` with a percentile interval and standard error of Poisson resamples of its pairs. Series of
    fewer than two pairs give no row."""
    blocks = series(rows, keys, order, x, y, size).filter("n >= 2")
    return _seen(blocks, keys).join(_interval(resampled(blocks, keys, times, seed, size), keys, times, level), keys).select(*keys, "n", "r", "low", "high", "error")


def _seen(blocks: DataFrame, keys: list[str]) -> DataFrame:
    products = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return standard(blocks).groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(products) / F.max("n")).alias("r"))


def confirmation(rows: DataFrame, keys: list[str], order: str, x: str, y: str, times: int = 1000, resamples: int = 2000, seed: int = 42, least: int = 60, size: int = BLOCK) -> DataFrame:
    """The report on one candidate's series for each of ``keys``: |r| under circular shifts, r with its interval from resamples, and
    what makes either unsure. Fewer than ``least`` pairs give no row."""
    blocks = series(rows, keys, order, x, y, size).filter(F.col("n") >= least)
    spread = _interval(resampled(blocks, keys, resamples, seed + 1, size), keys, resamples, 0.95)
    out = _shift_test(blocks, keys, times, seed, size).join(spread.withColumnsRenamed({"low": "ci_lower", "high": "ci_upper"}), keys)
    p = F.col("p_value")
    unsure = F.concat_ws(",", F.when(F.abs("skewness") > 1, "skewed"), F.when(F.col("ci_upper") - F.col("ci_lower") > 1.5, "wide"), F.when(p <= 1 / (times + 1) + 1e-12, "least p"))
    return out.select(
        *keys, "n", "statistic", "effect", "error", "ci_lower", "ci_upper", "p_value", "null_mean", "null_variance",
        F.sqrt(p * (1 - p) / times).alias("monte_carlo_error"), "skewness", F.nullif(unsure, F.lit("")).alias("warnings"),
    )
