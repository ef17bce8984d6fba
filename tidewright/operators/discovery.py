"""Candidates and how a search goes on among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.indicators import RECURSIVE, WINDOWED
from tidewright.functions.signals import PROXIES, STATES
from tidewright.functions.scans import numbered
from tidewright.functions.windows import over


#: The registries' names in their order. What looks ahead is no candidate.
INDICATORS = (*WINDOWED, *RECURSIVE, "run_length")
STATE_NAMES = tuple(n for n in STATES if "ahead" not in n)
PROXY_NAMES = (*PROXIES, "up_cluster", "down_cluster")
EVENT_NAMES = ("time_gap", "tick_gap", "alternating")
CONTEXT_NAMES = ("candle_position", "candle_timing", "prior_candle", "market_session", "volatility_state", "trend_state", "compression_state", "expansion_state", "range_state", "momentum_state")


def candidates(spark: SparkSession, periods: tuple[int, ...] = (10, 14, 20, 30)) -> DataFrame:
    """Specifications from the registries: indicators at each period, states, proxies, features of events, composites of
    neighbours of one kind in the registry's order, and states and proxies each under one context, these taken round and
    round. Each has a fingerprint; duplicates go."""
    rows = [("indicator", n, p, [n], None) for n in INDICATORS for p in periods]
    plain = [("state", n, 20) for n in STATE_NAMES] + [("proxy", n, 10) for n in PROXY_NAMES]
    rows += [(*r, [r[1]], None) for r in plain] + [("event", n, None, [n], None) for n in EVENT_NAMES]
    rows += [("composite", f"{a[1]}+{b[1]}", a[2], [a[1], b[1]], None) for a, b in zip(plain, plain[1:]) if a[0] == b[0]]
    rows += [("conditional", f"{n}|{c}", p, [n], c) for k, (_, n, p) in enumerate(plain) for c in [CONTEXT_NAMES[k % len(CONTEXT_NAMES)]]]
    made = spark.createDataFrame(rows, "type string, name string, period int, parts array<string>, context string")
    return made.withColumn("fingerprint", F.sha2(F.to_json(F.struct("name", "parts", "period", "type")), 256)).dropDuplicates(["fingerprint"])


def combined(kind: str, parts: list[Column], weights: list[float] | None = None) -> Column:
    """A composite of components: all or any of them other than 0, or their weighted sum; null if one is."""
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    if kind == "weighted":
        value = sum((p * w for p, w in zip(parts, weights or [1.0] * len(parts), strict=True)), F.lit(0.0))
    else:
        hits = sum(((p != 0).cast("int") for p in parts), F.lit(0))
        value = (hits == len(parts) if kind == "conjunction" else hits > 0).cast("double")
    return F.when(~missing, value)


def conditional(base: Column, mask: Column) -> Column:
    return F.when(mask, base)


def thompson(arms: DataFrame, arm: str, successes: str, failures: str, seed: int = 42) -> DataFrame:
    """A draw for each arm from the Beta distribution of its record, seeded by the arm, and their ranks."""

    def draw(batches):
        import xxhash

        for b in batches:
            rng = [np.random.default_rng([seed, xxhash.xxh32_intdigest(str(a))]) for a in b[arm]]
            b["draw"] = [float(r.beta(s + 1, f + 1)) for r, s, f in zip(rng, b[successes], b[failures], strict=True)]
            yield b

    fields = ", ".join(f"`{n}` {t}" for n, t in arms.dtypes) + ", draw double"
    return numbered(arms.mapInPandas(draw, fields), [F.desc("draw"), arm])


def surrogate(seen: DataFrame, grid: DataFrame, x: str, y: str) -> DataFrame:
    """At each point of ``grid`` the mean and variance of what was ``seen``, with Gaussian weights of a width of its spread
    over the root of its number, and the bound of mean and 1.96 deviations. ``grid`` is the small side and is sent to the
    seen rows; sums are made on the map side."""
    all_ = seen.agg(F.stddev_pop(x).alias("_s"), F.count("*").alias("_n")).select((F.col("_s") / F.sqrt("_n")).alias("h"))
    rows = seen.join(F.broadcast(all_)).join(F.broadcast(grid.select(F.col(x).alias("at"))))
    weight = F.exp(-0.5 * F.pow(over(F.col(x) - F.col("at"), F.col("h")), F.lit(2.0)))
    sums = rows.groupBy("at").agg(F.sum(weight).alias("w"), F.sum(weight * F.col(y)).alias("wy"), F.sum(weight * F.col(y) * F.col(y)).alias("wyy"))
    out = sums.withColumn("mean", over(F.col("wy"), F.col("w"))).withColumn("variance", F.greatest(over(F.col("wyy"), F.col("w")) - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return out.select("at", "mean", "variance", (F.col("mean") + 1.96 * F.sqrt("variance")).alias("upper"))


def novel(rows: DataFrame, features: list[str], known: DataFrame, k: int = 5, far: float = 1.0, seed: int = 42) -> DataFrame:
    """Cluster centres of standardized ``features`` that lie ``far`` or more from every known centre; clusters by MLlib's
    k-means, which passes only centres between driver and tasks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    clean = rows.dropna(subset=features)
    stats = clean.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = clean.join(F.broadcast(stats)).select(*[F.coalesce(over(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in features])
    model = KMeans(k=k, maxIter=50, seed=seed).fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    centres = rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "known", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    near = centres.join(F.broadcast(known.select(F.col("centre").alias("known")))).groupBy("cluster", "centre").agg(F.min(gap).alias("distance"))
    return near.withColumn("is_novel", F.col("distance") >= far)


def prioritized(rounds: DataFrame) -> DataFrame:
    """Families by what they yielded: those without a rate of elimination first, then the lower ones."""
    each = rounds.groupBy("family").agg(F.sum("evaluated").alias("pulls"), F.sum("promoted").alias("reward"), (1 - over(F.sum("promoted").cast("double"), F.sum("evaluated").cast("double"))).alias("elimination_rate"))
    return numbered(each, [F.asc_nulls_first("elimination_rate"), "family"])


def trials(spark: SparkSession, n: int, effect: float = 0.0, size: int = 60, seed: int = 42, alpha: float = 0.05, shuffles: int = 99) -> DataFrame:
    """Simulated studies of two series with correlation ``effect``: each trial's r, permutation p-value and whether it was
    found; trials are spread over tasks, each with a seed of its own."""

    def run(batches):
        for b in batches:
            out = []
            for t in b["id"].tolist():
                rng = np.random.default_rng(seed + 7919 * t)
                x = rng.standard_normal(size)
                y = effect * x + np.sqrt(1 - effect**2) * rng.standard_normal(size)
                r = abs(np.corrcoef(x, y)[0, 1])
                far = sum(abs(np.corrcoef(x, np.roll(y, s))[0, 1]) >= r for s in rng.integers(3, size - 3, shuffles).tolist())
                out.append((t, float(r), (1 + far) / (1 + shuffles)))
            yield pd.DataFrame(out, columns=["trial", "r", "p_value"])

    return spark.range(n).mapInPandas(run, "trial long, r double, p_value double").withColumn("detected", F.col("p_value") <= alpha)


#: The kinds of data without an effect.
NULLS = ("label_permutation", "shuffled_outcomes", "iid_random_walk", "independent")


def null_data(kind: str, size: int, rng: np.random.Generator, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature and a 0/1 outcome of a kind without an effect; ``x`` and ``y`` are what the first two start from."""
    if kind == "label_permutation":
        return x, rng.permutation(y)
    if kind == "shuffled_outcomes":
        return x, (rng.random(size) < y.mean()).astype("f8")
    if kind == "iid_random_walk":
        p = 100 + np.cumsum(np.where(rng.random(size + 20) < 0.5, 1.0, -1.0))
        at = np.arange(14, size + 14)
        return p[at] - p[at - 14], (p[at + 5] > p[at]).astype("f8")
    return rng.random(size) * 100 - 50, (rng.random(size) < 0.5).astype("f8")


def null_trials(spark: SparkSession, n: int, size: int = 120, seed: int = 42, shuffles: int = 99) -> DataFrame:
    """``n`` trials of each of NULLS: |r|, its p-value under circular shifts. Trials are spread over tasks, each with a seed
    of its own; a false discovery is one with a small p-value."""
    def run(batches):
        for b in batches:
            out = []
            for t in b["id"].tolist():
                rng = np.random.default_rng([seed, t])
                base = rng.standard_normal(size)
                x, y = null_data(NULLS[t % len(NULLS)], size, rng, base, (base + rng.standard_normal(size) > 0).astype("f8"))
                r = lambda a, b: abs(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else 0.0
                seen = r(x, y)
                far = sum(r(x, np.roll(y, s)) >= seen for s in rng.integers(size // 20, size - size // 20, shuffles).tolist())
                out.append((t, NULLS[t % len(NULLS)], float(seen), (1 + far) / (1 + shuffles)))
            yield pd.DataFrame(out, columns=["trial", "kind", "r", "p_value"])

    return spark.range(n * len(NULLS)).mapInPandas(run, "trial long, kind string, r double, p_value double")


def histogram(rows: DataFrame, p: str, bins: int = 10) -> DataFrame:
    """Counts of p-values in equal bins on [0, 1]."""
    return rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
