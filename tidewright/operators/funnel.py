"""The adaptive campaign: candidates over labelled features pass four rounds, of which only the third spends wealth.

All that a candidate's tests need is its table of counts, bins by label, of bounded size however many rows there are. A shuffle
of labels leaves both margins as they are, so what it makes of the table is one draw from the tables with these margins:
each shuffle is drawn as a table, without moving a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scans import running
from tidewright.functions.windows import over
from tidewright.sources.shared import stored

from .campaign import best, rounds
from .statistics import unpivoted

#: The features of a campaign, and its budgets.
FEATURES = (
    "ncf_net_displacement", "ncf_abs_path_length", "ncf_path_efficiency", "ncf_mfe", "ncf_mae", "ncf_up_tick_count", "ncf_down_tick_count", "ncf_dir_imbalance",
    "ncf_current_run_len", "ncf_max_run_len", "ncf_reversal_count", "ncf_std_first_diff", "ncf_mean_second_diff", "ncf_dir_entropy", "ncf_run_entropy", "ncf_perm_entropy3",
)
SHARES = (0.25, 0.5, 0.75)
BINS, KEEP, ALPHA, SHUFFLES, DEEP_SHUFFLES, LEAST_ROWS, LEAST_VALUES, MOST_MISSING = 10, 0.20, 0.10, 100, 1000, 30, 10, 0.1

#: Arguments beyond which numpy doesn't draw from the hypergeometric distribution; the normal one is as good there.
_EXACT = 10**9


class InsufficientData(ValueError):
    """A campaign has fewer labelled rows than it needs."""


def thresholds(values: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(feature, n, lo, hi, share, threshold): the values at exact places of ``values`` (feature, value) in order, by running
    counts of distinct values, so no feature is sorted in one task."""
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("_c"))
    each = counts.groupBy("feature").agg(F.sum("_c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = each.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumn("_at", F.greatest(F.lit(0), F.floor(F.col("share") * F.col("n")) - 1))
    upto = running(counts, ["feature"], ["value"], {"_upto": F.col("_c")})
    found = upto.join(F.broadcast(wanted), "feature").filter(F.col("_upto") > F.col("_at"))
    return found.groupBy("feature", "n", "lo", "hi", "share").agg(F.min("value").alias("threshold"))


def generated(values: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(candidate, feature, n, lo, hi, kind, direction, threshold): for each feature with enough values the raw one, and its values
    at or above and below the threshold of each share."""
    cuts = thresholds(values, shares).filter(F.col("n") >= LEAST_VALUES)
    pct = F.round(F.col("share") * 100).cast("int").cast("string")
    sides = [F.struct(F.concat(F.lit("p"), pct, F.lit(f"_{d}")).alias("suffix"), F.lit("threshold").alias("kind"), F.lit(d).alias("direction"), F.col("threshold")) for d in ("above", "below")]
    raw = F.struct(F.lit("raw").alias("suffix"), F.lit("raw").alias("kind"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("threshold"))
    # the raw candidate comes along with the first share
    forms = F.when(F.col("share") == min(shares), F.array(raw, *sides)).otherwise(F.array(*sides))
    return cuts.withColumn("_f", F.explode(forms)).select(F.concat_ws("__", "feature", "_f.suffix").alias("candidate"), "feature", "n", "lo", "hi", "_f.kind", "_f.direction", "_f.threshold")


def tables(values: DataFrame, candidates: DataFrame, bins: int = BINS) -> DataFrame:
    """For each of ``candidates`` its counts over ``values`` (feature, value, label 0 or 1): sizes and hits of each bin, n and
    mutual information in bits. Raw values fall into ``bins`` of equal width, what has no place among them (an infinite value of an
    infinite range, NaN) into the last. Candidates are a few for each feature, so they
    are sent to the values, and counts are combined before they are shuffled."""
    v, span = F.col("value"), F.col("hi") - F.col("lo")
    place = over(v - F.col("lo"), span) * bins
    raw = F.when(F.isnan(place), bins - 1).otherwise(F.coalesce(F.least(F.floor(place), F.lit(bins - 1)), F.lit(0)))
    side = F.when(F.col("direction") == "above", v >= F.col("threshold")).otherwise(v < F.col("threshold")).cast("int")
    rows = values.join(F.broadcast(candidates.select("candidate", "feature", "lo", "hi", "kind", "direction", "threshold")), "feature")
    counts = rows.groupBy("candidate", F.when(F.col("kind") == "raw", raw).otherwise(side).cast("int").alias("bin")).agg(F.count("*").alias("size"), F.sum("label").cast("long").alias("hits"))
    made = counts.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("bin", "size", "hits"))).alias("b"), F.sum("size").alias("rows"), F.sum("hits").alias("positives"))
    return made.select("candidate", "rows", "positives", F.col("b.size").alias("sizes"), F.col("b.hits").alias("hits")).withColumn("score", information("sizes", "hits", "rows", "positives"))


def information(sizes: str, hits: str, n: str, positives: str) -> Column:
    """Mutual information in bits of a table's bins and labels."""
    def part(c: Column, row: Column, column: Column) -> Column:
        return F.when(c > 0, c / F.col(n) * F.log2(c * F.col(n) / (row * column))).otherwise(0.0)

    each = F.zip_with(sizes, hits, lambda s, h: part(h, s, F.col(positives)) + part(s - h, s, F.col(n) - F.col(positives)))
    return F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def drawn(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many of ``sample`` draws without replacement are good."""
    if max(good.max(initial=0), bad.max(initial=0), sample.max(initial=0)) < _EXACT:
        return rng.hypergeometric(good, bad, sample)
    total = np.maximum(good + bad, 1).astype("f8")
    mean = sample * (good / total)
    spread = np.sqrt(np.maximum(mean * (bad / total) * (total - sample) / np.maximum(total - 1, 1), 0))
    return np.clip(np.rint(rng.normal(mean, spread)).astype("i8"), np.maximum(0, sample - bad), np.minimum(good, sample))


def shuffled(rng: np.random.Generator, sizes: np.ndarray, positives: int, times: int) -> np.ndarray:
    """``times`` tables with the margins ``sizes`` and ``positives``: the hits of each bin, a row for each table."""
    out = np.zeros((times, len(sizes)), "i8")
    left, rest = np.full(times, positives, "i8"), int(sizes.sum())
    for k, size in enumerate(sizes.tolist()[:-1]):
        rest -= size
        out[:, k] = drawn(rng, np.full(times, size, "i8"), np.full(times, rest, "i8"), left)
        left = left - out[:, k]
    out[:, -1] = left
    return out


def bits(sizes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Mutual information of each row of ``hits`` with the labels."""
    n, positives = sizes.sum(), hits.sum(axis=1, keepdims=True)
    total = 0.0
    for c, column in ((hits, positives), (sizes - hits, n - positives)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total = total + np.where(c > 0, c / n * np.log2(c * float(n) / (sizes * column.astype("f8"))), 0.0).sum(axis=1)
    return np.maximum(total, 0.0)


def shuffle_test(tables: DataFrame, times: int, seed: int, block: int = 100) -> DataFrame:
    """(candidate, p): the share of ``times`` shuffles of the labels, and of what is seen, that carry at least as much information.
    Blocks of shuffles are rows of their own, each with a seed that depends on the candidate and the block alone."""
    blocks = [(k, min(block, times - k * block)) for k in range(-(-times // block))]
    todo = tables.select("candidate", "sizes", "positives", "score", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in blocks])).alias("_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for name, sizes, positives, score, at in zip(b["candidate"], b["sizes"], b["positives"], b["score"], b["_b"], strict=True):
                rng = np.random.default_rng([seed, xxhash.xxh32_intdigest(name), at["k"]])
                sizes = np.asarray(sizes, "i8")
                out.append((name, int((bits(sizes, shuffled(rng, sizes, int(positives), at["n"])) >= score - 1e-12).sum())))
            yield pd.DataFrame(out, columns=["candidate", "beyond"])

    # one row a task, so that blocks run side by side
    dealt = todo.repartition("candidate", "_b")
    counts = dealt.mapInPandas(run, "candidate string, beyond long").groupBy("candidate").agg(F.sum("beyond").alias("_beyond"))
    return counts.select("candidate", ((1 + F.col("_beyond")) / (1 + times)).alias("p"))


def screening(rows: DataFrame, key: str, label: Column, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Round 1: all candidates of ``features`` with their tables and scores. A feature that more than a tenth of the rows lack has
    none."""
    wide = stored(rows.select(key, label.alias("_label"), *[F.col(f).cast("double").alias(f) for f in features]), "labelled")
    n = wide.count()
    if n < LEAST_ROWS:
        raise InsufficientData(f"a campaign needs {LEAST_ROWS} labelled rows, there are {n}")
    values = unpivoted(wide, key, F.col("_label"), list(features), nan=True)
    made = stored(generated(values).filter(F.col("n") >= (1 - MOST_MISSING) * n), "candidates")
    return made.drop("lo", "hi", "n").join(tables(values, made), "candidate")


def campaign(rows: DataFrame, key: str, label: Column, family: str, features: tuple[str, ...] = FEATURES, keep: float = KEEP, alpha: float = ALPHA, seed: int = 42) -> DataFrame:
    """Each candidate with how far it came: the best ``keep`` by information are shuffled ``SHUFFLES`` times; those below ``alpha``
    are registered, shuffled ``DEEP_SHUFFLES`` times and tested against the wealth of ``family`` in order of their names; what
    clears that gets a lockbox. Nobody shuffles a candidate that an earlier round dropped."""
    first = stored(screening(rows, key, label, features), "screening")
    second = best(first, "score", "candidate", keep).filter("score > 0")
    cheap = stored(shuffle_test(second, SHUFFLES, 1), "cheap").withColumnRenamed("p", "cheap_p")
    third = second.join(cheap.filter(F.col("cheap_p") < alpha), "candidate")
    deep = shuffle_test(third, DEEP_SHUFFLES, seed).withColumnRenamed("p", "deep_p")
    found = first.join(cheap, "candidate", "left").join(deep, "candidate", "left").withColumn("family", F.lit(family))
    return rounds(found, "family", "candidate", "score", "cheap_p", "deep_p", keep, alpha)


def verdict(candidates: DataFrame) -> DataFrame:
    """What a campaign found, one row."""
    reached = [F.count_if(F.col("round") >= r).alias(f"round{r}") for r in (1, 2, 3, 4)]
    return candidates.agg(*reached, F.max(F.when(F.col("round") == 4, F.col("candidate"))).alias("last_survivor")).withColumn(
        "decision", F.when(F.col("round4") > 0, "DISCOVERY_CANDIDATE").otherwise("NULL_RESULT")
    )
