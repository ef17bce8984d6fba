"""The rounds of a campaign: screening, triage, tests that spend wealth, the lockbox; and where to look next."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded
from .governance import BONUS, SHARE, START


def best(candidates: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The best ``share`` of candidates, one at least: the top rows by ``orderBy().limit()``, which Spark takes from each
    partition before it merges them."""
    n = candidates.count()
    return candidates.orderBy(F.desc(score), key).limit(max(1, math.ceil(n * share)))


def triaged(candidates: DataFrame, least: float, required: list[str]) -> DataFrame:
    """``candidates`` (effect, passed: names of diagnostics) with what they lack: ``short`` where the effect is too small or
    null, ``missing`` diagnostics, ``promoted`` where neither."""
    wanted = F.array(*[F.lit(r) for r in required]).cast("array<string>")
    missing = F.array_except(wanted, F.coalesce("passed", F.array().cast("array<string>")))
    small = F.coalesce(F.col("effect") < least, F.lit(True))
    return candidates.withColumns({"short": F.when(small, "effect"), "missing": F.array_join(missing, ","), "promoted": ~small & (F.size(missing) == 0)})


def rounds(candidates: DataFrame, family: str, key: str, score: str, p: str, deep_p: str, share: float, alpha: float = 0.05) -> DataFrame:
    """How far each candidate comes. Round 1 keeps the best ``share``; round 2 registers those with ``p`` below ``alpha``;
    round 3 tests them by ``deep_p`` in order of ``key`` against their family's wealth; what clears it gets a lockbox in
    round 4. ``round`` is the last one that a candidate entered."""
    chosen = best(candidates, score, key, share).select(key, F.lit(True).alias("_best"))
    rows = candidates.join(chosen, key, "left").withColumn("_tested", F.coalesce(F.col("_best") & (F.col(p) < alpha), F.lit(False)))

    def step(state, value):
        wealth = START if state is None else state
        bid = wealth * SHARE
        found = value is not None and value <= bid
        return wealth - bid + (BONUS if found else 0.0), (bid, found)

    tests = folded(rows.filter("_tested").select(key, family, deep_p), family, key, [deep_p], "alpha_spent double, found boolean", step).drop(family, deep_p)
    out = rows.join(tests, key, "left")
    found = F.coalesce("found", F.lit(False))
    round_ = F.when(found, 4).when(F.col("_tested"), 3).when(F.col("_best"), 2).otherwise(1)
    outcome = F.when(found, "replicated").when(F.col("_tested"), "screenedNotPromoted").when(F.col("_best"), "untested").otherwise("rejected")
    return out.withColumns({"round": round_, "outcome": outcome, "lockbox": F.when(found, F.concat(F.lit("lb"), F.col(key).cast("string")))}).drop("_best", "_tested", "found")


def round_metrics(rows: DataFrame) -> DataFrame:
    """Evaluated and promoted by round; all that enter the last round get a lockbox."""
    counts = [F.count_if(F.col("round") >= r) for r in (1, 2, 3, 4)]
    each = F.array(*[F.struct(F.lit(r).alias("round"), F.col(f"n{r}").alias("evaluated"), F.col(f"n{min(r + 1, 4)}").alias("promoted")) for r in (1, 2, 3, 4)])
    return rows.agg(*[c.alias(f"n{r}") for r, c in enumerate(counts, 1)]).select(F.explode(each).alias("m")).select("m.*")


def remaining(tests: DataFrame, families: DataFrame, family: str, order: str, p: str) -> DataFrame:
    """The wealth each of ``families`` has left after its ``tests``, and their sum as family 'all'."""
    def step(state, value):
        wealth = START if state is None else state
        bid = wealth * SHARE
        after = wealth - bid + (BONUS if value is not None and value <= bid else 0.0)
        return after, (after,)

    left = folded(tests.select(family, order, p), family, order, [p], "after double", step).groupBy(family).agg(F.max_by("after", order).alias("after"))
    rows = families.join(left, family, "left").withColumn("wealth", F.coalesce("after", F.lit(START)))
    return rows.rollup(family).agg(F.sum("wealth").alias("wealth")).withColumn(family, F.coalesce(family, F.lit("all")))


def next_points(surrogate: DataFrame) -> DataFrame:
    """Where a surrogate (at, mean, variance, upper) says to look: the largest variance, or the largest upper bound; of equals
    the smallest point."""
    pick = lambda c: F.max_by("at", F.struct(c, -F.col("at")))
    one = surrogate.filter("variance is not null").agg(pick("variance").alias("active_learning"), pick("upper").alias("bayesian"))
    return one.unpivot([], ["active_learning", "bayesian"], "method", "at")


def decided(tests: DataFrame, registered: DataFrame, manifests: DataFrame, family: str, order: str, p: str) -> DataFrame:
    """Discovery decisions on ``tests`` (family, order, hypothesis, experiment or null, p): one step of the family's wealth
    for each hypothesis that is ``registered`` (hypothesis, stage) and whose experiment, if it names one, has a complete
    manifest (experiment, complete). The others are refused and spend nothing."""
    rows = tests.join(registered.select("hypothesis", "stage"), "hypothesis", "left").join(manifests.select("experiment", "complete"), "experiment", "left")
    incomplete = F.col("experiment").isNotNull() & ~F.coalesce("complete", F.lit(False))
    rows = rows.withColumn("refused", F.when(F.col("stage").isNull(), "NotRegistered").when(incomplete, "IncompleteManifest"))

    def step(state, value, refused):
        wealth = START if state is None else state
        if refused is not None:
            return wealth, (None, None)
        bid = wealth * SHARE
        found = value is not None and value <= bid
        return wealth - bid + (BONUS if found else 0.0), (bid, found)

    return folded(rows.drop("complete"), family, order, [p, "refused"], "alpha_spent double, rejected boolean", step)
