"""Append-only ledgers and what is read from them: wealth, canaries, drift, lifecycles, lineage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scans import numbered
from tidewright.functions.windows import over
from tidewright.sources.shared import stored

from .folds import folded

#: Fixed values of the spending rule.
START, SHARE, BONUS = 0.025, 0.5, 0.025


def wealth(tests: DataFrame, family: str, order: str, p: str, start: float = START, share: float = SHARE, bonus: float = BONUS) -> DataFrame:
    """Online control of false discoveries: each test bids a share of its family's wealth, loses it, and wins the bonus if
    its p-value is within the bid. A step needs the one before, so a family is folded in order; a null p-value wins nothing."""
    def step(state, value):
        w, seq = state or (start, 0)
        bid = w * share
        won = None if value is None else value <= bid
        after = w - bid + (bonus if won else 0.0)
        return (after, seq + 1), (seq, bid, won, w, after)

    rows = tests.select(family, F.col(order).cast("long").alias(order), F.col(p).cast("double").alias(p))
    out = folded(rows, family, order, [p], "seq long, alpha_spent double, rejected boolean, wealth_before double, wealth_after double", step)
    return out.select(family, "seq", order, p, "alpha_spent", "rejected", "wealth_before", "wealth_after")


def latest(ledger: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return ledger.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def hysteresis(events: DataFrame, stream: str, order: str, raw: str, n: int = 5) -> DataFrame:
    """The published state of each window: it turns to what the last ``n`` raw verdicts agree on. The state a window
    leaves is therefore that of the latest window that such a streak ended at, so no fold is needed."""
    w = Window.partitionBy(stream).orderBy(order)
    streak = w.rowsBetween(-(n - 1), 0)
    agreed = F.when((F.count("*").over(streak) == n) & (F.min(raw).over(streak) == F.max(raw).over(streak)), F.when(F.col(raw), "drifted").otherwise("stable"))
    rows = events.withColumn("_agreed", agreed)
    rows = rows.withColumn("state_after", F.coalesce(F.last("_agreed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("stable")))
    before = F.coalesce(F.lag("state_after").over(w), F.lit("stable"))
    return rows.withColumn("published", F.col("state_after") != before).drop("_agreed")


def canary(ledger: DataFrame, family: str, supported: Column, replicated: Column, material: float = 0.10, least: int = 5, order: str = "seq") -> DataFrame:
    """The empirical discovery rate of each family against what its remaining wealth implies."""
    counts = ledger.groupBy(family).agg(F.count_if(supported).alias("supported_count"), F.count_if(supported & replicated).alias("replicated_count"), F.max_by("wealth_after", order).alias("allocated_wealth"))
    rows = counts.withColumn("edr", over(F.col("replicated_count").cast("double"), F.col("supported_count").cast("double"))).withColumn("implied_target", 1 - F.col("allocated_wealth"))
    rows = rows.withColumn("divergence", F.col("implied_target") - F.col("edr"))
    return rows.withColumns({
        "direction": F.when(F.col("divergence") > 0, "below-target").when(F.col("divergence") < 0, "above-target").when(F.col("divergence") == 0, "on-target"),
        "below_minimum_sample": F.col("supported_count") < least,
        "material_divergence": F.coalesce((F.abs("divergence") > material) & (F.col("supported_count") >= least), F.lit(False)),
    })


def verdict_ladder(rows: DataFrame, checks: list[tuple[str, Column]], passed: str) -> DataFrame:
    """The first of the ordered checks that fails names the verdict."""
    ladder = None
    for name, fails in checks:
        ladder = F.when(fails, name) if ladder is None else ladder.when(fails, name)
    return rows.withColumn("verdict", ladder.otherwise(passed))


def _width(*ranges: DataFrame) -> int:
    """The mean length of some ranges: cells of this width put a range into two of them on average, however long ranges are."""
    lengths = [r.agg(F.sum(F.col("end") - F.col("start") + 1).alias("s"), F.count("*").alias("n")).first() for r in ranges]
    return max(1, math.ceil(sum(x.s or 0 for x in lengths) / max(1, sum(x.n for x in lengths))))


def _in_cells(ranges: DataFrame, width: int) -> DataFrame:
    return ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def _touching(a: str, b: str, width: int) -> Column:
    """That two ranges of one dataset overlap, said in the first cell that both are in only."""
    c = lambda x, n: F.col(f"{x}.{n}")
    first = F.greatest(F.floor(c(a, "start") / width), F.floor(c(b, "start") / width))
    return (c(a, "dataset") == c(b, "dataset")) & (c(a, "cell") == c(b, "cell")) & (c(a, "cell") == first) & (c(a, "start") <= c(b, "end")) & (c(b, "start") <= c(a, "end"))


def prior_access(accesses: DataFrame, registrations: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Accesses to a hypothesis's holdout range before it was registered that nobody disclosed."""
    width = _width(accesses, registrations)
    a, r = _in_cells(accesses, width).alias("a"), _in_cells(registrations, width).alias("r")
    # exploded ranges are much larger than the files that Spark judges them by, so neither side may be broadcast
    found = a.join(r.hint("merge"), _touching("a", "r", width) & (F.col("a.at") < F.col("r.registered_at"))).select("r.hypothesis_id", "a.access_id")
    return found.join(disclosed.select("hypothesis_id", "access_id").hint("merge"), ["hypothesis_id", "access_id"], "left_anti")


def behaviors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each behavior with its hypotheses, their candidates and features: three hops against the edges' direction."""
    hop = lambda kind, a, b: edges.filter(F.col("edge_type") == kind).select(F.col("from_node").alias(a), F.col("to_node").alias(b))
    b = nodes.filter("node_type = 'behavior'").select(F.col("id").alias("behavior"))
    rows = b.join(hop("explains", "hypothesis", "behavior"), "behavior").join(hop("tests", "candidate", "hypothesis"), "hypothesis", "left").join(hop("uses", "feature", "candidate"), "candidate", "left")
    return rows.groupBy("behavior").agg(F.countDistinct("hypothesis").alias("hypotheses"), F.countDistinct("candidate").alias("candidates"), F.countDistinct("feature").alias("features"))


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each feature with the first candidate, hypothesis and behavior along its edges, null where there is none."""
    def first(kind: str, a: str, b: str) -> DataFrame:
        w = Window.partitionBy("from_node").orderBy("seq")
        return edges.filter(F.col("edge_type") == kind).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(F.col("from_node").alias(a), F.col("to_node").alias(b))

    f = nodes.filter("node_type = 'feature'").select(F.col("id").alias("feature"))
    return f.join(first("uses", "feature", "candidate"), "feature", "left").join(first("tests", "candidate", "hypothesis"), "candidate", "left").join(first("explains", "hypothesis", "behavior"), "hypothesis", "left").select("feature", "candidate", "hypothesis", "behavior")


def closure(edges: DataFrame) -> DataFrame:
    """Ancestors of each node with the shortest distance, however far: one more join for each step, until a step adds none.
    A pair that is known isn't followed again, so the rounds end on graphs with cycles too."""
    step = stored(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "steps")
    found = reach = step.withColumn("distance", F.lit(1))
    k = 1
    while True:
        k += 1
        ahead = reach.select("node", F.col("ancestor").alias("via")).join(step.select(F.col("node").alias("via"), "ancestor"), "via").select("node", "ancestor").distinct()
        reach = stored(ahead.join(found, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(k)), "reach")
        if reach.isEmpty():
            return found
        found = found.unionByName(reach)
        if k % 16 == 0:
            found = stored(found, "closure")


def yields(moves: DataFrame, family: str, key: str, to: str, stage: str, order: str) -> DataFrame:
    """For each family the share of hypotheses that ever reached ``stage`` and of those that are there now."""
    each = moves.groupBy(family, key).agg(F.max((F.col(to) == stage).cast("int")).alias("ever"), F.max_by(to, order).alias("now"))
    return each.groupBy(family).agg(F.count("*").alias("hypotheses"), F.avg("ever").alias("discovery_yield"), F.avg((F.col("now") == stage).cast("int")).alias("survival_rate"))


def funnel(rounds: DataFrame) -> DataFrame:
    """Evaluated and promoted by campaign and overall."""
    return rounds.rollup("campaign").agg(F.sum("evaluated").alias("evaluated"), F.sum("promoted").alias("promoted")).withColumn("rate", over(F.col("promoted").cast("double"), F.col("evaluated").cast("double")))


def ucb(arms: DataFrame, arm: str, pulls: str, reward: str) -> DataFrame:
    """Upper confidence scores of arms; one never pulled comes first, and of equal ones the first by name."""
    total = arms.agg(F.sum(pulls).alias("_all"))
    mean = over(F.col(reward).cast("double"), F.col(pulls).cast("double"))
    rows = arms.join(F.broadcast(total))
    score = F.when(F.col(pulls) == 0, F.lit(float("inf"))).otherwise(mean + F.sqrt(F.lit(2.0)) * F.sqrt(F.log("_all") / F.nullif(F.col(pulls), F.lit(0))))
    return numbered(rows.withColumn("score", score).drop("_all"), [F.desc("score"), arm])


def screened(candidates: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The best ``share`` of candidates, one at least."""
    return numbered(candidates, [F.desc(score), key]).filter(F.col("rank") <= max(1, math.ceil(candidates.count() * share)))


def binarized(rows: DataFrame, value: str, order: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Each value against thresholds that are the values at exact places in sorted order."""
    n = rows.count()
    at = {s: max(0, int(s * n) - 1) for s in shares}
    placed = numbered(rows.select(value, *order), [value, *order], "_k").withColumn("_k", F.col("_k") - 1).filter(F.col("_k").isin(*at.values()))
    cuts = placed.agg(*[F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"cut_{round(100 * s)}") for s, k in at.items()])
    out = rows.join(F.broadcast(cuts))
    return out.withColumns({f"{side}_{round(100 * s)}": (F.col(value) >= F.col(f"cut_{round(100 * s)}") if side == "above" else F.col(value) < F.col(f"cut_{round(100 * s)}")).cast("int") for s in shares for side in ("above", "below")})


def fingerprint(config: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(config)))), 256)


def family_key(name: str, market: Column, options: Column) -> Column:
    pairs = F.transform(F.sort_array(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(":", F.lit(name), market, F.array_join(pairs, ","))


def overlapping(partitions: DataFrame) -> DataFrame:
    """Pairs of partitions of one dataset whose ranges overlap, each once: only those that share a cell are compared."""
    width = _width(partitions)
    rows = _in_cells(partitions, width)
    pairs = rows.alias("a").join(rows.alias("b").hint("merge"), _touching("a", "b", width) & (F.col("a.id") < F.col("b.id")))
    return pairs.select("a.dataset", F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))
