"""Lineages of hypotheses: generations, failures, and the one indeterminate result that each may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the power that a test should have.
LEAST_POWER = 0.80
#: What a decision says of itself.
REASONS = {
    "granted": "Low power and drift are confirmed and oversight approved",
    "criteria": "Indeterminate criteria not met: power below the minimum, confirmed drift and approval, all three",
    "used": "Lineage has already used its one permitted Indeterminate classification",
}


def gated(attempts: DataFrame, least_power: float = LEAST_POWER) -> DataFrame:
    """``attempts`` (lineage, hypothesis, seq, power, drift, approved_by, rationale) with their ``classification`` and its reason. An
    attempt is Indeterminate if its power is known and too low, drift is confirmed and someone approved with a rationale,
    and no attempt before it in the lineage, of whatever hypothesis, was. ``seq`` orders a lineage's attempts; of equal ones
    the smaller hypothesis comes first. Partial minima find the first of each lineage, so a long one is no large group."""
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    low = F.col("power").isNotNull() & ~F.isnan("power") & (F.col("power") < least_power)
    rows = attempts.withColumn("_met", low & F.coalesce("drift", F.lit(False)) & filled("approved_by") & filled("rationale"))
    first = rows.filter("_met").groupBy("lineage").agg(F.min(F.struct("seq", "hypothesis")).alias("_first"))
    out = rows.join(first, "lineage", "left")
    chosen = F.col("_met") & (F.struct("seq", "hypothesis") == F.col("_first"))
    why = F.when(chosen, REASONS["granted"]).when(F.col("_met"), REASONS["used"]).otherwise(REASONS["criteria"])
    return out.withColumns({"classification": F.when(chosen, "Indeterminate").otherwise("Rejected"), "reason": why}).drop("_met", "_first")


def annotated(decisions: DataFrame, latest: DataFrame) -> DataFrame:
    """The rows that indeterminate ``decisions`` add to the log of moves: the stage that each hypothesis is in (``latest``: hypothesis,
    stage, seq) stays, the number goes on."""
    rows = decisions.filter("classification = 'Indeterminate'").select("hypothesis", "power", F.col("approved_by")).join(latest, "hypothesis")
    return rows.select("hypothesis", (F.col("seq") + 1).alias("seq"), F.col("stage").alias("from"), F.col("stage").alias("to"), F.concat(F.lit("Indeterminate: power "), F.round("power", 4).cast("string")).alias("reason"), "approved_by")


def counted(hypotheses: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each lineage of ``hypotheses`` (lineage, hypothesis, generation) its generations, the newest, and how many of its
    hypotheses were decided against, and how often it was indeterminate."""
    own = hypotheses.groupBy("lineage").agg(F.count("*").alias("generations"), F.max("generation").alias("newest_generation"))
    ends = decisions.groupBy("lineage").agg(F.countDistinct(F.when(F.col("classification") == "Rejected", F.col("hypothesis"))).alias("failures"), F.count_if(F.col("classification") == "Indeterminate").alias("indeterminate"))
    return own.join(ends, "lineage", "left").fillna(0, ["failures", "indeterminate"])
