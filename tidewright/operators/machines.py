"""State machines over ledgers of moves: lifecycles, publication, families; and what counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.windows import over

from .folds import folded

#: The stages of a hypothesis and the moves between them.
LIFECYCLE = {
    "Registration": ("FeatureGeneration",),
    "FeatureGeneration": ("Discovery",),
    "Discovery": ("Replication",),
    "Replication": ("Lockbox",),
    "Lockbox": ("Publication",),
    "Publication": ("Retirement",),
    "Retirement": ("Archive",),
    "Archive": (),
}
#: Stages that an indeterminate result may enter again.
REATTEMPTED = ("Discovery", "Replication")
#: The stages of a candidate.
CANDIDATE = {
    "Generated": ("Screened", "Deprecated"),
    "Screened": ("Triaged", "Deprecated"),
    "Triaged": ("Confirmed", "Deprecated"),
    "Confirmed": ("Replicated", "Deprecated"),
    "Replicated": ("Published", "Deprecated"),
    "Published": ("Deprecated",),
    "Deprecated": (),
}
#: The statuses of a publication, the moves between them and the statuses that begin one.
PUBLICATION = {
    "ProvisionallySupported": ("Replicated", "Rejected", "Indeterminate"),
    "Indeterminate": ("Rejected",),
    "Rejected": ("Retired",),
    "Refuted": ("Retired",),
    "Replicated": ("Supported", "Rejected"),
    "Supported": ("Published", "Deprecated"),
    "Published": ("Operational", "Deprecated", "Retired"),
    "Operational": ("Deprecated",),
    "Deprecated": ("Retired",),
    "Retired": ("Archived",),
    "Archived": (),
}
ENTRIES = ("ProvisionallySupported", "Rejected", "Indeterminate", "Refuted")
#: The statuses of a family of representations; a rejected one comes back only with a reason of these kinds.
FAMILY = {"Active": ("Rejected", "Replicated", "Retired"), "Rejected": ("Active", "Retired"), "Replicated": ("Retired",), "Retired": ()}
JUSTIFICATIONS = ("NewData", "NewSearchSpaceVersion", "NewScientificQuestion", "ProtocolRevision")
#: Evidence tiers in order, and which estimates may be shown and beside which.
TIERS = ("None", "Weak", "Moderate", "Strong", "Extraordinary")
REPORTABLE = ("validation", "replication", "lockbox", "operational")
ACCOMPANIED = {"validation": ("replication", "lockbox")}


def machine(moves: DataFrame, key: str, order: str, to: str, edges: dict, entries: tuple, meets: Column | None = None, again: Column | None = None, reattempted: tuple = ()) -> DataFrame:
    """``moves`` with ``seq`` (how many moves were valid before, null for one that isn't), ``from`` (the state it was made
    from), ``valid`` and ``refused`` (transition or requirement). A move is valid if an edge leads from the state reached by
    the valid moves before it, or it begins a key with one of ``entries``, and its requirement ``meets``; where ``again``
    holds it may also enter one of the ``reattempted`` states that it is in. An invalid move changes nothing."""
    rows = moves.withColumn("_meets", F.coalesce(meets, F.lit(False)) if meets is not None else F.lit(True))
    rows = rows.withColumn("_again", F.coalesce(again, F.lit(False)) if again is not None else F.lit(False))

    def step(state, target, met, once_more):
        at, n = state or (None, 0)
        leads = target in (entries if at is None else edges.get(at, ())) or (once_more and at == target and at in reattempted)
        if leads and met:
            return (target, n + 1), (n, at, True, None)
        return (at, n), (None, at, False, "requirement" if leads else "transition")

    return folded(rows, key, order, [to, "_meets", "_again"], "seq long, from string, valid boolean, refused string", step).drop("_meets", "_again")


def lifecycle(moves: DataFrame, key: str, order: str, to: str, again: Column | None = None) -> DataFrame:
    return machine(moves, key, order, to, LIFECYCLE, ("Registration",), again=again, reattempted=REATTEMPTED)


def candidate_lifecycle(moves: DataFrame, key: str, order: str, to: str) -> DataFrame:
    return machine(moves, key, order, to, CANDIDATE, ("Generated",))


def family_status(moves: DataFrame, key: str, order: str, to: str, justification: str) -> DataFrame:
    """A family begins Active; a rejected one comes back only with a justification of a known kind. The edge from Rejected
    is the only one into Active, so the requirement can be told from the target alone; beginning needs none."""
    rows = moves.withColumn("_kind", F.col(justification).isin(*JUSTIFICATIONS))

    def step(state, target, known):
        at, n = state or (None, 0)
        leads = target in (("Active",) if at is None else FAMILY.get(at, ()))
        met = at is None or target != "Active" or bool(known)
        if leads and met:
            return (target, n + 1), (n, at, True, None)
        return (at, n), (None, at, False, "requirement" if leads else "transition")

    return folded(rows, key, order, [to, "_kind"], "seq long, from string, valid boolean, refused string", step).drop("_kind")


def rank(tier: Column, tiers: tuple = TIERS) -> Column:
    """The place of a tier, null where it isn't one."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in tiers]), tier), F.lit(0)).cast("int") - 1


def reportable(estimate: Column, beside: Column) -> Column:
    """Whether an estimate of this type may be shown, beside one of another type where it needs that."""
    alone = [e for e in REPORTABLE if e not in ACCOMPANIED]
    needs = [(estimate == e) & beside.isin(*with_) for e, with_ in ACCOMPANIED.items()]
    return F.coalesce(estimate.isin(*alone), F.lit(False)) | F.coalesce(needs[0], F.lit(False))


def publication_requirement(to: Column, tier: Column, question: Column, report: Column, monitored: Column, approved: Column, contradicted: Column, estimate: Column, beside: Column) -> Column:
    """What each status asks of a move into it."""
    shown = reportable(estimate, beside)
    asked = F.when(to == "ProvisionallySupported", (rank(tier) >= 1) & shown).when(to == "Replicated", (rank(tier) >= 2) & shown).when(to == "Supported", (rank(tier) >= 3) & shown)
    asked = asked.when(to == "Published", report & (rank(tier) >= F.when(question, 4).otherwise(3)) & (estimate == "lockbox")).when(to == "Operational", monitored)
    return asked.when(to == "Indeterminate", approved).when(to == "Refuted", approved | contradicted).otherwise(F.lit(True))


def publication(moves: DataFrame, key: str, order: str, to: str, meets: Column) -> DataFrame:
    return machine(moves, key, order, to, PUBLICATION, ENTRIES, meets)


#: Statuses that a result shouldn't rest in, and how long it may.
DEBT, DWELL_MS = ("ProvisionallySupported", "Replicated", "Deprecated"), 30 * 24 * 60 * 60 * 1000
NEGATIVE = ("Rejected", "Refuted")


def metascience(moves: DataFrame, hypotheses: DataFrame, family: str, key: str, order: str, to: str, at_ms: str, now: int) -> DataFrame:
    """For each family of ``hypotheses`` (family, key), from the valid publication ``moves`` (key, order, from, to, time):
    discovery and replication yield, indeterminate and survival rates, and scientific debt."""
    each = moves.groupBy(key).agg(
        F.max(F.col(to) == "ProvisionallySupported").alias("found"), F.max(F.col("from") == "ProvisionallySupported").alias("attempted"),
        F.max((F.col("from") == "ProvisionallySupported") & (F.col(to) == "Replicated")).alias("replicated"), F.max(F.col(to) == "Indeterminate").alias("indeterminate"),
        F.max_by(to, order).alias("now"), F.max_by(at_ms, order).alias("since"),
    )
    rows = hypotheses.join(each, key, "left").withColumn("dwell", F.when(F.col("now").isin(*DEBT) & (F.lit(now) - F.col("since") > DWELL_MS), F.lit(now) - F.col("since")))
    share = lambda a, b: over(a.cast("double"), b.cast("double"))
    return rows.groupBy(family).agg(
        F.count("*").alias("hypotheses"), share(F.count_if("found"), F.count("*")).alias("discovery_yield"), share(F.count_if("replicated"), F.count_if("attempted")).alias("replication_yield"),
        share(F.count_if("indeterminate"), F.count("now")).alias("indeterminate_rate"), share(F.count_if(~F.coalesce(F.col("now").isin(*NEGATIVE), F.lit(False))), F.count("*")).alias("survival_rate"),
        F.count("dwell").alias("debt_count"), F.coalesce(F.sum("dwell"), F.lit(0)).alias("debt_ms"),
    )
