"""The knowledge graph as two tables: nodes (id, node_type, ref, label, family, tier) and edges (edge_type, from_node, to_node,
seq, note). Every question is a few joins; edges are numbered by their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import over


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == kind)


def edges_of(edges: DataFrame, kind: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges of a kind as (source, target, seq, note)."""
    return edges.filter(F.col("edge_type") == kind).select(F.col("from_node").alias(source), F.col("to_node").alias(target), "seq", "note")


def first_edge(edges: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """Of each source its first edge of a kind."""
    return edges_of(edges, kind, source, target).groupBy(source).agg(F.min_by(target, "seq").alias(target))


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Those of ``new`` that aren't there yet, by type and reference, each once: of equals the one with the smallest id."""
    w = Window.partitionBy("node_type", "ref").orderBy("id")
    once = new.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return once.join(nodes.select("node_type", "ref"), ["node_type", "ref"], "left_anti")


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``new`` edges (edge_type, from_node, to_node, note) between nodes that exist, numbered on from what their source has,
    in the order of ``order`` and then of their targets."""
    known = nodes.select(F.col("id"))
    # sources last: their join, the numbers they have and the window then share one shuffle
    fit = new.join(known.withColumnRenamed("id", "to_node"), "to_node", "left_semi").join(known.withColumnRenamed("id", "from_node"), "from_node", "left_semi")
    have = edges.groupBy("from_node").agg((F.max("seq") + 1).alias("_next"))
    k = F.row_number().over(Window.partitionBy("from_node").orderBy(order, "to_node"))
    return fit.join(have, "from_node", "left").withColumn("seq", F.coalesce("_next", F.lit(0)) + k - 1).drop("_next")


def families_with_status(nodes: DataFrame, history: DataFrame, status: str) -> DataFrame:
    """Families (representation family nodes) whose newest status in ``history`` (family, seq, status) is ``status``."""
    now = history.groupBy("family").agg(F.max_by("status", "seq").alias("status"))
    return of_type(nodes, "representationFamily").select(F.col("ref").alias("family"), "label").join(now, "family").filter(F.col("status") == status)


def _hypothesis_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Features with their family and the hypothesis at the end of their first edges, null where there is none."""
    f = of_type(nodes, "feature").select(F.col("id").alias("feature"), "family")
    return f.join(first_edge(edges, "implements", "feature", "candidate"), "feature", "left").join(first_edge(edges, "tests", "candidate", "hypothesis"), "candidate", "left").select("feature", "family", "hypothesis")


def family_outcomes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each feature family its features and how many of them belong to a hypothesis that was once screened out, and its
    rank: families without features first, then those that lose least."""
    gone = edges_of(edges, "screenedNotPromoted", "hypothesis").select("hypothesis").distinct().withColumn("gone", F.lit(1))
    each = _hypothesis_of(nodes, edges).filter(F.col("family").isNotNull()).join(gone, "hypothesis", "left").groupBy("family").agg(F.count("*").alias("features"), F.count("gone").alias("eliminated"))
    return each.withColumn("elimination_rate", over(F.col("eliminated").cast("double"), F.col("features").cast("double")))


def surviving(nodes: DataFrame, edges: DataFrame, tiers: Column) -> DataFrame:
    """Features whose hypothesis has a summary that passes ``tiers`` (a condition on tier), each with the tier of the last
    summary, whether or not that is the one that passes."""
    said = edges_of(edges, "summarizes", "summary", "hypothesis").join(of_type(nodes, "evidenceSummary").select(F.col("id").alias("summary"), "tier"), "summary")
    each = said.groupBy("hypothesis").agg(F.max_by("tier", F.struct("seq", "summary")).alias("latest_tier"), F.max(tiers).alias("passes")).filter("passes")
    return _hypothesis_of(nodes, edges).join(each.select("hypothesis", "latest_tier"), "hypothesis").select("feature", "family", "latest_tier")


def unexplored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Versions of the search space that no hypothesis was generated from."""
    used = edges_of(edges, "generatedFrom", "hypothesis", "id").select("id")
    return of_type(nodes, "searchSpaceVersion").select("id", "label").join(used, "id", "left_anti")


def campaigns_of(nodes: DataFrame) -> DataFrame:
    """Discovery and replication campaigns with the family that each belongs to."""
    return nodes.filter(F.col("node_type").isin("discoveryCampaign", "replicationCampaign") & F.col("family").isNotNull()).select("family", F.col("id").alias("campaign"))


def campaign_totals(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """For each family its campaigns, their computational cost, and what their rounds evaluated and promoted: the record of
    an arm. ``metrics`` has campaign, round, evaluated, promoted, cost; what isn't finite counts for nothing."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    each = metrics.groupBy("campaign").agg(F.sum(finite("cost")).alias("cost"), F.sum("evaluated").alias("evaluated"), F.sum("promoted").alias("promoted"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return campaigns_of(nodes).join(each, "campaign", "left").groupBy("family").agg(F.count("*").alias("campaigns"), zero("cost"), zero("evaluated"), zero("promoted"))


def replication_history(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The campaigns that each hypothesis was replicated in, by the number of the edge."""
    c = of_type(nodes, "replicationCampaign").select(F.col("id").alias("campaign"), "label")
    w = Window.partitionBy("hypothesis").orderBy("seq")
    return edges_of(edges, "replicatedIn", "hypothesis", "campaign").join(c, "campaign").select("hypothesis", "campaign", "label", F.row_number().over(w).alias("place"))


def evidence(nodes: DataFrame, edges: DataFrame, stages: DataFrame, statuses: DataFrame) -> DataFrame:
    """One record for each hypothesis: its family and version (of the first edge), campaigns, eliminations, replications
    and summaries in order, stage and status. ``stages`` and ``statuses`` have hypothesis and stage or status."""
    def listed(kind: str, name: str, item: Column, reverse: bool = False) -> DataFrame:
        e = edges_of(edges, kind, "other", "hypothesis") if reverse else edges_of(edges, kind, "hypothesis", "other")
        return e.groupBy("hypothesis").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "other", "note"))), lambda x: item(x)).alias(name))

    rows = of_type(nodes, "hypothesis").select(F.col("id").alias("hypothesis"))
    target, note = (lambda x: x["other"]), (lambda x: x["note"])
    parts = [
        first_edge(edges, "instanceOfFamily", "hypothesis", "family"), first_edge(edges, "generatedFrom", "hypothesis", "version"), listed("memberOfCampaign", "campaigns", target),
        listed("screenedNotPromoted", "eliminations", note), listed("replicatedIn", "replications", target), listed("summarizes", "summaries", target, True), stages, statuses,
    ]
    for p in parts:
        rows = rows.join(p, "hypothesis", "left")
    return rows
