"""The graph of what was derived from what: edges that would close a cycle are refused, in the order in which they came."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.shared import stored

from .governance import closure


def descendants(edges: DataFrame) -> DataFrame:
    """(node, descendant, distance) for all that was derived from a node, however far."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return closure(turned).withColumnRenamed("ancestor", "descendant")


def _peeled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges that may lie on a cycle, and those taken off: an edge on a cycle ends where another begins and begins where another
    ends. What is left when none can be taken off is small where cycles are rare."""
    off = []
    while True:
        begins, ends = edges.select(F.col("child").alias("parent")).distinct(), edges.select(F.col("parent").alias("child")).distinct()
        marked = edges.join(begins.withColumn("_on", F.lit(True)), "parent", "left").join(ends.withColumn("_from", F.lit(True)), "child", "left")
        marked = stored(marked.withColumn("_may", F.col("_on").isNotNull() & F.col("_from").isNotNull()).drop("_on", "_from"), "peel")
        gone = marked.filter("not _may").drop("_may")
        if gone.isEmpty():
            return edges, off
        off.append(gone)
        edges = marked.filter("_may").drop("_may")


def _reached(edges: DataFrame) -> DataFrame:
    """(node, ancestor, latest): for each pair with a path between them the smallest number of which a path has no later edge."""
    step = stored(edges.groupBy(F.col("child").alias("node"), F.col("parent").alias("ancestor")).agg(F.min("seq").alias("latest")), "steps")
    found = new = step
    while True:
        ahead = new.select("node", F.col("ancestor").alias("via"), F.col("latest").alias("_a")).join(step.select(F.col("node").alias("via"), "ancestor", F.col("latest").alias("_b")), "via")
        ahead = ahead.groupBy("node", "ancestor").agg(F.min(F.greatest("_a", "_b")).alias("latest"))
        known = found.withColumnRenamed("latest", "_known")
        new = stored(ahead.join(known, ["node", "ancestor"], "left").filter(F.col("_known").isNull() | (F.col("latest") < F.col("_known"))).drop("_known"), "ahead")
        if new.isEmpty():
            return found
        found = stored(found.unionByName(new).groupBy("node", "ancestor").agg(F.min("latest").alias("latest")), "reached")


def _closing(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Those of ``edges`` whose child is an ancestor of their parent by earlier edges."""
    back = reached.select(F.col("node").alias("parent"), F.col("ancestor").alias("child"), "latest")
    return edges.join(back, ["child", "parent"]).filter(F.col("latest") < F.col("seq")).select("child", "parent", "seq")


def admitted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (child, parent, seq) with ``refused``: unknown where ``nodes`` (id) lack an end, self, or cycle where the edge, added
    in order of ``seq``, would make a node its own ancestor by edges admitted before; null for the others.

    Edges on no cycle are admitted at once. Of the rest, each round refuses those that admitted edges close and admits those that
    nothing earlier could close; the earliest that is open is always one of them, so rounds come to an end."""
    known = nodes.select(F.col("id")).distinct().withColumn("_k", F.lit(True))
    rows = edges.join(known.select(F.col("id").alias("child"), F.col("_k").alias("_c")), "child", "left").join(known.select(F.col("id").alias("parent"), F.col("_k").alias("_p")), "parent", "left")
    why = F.when(F.col("_c").isNull() | F.col("_p").isNull(), "unknown").when(F.col("child") == F.col("parent"), "self")
    rows = stored(rows.withColumn("refused", why).select("child", "parent", "seq", "refused"), "edges")
    open_, safe = _peeled(rows.filter("refused is null").select("child", "parent", "seq"))
    open_ = stored(open_, "open")
    sure, cycles = open_.limit(0), []
    while not open_.isEmpty():
        refused = stored(_closing(open_, _reached(sure)), "refused")
        cycles.append(refused)
        open_ = open_.join(refused, ["child", "parent", "seq"], "left_anti")
        doubtful = _closing(open_, _reached(sure.unionByName(open_)))
        safe_now = stored(open_.join(doubtful, ["child", "parent", "seq"], "left_anti"), "safe")
        sure = stored(sure.unionByName(safe_now), "sure")
        open_ = stored(open_.join(safe_now, ["child", "parent", "seq"], "left_anti"), "open")
    good = reduce(DataFrame.unionByName, [*safe, sure]).withColumn("refused", F.lit(None).cast("string"))
    bad = [c.withColumn("refused", F.lit("cycle")) for c in cycles]
    return reduce(DataFrame.unionByName, [rows.filter("refused is not null"), good, *bad])
