"""What closed trades teach: evidence as it stood when each was opened, and weights that follow from how they ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scans import carried
from tidewright.functions.windows import over
from tidewright.sources.shared import stored

from .scoring import WEIGHTS, clamp

#: Trades before weights are calibrated, and those a dimension needs.
LEAST_TRADES, LEAST_RELEVANT, LEAST_AGREEING = 20, 5, 3


def as_of(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(``key``, dimensions): for each of ``rows`` (key, symbol, i) the newest ``evidence`` (symbol, i, dimensions) at its tick or
    before; rows without any are left out. Evidence of the same tick counts as there already."""
    both = evidence.select("symbol", (2 * F.col("i")).alias("_t"), F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), "dimensions")
    both = both.unionByName(rows.select("symbol", (2 * F.col("i") + 1).alias("_t"), key, F.lit(None).cast(dict(evidence.dtypes)["dimensions"]).alias("dimensions")))
    found = carried(both, F.col("dimensions"), "_known", "_t")
    return found.filter(F.col(key).isNotNull() & F.col("_known").isNotNull()).select(key, F.col("_known").alias("dimensions"))


def learned(opened: DataFrame, closed: DataFrame, evidence: DataFrame, key: str = "trade") -> DataFrame:
    """The log of ``closed`` trades (key, symbol, i, direction, won, pnl): with the evidence at their opening (``opened``: key,
    symbol, i) where that is on record, else ``approximate``, with the evidence at their close; without either they teach
    nothing."""
    closed, evidence = stored(closed, "closed-trades"), stored(evidence, "evidence")
    entry = stored(as_of(opened.select(key, "symbol", "i"), evidence, key), "entries")
    exit_ = as_of(closed.join(entry.select(key), key, "left_anti").select(key, "symbol", "i"), evidence, key)
    known = entry.withColumn("approximate", F.lit(False)).unionByName(exit_.withColumn("approximate", F.lit(True)))
    return closed.join(known, key)


def calibrated(log: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weights of evidence from ``log`` (direction 1 or -1, won, dimensions): a dimension that spoke in enough trades, and agreed
    in enough, is scaled by how far its win rate is from that of all trades, twice, within 0.5 and 1.5; then weights are
    made to add up to 1. With too few trades they stay as they are."""
    weights = weights or WEIGHTS
    log = stored(log.select("direction", "won", "dimensions"), "learning-log")
    all_ = log.agg(F.count("*").alias("sample_size"), F.avg(F.col("won").cast("double")).alias("_rate"))
    said = log.select("direction", "won", F.explode("dimensions").alias("dimension", "score")).filter("score is not null and score != 0")
    agrees = F.signum("score") == F.col("direction")
    got = said.groupBy("dimension").agg(F.count("*").alias("relevant"), F.count_if(agrees).alias("agreeing"), F.count_if(agrees & F.col("won")).alias("_right"))
    base = log.sparkSession.createDataFrame(list(weights.items()), "dimension string, _base double")
    # a row for each dimension
    rows = base.join(F.broadcast(got), "dimension", "left").fillna(0, ["relevant", "agreeing", "_right"]).join(F.broadcast(all_))
    reliability = clamp(1 + (over(F.col("_right").cast("double"), F.col("agreeing").cast("double")) - F.col("_rate")) * 2, 0.5, 1.5)
    enough = (F.col("relevant") >= LEAST_RELEVANT) & (F.col("agreeing") >= LEAST_AGREEING)
    calibrated_ = F.col("sample_size") >= LEAST_TRADES
    rows = rows.withColumn("_raw", F.col("_base") * F.when(calibrated_ & enough, reliability).otherwise(1.0)).withColumn("calibrated", calibrated_)
    total = rows.agg(F.sum("_raw").alias("_all"))
    weight = F.when(calibrated_ & (F.col("_all") > 0), F.col("_raw") / F.col("_all")).otherwise(F.col("_raw"))
    return rows.join(F.broadcast(total)).select("dimension", "relevant", "agreeing", weight.alias("weight"), "calibrated", "sample_size")
