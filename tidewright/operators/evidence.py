"""Ladders of checks that end in a verdict, and what is measured of evidence."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import over

from .machines import CANDIDATE, rank

#: Codes of the tiers, maturities in order, least maturity and level for publication, blocks of replication.
CODES = {"None": "E0", "Weak": "E1", "Moderate": "E2", "Strong": "E3", "Extraordinary": "E4"}
MATURITIES = ("Prototype", "Experimental", "Stable", "Validated", "Production")
LEVEL, MATURITY, BLOCKS, BAND = 3, "Stable", 3, 2.0


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def randomness(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The verdict on a result (p_value, rejected, drift_state, canary_triggered, band_cleared, control); of the last four a
    null is a check that wasn't made. Without a p-value or a decision there is no verdict."""
    verdict = (
        F.when(F.col("p_value").isNull() | F.isnan("p_value") | F.col("rejected").isNull(), None)
        .when(F.col("p_value") > alpha, "ConsistentWithRandomness").when(~F.col("rejected"), "SelectionBiasOrMultipleTesting")
        .when(holds(F.col("drift_state") == "drifted") | holds(F.col("canary_triggered")) | holds(~F.col("band_cleared")), "StatisticalArtifact")
        .when(holds(F.col("control") == "FAIL"), "InsufficientEvidence").otherwise("GenuinePredictiveStructure")
    )
    made = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("p_value", "rejected", "drift_state", "canary_triggered", "band_cleared", "control")]
    return rows.withColumn("verdict", verdict).withColumn("checks", F.concat_ws(",", *made))


def positive_control(rows: DataFrame) -> DataFrame:
    """Whether a planted signal was recovered on the main run and the holdout, both of which must hold what was planted."""
    both, one = F.col("main_recovered") & F.col("holdout_recovered"), F.col("main_recovered") | F.col("holdout_recovered")
    usable = holds(F.col("main_verified")) & holds(F.col("holdout_verified"))
    return rows.withColumn("control", F.when(~usable, "NOT_EVALUATED").when(holds(both), "PASS").when(holds(one), "PARTIAL").otherwise("FAIL"))


def forensics(windows: DataFrame, others: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """The class of an effect from its p-values in ``windows`` (key, p_value) and those of ``others`` (key, tick_p, clock_p,
    coarse_p, fine_p; null where not supplied). At least two windows are needed, half of them significant."""
    small = lambda c: holds(F.col(c) < alpha) & ~F.isnan(c)
    each = windows.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(small("p_value")).alias("significant"))
    rows = others.join(each, key, "left").fillna({"windows": 0, "significant": 0}).withColumn("persistence", over(F.col("significant").cast("double"), F.col("windows").cast("double")))
    timing = F.col("tick_p").isNotNull() & F.col("clock_p").isNotNull() & small("clock_p") & ~small("tick_p")
    found = F.when(F.col("windows") < 2, "InsufficientEvidence").when(F.col("persistence") < 0.5, "FiniteSampleOrNonStationary").when(timing, "RngOrTimingArtifact").otherwise("GenuineStructure")
    rows = rows.withColumn("classification", found)
    note = F.when((found == "GenuineStructure") & F.col("coarse_p").isNotNull() & F.col("fine_p").isNotNull(), F.when(small("fine_p") & ~small("coarse_p"), "fine only").otherwise("stable"))
    return rows.withColumn("quantization", note)


def band(rows: DataFrame, lockbox: str, replication: str, error: str, z: float = BAND) -> DataFrame:
    """Whether the estimate from the lockbox lies within ``z`` standard errors of that of the replication."""
    rows = rows.withColumns({"deviation": F.abs(F.col(lockbox) - F.col(replication)), "band": F.col(error) * z})
    return rows.withColumn("band_cleared", F.col("deviation") <= F.col("band"))


def tiered(rows: DataFrame) -> DataFrame:
    """The evidence tier of a result, each tier on the one below, then its code. Access to data caps it at Moderate, and a
    randomness audit that failed takes it to None. Columns: discovered, blocks, all_reported, lockbox, band_cleared,
    question, out_of_domain, access_capped, audit_passed."""
    c = lambda n: holds(F.col(n))
    weak, moderate = c("discovered"), (F.col("blocks") >= BLOCKS) & c("all_reported")
    strong, extraordinary = c("lockbox") & c("band_cleared"), c("question") & (F.col("out_of_domain") >= 1)
    top = F.when(~weak, "None").when(~moderate, "Weak").when(~strong | c("access_capped"), "Moderate").when(~extraordinary, "Strong").otherwise("Extraordinary")
    rows = rows.withColumn("tier", F.when(~c("audit_passed"), "None").otherwise(top))
    return rows.withColumns({"tier_rank": rank(F.col("tier")), "code": code(F.col("tier"))})


def code(tier: Column) -> Column:
    """The code of a tier; E5 has no tier."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), tier)


def tier_of(code_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for t, c in CODES.items() for x in (c, t)]), code_)


def next_maturity(maturity: Column) -> Column:
    """The maturity after this one, null after the last or where it isn't one."""
    return F.get(F.array(*[F.lit(m) for m in MATURITIES]), rank(maturity, MATURITIES) + 1)


def reproducible(candidates: DataFrame, freezes: DataFrame, key: str) -> DataFrame:
    """The gate before publication: ``candidates`` (key, fingerprint, config_hash, ontology, generator, snapshot, level,
    maturity) against what was frozen (key, config_hash, ontology, generator, snapshot or null, fingerprints). The names of
    the checks that fail, in order."""
    f = freezes.select(key, *[F.col(c).alias(f"frozen_{c}") for c in freezes.columns if c != key], F.lit(True).alias("_frozen"))
    rows = candidates.join(f, key, "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"frozen_{c}"))
    checks = {
        "config": differs("config_hash"), "ontology": differs("ontology"), "generator": differs("generator"),
        "fingerprint": ~holds(F.array_contains("frozen_fingerprints", F.col("fingerprint"))), "snapshot": F.col("frozen_snapshot").isNotNull() & differs("snapshot"),
        "level": F.coalesce("level", F.lit(0)) < LEVEL, "maturity": F.coalesce(rank(F.col("maturity"), MATURITIES), F.lit(0)) < MATURITIES.index(MATURITY),
    }
    failures = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in checks.items()])
    rows = rows.withColumn("failures", F.when(F.col("_frozen").isNull(), "freeze").otherwise(failures))
    return rows.select(key, "failures", (F.col("failures") == "").alias("passed"))


def persistent(runs: DataFrame, family: str, order: str, least: int = 3) -> DataFrame:
    """Families whose newest ``least`` canary runs of enough sample (below_minimum_sample, material_divergence, direction)
    all diverge below the target."""
    w = Window.partitionBy(family).orderBy(F.desc(order))
    newest = runs.filter(~F.col("below_minimum_sample")).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= least)
    each = newest.groupBy(family).agg(F.count("*").alias("runs_considered"), F.min(holds(F.col("material_divergence") & (F.col("direction") == "below-target"))).alias("_all"))
    out = runs.select(family).distinct().join(each, family, "left").fillna({"runs_considered": 0})
    enough = F.col("runs_considered") >= least
    reason = F.when(~enough, "insufficient-history").when(F.col("_all"), "persistent-material-divergence").otherwise("not-persistent")
    return out.select(family, "runs_considered", (enough & holds(F.col("_all"))).alias("triggered"), reason.alias("reason"))


def stability(effects: DataFrame, key: str, effect: str, pooled: DataFrame) -> DataFrame:
    """How far the effects of parts agree with the pooled one (key, pooled): the share with the sign of most, times how near
    they are to it in size. A tie of signs goes to the pooled effect's; one part alone has no index."""
    rows = effects.join(pooled, key)
    near = F.abs(F.col(effect) - F.col("pooled")) / F.greatest(F.abs("pooled"), F.lit(1e-9))
    each = rows.groupBy(key).agg(
        F.count("*").alias("parts"), F.count_if(F.col(effect) > 0).alias("up"), F.count_if(F.col(effect) < 0).alias("down"), F.count_if(F.col(effect) == 0).alias("flat"),
        F.max("pooled").alias("pooled"), F.avg(near).alias("_off"),
    )
    sign = F.when(F.col("up") > F.col("down"), 1).when(F.col("up") < F.col("down"), -1).otherwise(F.signum("pooled").cast("int"))
    agreeing = F.when(sign == 1, F.col("up")).when(sign == -1, F.col("down")).otherwise(F.col("flat"))
    out = each.filter("parts >= 2").withColumns({"majority_sign": sign, "sign_agreement": agreeing / F.col("parts"), "magnitude_consistency": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_off")))})
    return out.withColumn("stability", F.col("sign_agreement") * F.col("magnitude_consistency")).select(key, "parts", "majority_sign", "sign_agreement", "magnitude_consistency", "stability")


def importance(rows: DataFrame) -> DataFrame:
    """Scientific and trading importance of candidates (stage, novelty, effect, stability, weight), null before
    confirmation and where a share isn't within 0 and 1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    fit = (rank(F.col("stage"), tuple(CANDIDATE)) >= list(CANDIDATE).index("Confirmed")) & F.col("effect").isNotNull() & ~F.isnan("effect")
    for c in ("novelty", "stability", "weight"):
        fit = fit & F.col(c).between(0, 1)
    size = F.abs("effect") / (F.abs("effect") + 1)
    return rows.withColumns({
        "scientific_importance": F.when(fit, clamp(0.5 * F.col("novelty") + 0.3 * F.col("weight") + 0.2 * F.col("stability"))),
        "trading_importance": F.when(fit, clamp(0.6 * size + 0.4 * F.col("stability"))),
    })


def wald(rows: DataFrame, estimate: str, error: str, level: float = 0.95) -> DataFrame:
    """The normal interval about an estimate."""
    z = abs(NormalDist().inv_cdf(1 - (1 - level) / 2))
    return rows.withColumns({"ci_lower": F.col(estimate) - z * F.col(error), "ci_upper": F.col(estimate) + z * F.col(error)})


