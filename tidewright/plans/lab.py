"""Queries over the laboratory's ledgers, ladders and graph. Their inputs are made from columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import campaign as cp
from tidewright.operators import evidence as ev
from tidewright.operators import graph as gr
from tidewright.operators import machines as mc
from tidewright.sources.ticks import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(values: tuple, number: str):
    """The value at ``number``, an SQL expression, counted from 0 and round again."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"int(({number}) % {len(values)})"))


def sql_pick(values: tuple, number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(({number}) % {len(values)})::int + 1]"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as numbered moves of a hypothesis."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hypothesis"), F.col("o_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("n"))


#: In SQL a machine is walked move by move; what leads where is written out as rows, not looked up in the engine's tables.
_N = "m as (select o_custkey as hypothesis, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders)"
_STAGE = "case when k % 7 = 0 then n * 7 // 10 + 1 else n * 7 // 10 end"
_STAGES = "['Registration', 'FeatureGeneration', 'Discovery', 'Replication', 'Lockbox', 'Publication', 'Retirement', 'Archive']"
_LIFE = f"""{_N}, t as (select *, {_STAGES}[least(7, {_STAGE}) + 1] as "to", least(7, {_STAGE}) as i, k % 2 = 0 as again from m),
f as (select hypothesis, k, n, "to", null::varchar as "from", i = 0 as valid, case when i = 0 then 0 else -1 end as at, case when i = 0 then 1 else 0 end as done from t where n = 0
  union all select t.hypothesis, t.k, t.n, t."to", {_STAGES}[case when f.at >= 0 then f.at + 1 end], t.i = f.at + 1 or (t.again and t.i = f.at and t.i in (2, 3)),
    case when t.i = f.at + 1 or (t.again and t.i = f.at and t.i in (2, 3)) then t.i else f.at end, f.done + (t.i = f.at + 1 or (t.again and t.i = f.at and t.i in (2, 3)))::int
  from t join f on f.hypothesis = t.hypothesis and t.n = f.n + 1)"""


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    i = F.least(F.lit(7), F.floor(F.col("n") * 7 / 10) + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("to", F.get(F.array(*[F.lit(s) for s in mc.LIFECYCLE]), i)).drop("n")
    return mc.lifecycle(rows, "hypothesis", "k", "to", F.col("k") % 2 == 0)


@query(f"""with recursive {_LIFE} select hypothesis, k, "to", "from", valid, case when valid then done - 1 end as seq, case when not valid then 'transition' end as refused from f""")
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where hypotheses move through their stages, repeats and leaps among the moves."""
    return _lifecycle(spark, sf_dir)


_CAND = ("Generated", "Screened", "Triaged", "Confirmed", "Replicated", "Published")


@query(f"""with recursive {_N}, t as (select *, case when k % 11 = 0 and n > 1 then 6 else least(5, n * 8 // 10) end as i from m),
f as (select hypothesis, k, n, i, null::int as was, i = 0 as valid, case when i = 0 then 0 else -1 end as at, (i = 0)::int as done from t where n = 0
  union all select t.hypothesis, t.k, t.n, t.i, case when f.at >= 0 then f.at end, t.i = f.at + 1 or (t.i = 6 and f.at between 0 and 5), case when t.i = f.at + 1 or (t.i = 6 and f.at between 0 and 5) then t.i else f.at end,
    f.done + (t.i = f.at + 1 or (t.i = 6 and f.at between 0 and 5))::int from t join f on f.hypothesis = t.hypothesis and t.n = f.n + 1)
select hypothesis as candidate, k, {list(_CAND) + ['Deprecated']}[i + 1] as "to", {list(_CAND) + ['Deprecated']}[was + 1] as "from", valid, case when valid then done - 1 end as seq, case when not valid then 'transition' end as refused from f""")
def candidate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    to = F.when((F.col("k") % 11 == 0) & (F.col("n") > 1), F.lit("Deprecated")).otherwise(F.get(F.array(*[F.lit(s) for s in _CAND]), F.least(F.lit(5), F.floor(F.col("n") * 8 / 10)).cast("int")))
    return mc.candidate_lifecycle(rows.withColumn("to", to).drop("n").withColumnRenamed("hypothesis", "candidate"), "candidate", "k", "to")


#: The publication table as rows of SQL, and what each status asks.
_PUB = """ed(a, b) as (values ('ProvisionallySupported', 'Replicated'), ('ProvisionallySupported', 'Rejected'), ('ProvisionallySupported', 'Indeterminate'), ('Indeterminate', 'Rejected'), ('Rejected', 'Retired'), ('Refuted', 'Retired'),
  ('Replicated', 'Supported'), ('Replicated', 'Rejected'), ('Supported', 'Published'), ('Supported', 'Deprecated'), ('Published', 'Operational'), ('Published', 'Deprecated'), ('Published', 'Retired'), ('Operational', 'Deprecated'),
  ('Deprecated', 'Retired'), ('Retired', 'Archived'), ('-', 'ProvisionallySupported'), ('-', 'Rejected'), ('-', 'Indeterminate'), ('-', 'Refuted'))"""
_PATH = ("ProvisionallySupported", "Replicated", "Supported", "Published", "Operational", "Deprecated", "Retired", "Archived")
_ODD = ("Rejected", "Indeterminate", "Refuted")
_EST = ("validation", "replication", "lockbox", "selection", "operational")
_MOVES = f"""{_N}, q as (select *, case when k % 13 = 0 then {sql_pick(_ODD, 'k // 13')} else {list(_PATH)}[least(7, n * 6 // 10) + 1] end as "to", case when k % 5 = 0 then k // 5 % 5 else 3 + k % 2 end as tier, k % 3 = 0 as question, k % 4 > 0 as report, k % 6 > 0 as monitored,
  k % 2 = 0 as approved, k % 17 = 0 as contradicted, case when k % 3 > 0 then 'lockbox' else {sql_pick(_EST, 'k // 3')} end as estimate, case when k % 2 = 0 then 'replication' end as beside from m),
r as (select *, estimate in ('replication', 'lockbox', 'operational') or (estimate = 'validation' and coalesce(beside, '') in ('replication', 'lockbox')) as shown from q),
t as (select *, case "to" when 'ProvisionallySupported' then tier >= 1 and shown when 'Replicated' then tier >= 2 and shown when 'Supported' then tier >= 3 and shown when 'Published' then report and tier >= (case when question then 4 else 3 end) and estimate = 'lockbox'
  when 'Operational' then monitored when 'Indeterminate' then approved when 'Refuted' then approved or contradicted else true end as met from r),
f as (select t.hypothesis, t.k, t.n, t."to", '-' as was, ed.b is not null as leads, ed.b is not null and t.met as valid, case when ed.b is not null and t.met then t."to" else '-' end as at, (ed.b is not null and t.met)::int as done from t left join ed on ed.a = '-' and ed.b = t."to" where n = 0
  union all select t.hypothesis, t.k, t.n, t."to", f.at, ed.b is not null, ed.b is not null and t.met, case when ed.b is not null and t.met then t."to" else f.at end, f.done + (ed.b is not null and t.met)::int
  from t join f on f.hypothesis = t.hypothesis and t.n = f.n + 1 left join ed on ed.a = f.at and ed.b = t."to")"""


def _publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    path = F.get(F.array(*[F.lit(s) for s in _PATH]), F.least(F.lit(7), F.floor(F.col("n") * 6 / 10)).cast("int"))
    to = F.when(F.col("k") % 13 == 0, pick(_ODD, "floor(k / 13)")).otherwise(path)
    tier = F.get(F.array(*[F.lit(x) for x in mc.TIERS]), F.when(F.col("k") % 5 == 0, F.floor(F.col("k") / 5) % 5).otherwise(3 + F.col("k") % 2).cast("int"))
    k = F.col("k")
    meets = mc.publication_requirement(
        to, tier, k % 3 == 0, k % 4 > 0, k % 6 > 0, k % 2 == 0, k % 17 == 0, F.when(k % 3 > 0, F.lit("lockbox")).otherwise(pick(_EST, "floor(k / 3)")), F.when(k % 2 == 0, "replication")
    )
    rows = rows.withColumn("to", to).withColumn("meets", meets)
    return mc.publication(rows, "hypothesis", "k", "to", F.col("meets")).drop("n", "meets")


@query(f"""with recursive {_PUB}, {_MOVES} select hypothesis, k, "to", nullif(was, '-') as "from", valid, case when valid then done - 1 end as seq, case when not valid then case when leads then 'requirement' else 'transition' end end as refused from f""")
def publication_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of publications with the evidence that each status asks for."""
    return _publication(spark, sf_dir)


_NOW = 1_700_000_000_000


@query(f"""with recursive {_PUB}, {_MOVES}, v as (select hypothesis, k, "to", was, {_NOW} - k * 3600000 as at_ms from f where valid),
e as (select hypothesis, max(("to" = 'ProvisionallySupported')::int) as found, max((was = 'ProvisionallySupported')::int) as attempted, max((was = 'ProvisionallySupported' and "to" = 'Replicated')::int) as replicated, max(("to" = 'Indeterminate')::int) as ind,
  arg_max("to", k) as now, arg_max(at_ms, k) as since from v group by 1),
j as (select c_mktsegment as family, e.*, case when now in ('ProvisionallySupported', 'Replicated', 'Deprecated') and {_NOW} - since > 2592000000 then {_NOW} - since end as dwell from customer left join e on hypothesis = c_custkey)
select family, count(*) as hypotheses, round(count(*) filter (found = 1) / count(*), 6) as discovery_yield, round(count(*) filter (replicated = 1) / nullif(count(*) filter (attempted = 1), 0), 6) as replication_yield, round(count(*) filter (ind = 1) / nullif(count(now), 0), 6) as indeterminate_rate,
  round(count(*) filter (coalesce(now not in ('Rejected', 'Refuted'), true)) / count(*), 6) as survival_rate, count(dwell) as debt_count, coalesce(sum(dwell), 0)::bigint as debt_ms from j group by 1""")
def metascience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields, rates and debt of each family, from the moves that were valid."""
    moves = _publication(spark, sf_dir).filter("valid").withColumn("at_ms", F.lit(_NOW) - F.col("k") * 3600000)
    owners = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("hypothesis"))
    return rounded(mc.metascience(moves, owners, "family", "hypothesis", "k", "to", "at_ms", _NOW))


_FAM = "['Active', 'Rejected', 'Active', 'Replicated', 'Retired', 'Active']"


@query(f"""with recursive ed(a, b) as (values ('-', 'Active'), ('Active', 'Rejected'), ('Active', 'Replicated'), ('Active', 'Retired'), ('Rejected', 'Active'), ('Rejected', 'Retired'), ('Replicated', 'Retired')),
{_N}, t as (select *, {_FAM}[n % 6 + 1] as "to", case when k % 3 = 0 then 'NewData' when k % 3 = 1 then 'Again' end as why from m),
f as (select t.hypothesis, t.k, t.n, t."to", t.why, '-' as was, "to" = 'Active' as leads, "to" = 'Active' as valid, case when "to" = 'Active' then 'Active' else '-' end as at, ("to" = 'Active')::int as done from t where n = 0
  union all select t.hypothesis, t.k, t.n, t."to", t.why, f.at, ed.b is not null, ed.b is not null and (f.at <> 'Rejected' or t."to" <> 'Active' or coalesce(t.why = 'NewData', false)),
    case when ed.b is not null and (f.at <> 'Rejected' or t."to" <> 'Active' or coalesce(t.why = 'NewData', false)) then t."to" else f.at end, f.done + (ed.b is not null and (f.at <> 'Rejected' or t."to" <> 'Active' or coalesce(t.why = 'NewData', false)))::int
  from t join f on f.hypothesis = t.hypothesis and t.n = f.n + 1 left join ed on ed.a = f.at and ed.b = t."to")
select hypothesis as family, k, "to", why, nullif(was, '-') as "from", valid, case when valid then done - 1 end as seq, case when not valid then case when leads then 'requirement' else 'transition' end end as refused from f""")
def family_status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("to", F.get(F.array(*[F.lit(s) for s in ("Active", "Rejected", "Active", "Replicated", "Retired", "Active")]), (F.col("n") % 6).cast("int")))
    rows = rows.withColumn("why", F.when(F.col("k") % 3 == 0, "NewData").when(F.col("k") % 3 == 1, "Again")).drop("n").withColumnRenamed("hypothesis", "family")
    return mc.family_status(rows, "family", "k", "to", "why")


# verdicts and tiers

_AUDIT = """a as (select p_partkey as id, case when p_partkey % 29 = 0 then null else p_partkey * 37 % 1000 / 10000 end as p, p_partkey % 5 > 0 as rejected, case p_partkey % 7 when 0 then 'drifted' when 1 then null else 'stable' end as drift, case when p_partkey % 3 = 0 then p_partkey % 9 = 0 end as canary,
  case when p_partkey % 2 = 0 then p_partkey % 8 > 0 end as band, case p_partkey % 6 when 0 then 'FAIL' when 1 then 'PASS' end as control from part)"""


@query(f"""with {_AUDIT} select id, case when p is null then null when p > 0.05 then 'ConsistentWithRandomness' when not rejected then 'SelectionBiasOrMultipleTesting' when drift = 'drifted' or canary or not band then 'StatisticalArtifact'
  when control = 'FAIL' then 'InsufficientEvidence' else 'GenuinePredictiveStructure' end as verdict, array_to_string(list_filter([case when p is not null then 'p_value' end, 'rejected', case when drift is not null then 'drift_state' end, case when canary is not null then 'canary_triggered' end,
  case when band is not null then 'band_cleared' end, case when control is not null then 'control' end], lambda x: x is not null), ',') as checks from a""")
def randomness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).withColumns({
        "p_value": F.when(k % 29 != 0, k * 37 % 1000 / 10000), "rejected": k % 5 > 0, "drift_state": F.when(k % 7 == 0, "drifted").when(k % 7 > 1, "stable"), "canary_triggered": F.when(k % 3 == 0, k % 9 == 0),
        "band_cleared": F.when(k % 2 == 0, k % 8 > 0), "control": F.when(k % 6 == 0, "FAIL").when(k % 6 == 1, "PASS"),
    })
    return ev.randomness(rows).select("id", "verdict", "checks")


@query("""with a as (select p_partkey as id, p_partkey % 5 > 0 as mv, case when p_partkey % 3 > 0 then p_partkey % 2 = 0 end as mr, p_partkey % 7 > 0 as hv, p_partkey % 4 > 1 as hr from part)
select id, case when not (mv and hv) then 'NOT_EVALUATED' when mr and hr then 'PASS' when mr or hr then 'PARTIAL' else 'FAIL' end as control from a""")
def positive_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).withColumns({"main_verified": k % 5 > 0, "main_recovered": F.when(k % 3 > 0, k % 2 == 0), "holdout_verified": k % 7 > 0, "holdout_recovered": k % 4 > 1})
    return ev.positive_control(rows).select("id", "control")


@query("""with w as (select l_orderkey as id, count(*) as n, count(*) filter (l_discount < 0.05) as s from lineitem group by 1),
o as (select o_orderkey as id, coalesce(n, 0) as windows, coalesce(s, 0) as significant, case when o_orderkey % 3 > 0 then o_custkey % 20 / 100 end as tick_p, case when o_orderkey % 4 > 0 then o_orderkey % 10 / 100 end as clock_p,
  case when o_orderkey % 5 > 0 then o_custkey % 10 / 100 end as coarse_p, o_orderkey % 9 / 100 as fine_p from orders left join w on w.id = o_orderkey),
c as (select *, case when windows < 2 then 'InsufficientEvidence' when significant / windows < 0.5 then 'FiniteSampleOrNonStationary' when clock_p < 0.05 and tick_p >= 0.05 then 'RngOrTimingArtifact' else 'GenuineStructure' end as classification from o)
select id, windows, significant, round(significant / nullif(windows, 0), 6) as persistence, classification, case when classification = 'GenuineStructure' and coarse_p is not null then case when fine_p < 0.05 and coarse_p >= 0.05 then 'fine only' else 'stable' end end as quantization from c""")
def rng_forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").cast("double").alias("p_value"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    others = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 > 0, c % 20 / 100).alias("tick_p"), F.when(k % 4 > 0, k % 10 / 100).alias("clock_p"), F.when(k % 5 > 0, c % 10 / 100).alias("coarse_p"), (k % 9 / 100).alias("fine_p")
    )
    return rounded(ev.forensics(windows, others, "id").select("id", "windows", "significant", "persistence", "classification", "quantization"))


_TIER = """b as (select p_partkey as id, abs(p_retailprice - p_size * 30) as deviation, p_size * 2.0 * 20 as band from part),
t as (select id, deviation, band, deviation <= band as cleared, case when id % 11 = 0 or id % 7 = 0 then 'None' when not (id % 5 > 1 and id % 3 > 0) then 'Weak' when not (id % 4 > 0 and deviation <= band) or id % 13 = 0 then 'Moderate' when not (id % 2 = 0 and id % 6 > 1) then 'Strong' else 'Extraordinary' end as tier from b)"""


@query(f"""with {_TIER}, r(tier, tier_rank, code) as (values ('None', 0, 'E0'), ('Weak', 1, 'E1'), ('Moderate', 2, 'E2'), ('Strong', 3, 'E3'), ('Extraordinary', 4, 'E4'))
select id, round(deviation::double, 6) as deviation, round(band::double, 6) as band, cleared as band_cleared, tier, tier_rank, code, tier as back, case tier when 'None' then 'Experimental' when 'Weak' then 'Stable' when 'Moderate' then 'Validated' when 'Strong' then 'Production' end as next_maturity from t join r using (tier)""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("a"), (F.col("p_size") * 30.0).alias("b"), (F.col("p_size") * 20.0).alias("se"))
    rows = ev.band(rows, "a", "b", "se").withColumns({
        "discovered": k % 7 != 0, "blocks": F.when(k % 5 > 1, 3).otherwise(2), "all_reported": k % 3 > 0, "lockbox": k % 4 > 0, "question": k % 2 == 0, "out_of_domain": F.when(k % 6 > 1, 1).otherwise(0),
        "access_capped": k % 13 == 0, "audit_passed": k % 11 != 0,
    })
    rows = ev.tiered(rows).withColumn("back", ev.tier_of(F.col("code"))).withColumn("next_maturity", ev.next_maturity(F.get(F.array(*[F.lit(m) for m in ev.MATURITIES]), F.col("tier_rank"))))
    return rounded(rows.select("id", "deviation", "band", "band_cleared", "tier", "tier_rank", "code", "back", "next_maturity"))


@query("""with f as (select s_suppkey as id, 'h' || s_suppkey % 5 as h, 'o1' as o, 'g' || s_suppkey % 2 as g, case when s_suppkey % 3 > 0 then 's' || s_suppkey % 4 end as s, ['f' || s_suppkey, 'f' || (s_suppkey + 1)] as fp from supplier where s_suppkey % 10 > 0),
c as (select s_suppkey as id, 'f' || (s_suppkey + s_suppkey % 4) as fp, 'h' || (s_suppkey + (s_suppkey % 9 = 0)::int) % 5 as h, 'o' || (1 + (s_suppkey % 8 = 0)::int) as o, 'g0' as g, 's' || s_suppkey % 4 as s, case when s_suppkey % 6 > 0 then s_suppkey % 6 end as level, ['Prototype', 'Experimental', 'Stable', 'Validated', 'Production'][s_suppkey % 5 + 1] as m from supplier)
select c.id, case when f.id is null then 'freeze' else array_to_string(list_filter([case when c.h is distinct from f.h then 'config' end, case when c.o <> f.o then 'ontology' end, case when c.g <> f.g then 'generator' end, case when not list_contains(f.fp, c.fp) then 'fingerprint' end,
  case when f.s is not null and c.s is distinct from f.s then 'snapshot' end, case when coalesce(c.level, 0) < 3 then 'level' end, case when c.m in ('Prototype', 'Experimental') then 'maturity' end], lambda x: x is not null), ',') end as failures,
  failures = '' as passed from c left join f on f.id = c.id""")
def reproducibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    frozen = s.filter("s_suppkey % 10 > 0").select(
        k.alias("id"), name("h", k % 5).alias("config_hash"), F.lit("o1").alias("ontology"), name("g", k % 2).alias("generator"), F.when(k % 3 > 0, name("s", k % 4)).alias("snapshot"), F.array(name("f", k), name("f", k + 1)).alias("fingerprints")
    )
    candidates = s.select(
        k.alias("id"), name("f", k + k % 4).alias("fingerprint"), name("h", (k + (k % 9 == 0).cast("int")) % 5).alias("config_hash"), name("o", 1 + (k % 8 == 0).cast("int")).alias("ontology"), F.lit("g0").alias("generator"),
        name("s", k % 4).alias("snapshot"), F.when(k % 6 > 0, k % 6).alias("level"), pick(ev.MATURITIES, "s_suppkey").alias("maturity"),
    )
    return ev.reproducible(candidates, frozen, "id")


@query("""with r as (select c_nationkey as family, c_custkey as seq, c_custkey % 4 = 0 as small, c_acctbal < 7000 as material, case when c_acctbal < 8000 then 'below-target' else 'above-target' end as way from customer),
n as (select *, row_number() over (partition by family order by seq desc) as k from r where not small), e as (select family, count(*) as n, bool_and(material and way = 'below-target') as every_one from n where k <= 3 group by 1)
select f.family, coalesce(n, 0) as runs_considered, coalesce(n >= 3 and every_one, false) as triggered, case when coalesce(n, 0) < 3 then 'insufficient-history' when every_one then 'persistent-material-divergence' else 'not-persistent' end as reason from (select distinct family from r) f left join e on e.family = f.family""")
def canary_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 4 == 0).alias("below_minimum_sample"), (F.col("c_acctbal") < 7000).alias("material_divergence"),
        F.when(F.col("c_acctbal") < 8000, "below-target").otherwise("above-target").alias("direction"),
    )
    return ev.persistent(runs, "family", "seq")


@query("""with e as (select l_suppkey as id, l_discount - 0.045 as x from lineitem), p as (select s_suppkey as id, (s_suppkey % 7 - 3) / 100 as pooled from supplier),
j as (select e.id, x::double as x, pooled from e join p using (id)), a as (select id, count(*) as parts, count(*) filter (x > 0) as up, count(*) filter (x < 0) as down, count(*) filter (x = 0) as flat, max(pooled) as pooled, avg(abs(x - pooled) / greatest(abs(pooled), 1e-9)) as off from j group by 1),
s as (select *, case when up > down then 1 when down > up then -1 else sign(pooled) end::int as g, greatest(0, least(1, 1 - off)) as m from a where parts >= 2), t as (select *, (case g when 1 then up when -1 then down else flat end) / parts as share from s)
select id, parts, g as majority_sign, round(share, 6) as sign_agreement, round(m, 6) as magnitude_consistency, round(share * m, 6) as stability from t""")
def discovery_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_discount").cast("decimal(12,3)") - F.expr("0.045")).cast("double").alias("x"))
    pooled = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 7 - 3) / 100).alias("pooled"))
    return rounded(ev.stability(effects, "id", "x", pooled))


@query("""with a as (select p_partkey as id, p_size % 7 as stage, p_partkey % 12 / 10 as novelty, (p_retailprice - 1200) / 100 as effect, p_partkey % 10 / 10 as stability, p_size / 50 as weight from part)
select id, case when stage between 3 and 6 and novelty <= 1 then round(least(1, 0.5 * novelty + 0.3 * weight + 0.2 * stability)::double, 6) end as scientific_importance, case when stage between 3 and 6 and novelty <= 1 then round(least(1, 0.6 * (abs(effect) / (abs(effect) + 1)) + 0.4 * stability)::double, 6) end as trading_importance from a""")
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), pick(tuple(mc.CANDIDATE), "p_size").alias("stage"), (k % 12 / 10).alias("novelty"), ((F.col("p_retailprice").cast("double") - 1200) / 100).alias("effect"), (k % 10 / 10).alias("stability"), (F.col("p_size") / 50).alias("weight")
    )
    return rounded(ev.importance(rows).select("id", "scientific_importance", "trading_importance"))


@query("""with a as (select l_suppkey as id, avg(l_discount)::double as estimate, stddev_samp(l_discount) / sqrt(count(*)) as se, count(*) as n from lineitem group by 1),
b as (select *, ['selection', 'validation', 'replication', 'lockbox', 'operational', 'other'][id % 6 + 1] as estimate_type, case id % 4 when 0 then 'replication' when 1 then 'selection' end as beside from a)
select id, round(estimate, 6) as estimate, round(se, 6) as se, round(estimate - 1.959963984540054 * se, 6) as ci_lower, round(estimate + 1.959963984540054 * se, 6) as ci_upper, estimate_type, beside,
  case estimate_type when 'validation' then coalesce(beside, '') in ('replication', 'lockbox') when 'selection' then false when 'other' then false else true end as reportable, estimate_type = 'lockbox' as publishable from b""")
def reportable_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_discount").cast("double").alias("x"))
    rows = rows.groupBy("id").agg(F.avg("x").alias("estimate"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"))
    rows = rows.withColumn("estimate_type", pick(("selection", "validation", "replication", "lockbox", "operational", "other"), "id")).withColumn("beside", F.when(F.col("id") % 4 == 0, "replication").when(F.col("id") % 4 == 1, "selection"))
    rows = ev.wald(rows, "estimate", "se").withColumns({"reportable": mc.reportable(F.col("estimate_type"), F.col("beside")), "publishable": F.col("estimate_type") == "lockbox"})
    return rounded(rows)


# the campaign

@query("""with s as (select p_partkey, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey) as r, count(*) over () as n from part), c as (select p_partkey as id, 'H' || p_partkey as hypothesis from s where r <= greatest(1, ceil(n * 0.5)))
select id, p_size::double as effect, case when p_size >= 10 then null else 'effect' end as short, array_to_string(list_filter(['normality', 'stationarity'], lambda x: not list_contains(case when id % 3 = 0 then ['normality'] when id % 3 = 1 then ['stationarity', 'normality', 'other'] else ['stationarity', 'normality'] end, x)), ',') as missing,
  p_size >= 10 and id % 3 > 0 as promoted from c join part on p_partkey = id""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened candidates against the least effect and the diagnostics that the plan asks for."""
    c = cp.best(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), F.col("p_size").cast("double").alias("effect")), "score", "id", 0.5)
    passed = F.when(F.col("id") % 3 == 0, F.array(F.lit("normality"))).when(F.col("id") % 3 == 1, F.array(*[F.lit(x) for x in ("stationarity", "normality", "other")])).otherwise(F.array(F.lit("stationarity"), F.lit("normality")))
    return cp.triaged(c.withColumn("passed", passed), 10.0, ["normality", "stationarity"]).select("id", "effect", "short", "missing", "promoted")


_ROUNDS = """s as (select p_partkey as id, p_brand as family, row_number() over (order by p_retailprice desc, p_partkey) as r, count(*) over () as n from part), one as (select id, family from s where r <= greatest(1, ceil(n * 0.5))),
two as (select id, family, id % 40 / 1000 as deep from one where id * 31 % 100 / 1000 < 0.05), m as (select *, row_number() over (partition by family order by id) as k from two),
w as (select id, family, k, deep, 0.0125::double as bid, deep <= 0.0125 as found, 0.0125::double + case when deep <= 0.0125 then 0.025::double else 0::double end as wealth from m where k = 1
  union all select m.id, m.family, m.k, m.deep, w.wealth * 0.5::double, m.deep <= w.wealth * 0.5::double, w.wealth * 0.5::double + case when m.deep <= w.wealth * 0.5::double then 0.025::double else 0::double end from m join w on w.family = m.family and m.k = w.k + 1)"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("family"), F.col("p_retailprice").alias("score"), (k * 31 % 100 / 1000).alias("p"), (k % 40 / 1000).alias("deep_p"))
    return cp.rounds(c, "family", "id", "score", "p", "deep_p", 0.5)


@query(f"""with recursive {_ROUNDS} select p_partkey as id, p_brand as family, case when w.found then 4 when w.id is not null then 3 when one.id is not null then 2 else 1 end as round, case when w.found then 'replicated' when w.id is not null then 'screenedNotPromoted' when one.id is not null then 'untested' else 'rejected' end as outcome,
  round(w.bid, 6) as alpha_spent, case when w.found then 'lb' || p_partkey end as lockbox from part left join one on one.id = p_partkey left join w on w.id = p_partkey""")
def campaign_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each candidate comes in the four rounds: screening, a test, the family's wealth, the lockbox."""
    return rounded(_rounds(spark, sf_dir).select("id", "family", "round", "outcome", "alpha_spent", "lockbox"))


@query(f"""with recursive {_ROUNDS} select 1 as round, (select count(*) from part) as evaluated, (select count(*) from one) as promoted union all select 2, (select count(*) from one), (select count(*) from w)
union all select 3, (select count(*) from w), (select count(*) from w where found) union all select 4, (select count(*) from w where found), (select count(*) from w where found)""")
def campaign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.round_metrics(_rounds(spark, sf_dir))


@query("""with recursive m as (select c_mktsegment as family, o_orderkey as k, row_number() over (partition by c_mktsegment order by o_orderkey) as n, o_orderkey * 7 % 1000 / 50000 as p from orders join customer on c_custkey = o_custkey),
w as (select family, n, 0.0125::double + case when p <= 0.0125 then 0.025::double else 0::double end as wealth from m where n = 1 union all select m.family, m.n, w.wealth * 0.5::double + case when m.p <= w.wealth * 0.5::double then 0.025::double else 0::double end from m join w on w.family = m.family and m.n = w.n + 1),
l as (select family, arg_max(wealth, n) as wealth from w group by 1), f as (select distinct c_mktsegment as family from customer)
select coalesce(f.family, 'all') as family, round(sum(coalesce(l.wealth, 0.025)), 6) as wealth from f left join l on l.family = f.family group by rollup (f.family)""")
def wealth_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each family has left to spend, and all together; one that tested nothing has what it began with."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("family")), "o_custkey")
    tests = o.select("family", F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7 % 1000 / 50000).alias("p"))
    families = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family")).distinct()
    return rounded(cp.remaining(tests, families, "family", "k", "p"))


@query("""with recursive t as (select o_orderkey as k, o_custkey as hypothesis, c_mktsegment as family, case when o_orderkey % 4 > 0 then o_orderkey % 12 end as experiment, o_orderkey * 13 % 1000 / 40000 as p, case when o_custkey % 6 > 0 then 'Discovery' end as stage from orders join customer on c_custkey = o_custkey),
r as (select *, case when stage is null then 'NotRegistered' when experiment is not null and experiment % 5 in (0, 4) then 'IncompleteManifest' end as refused from t), m as (select *, row_number() over (partition by family order by k) as n from r where refused is null),
w as (select family, k, n, 0.0125::double as alpha_spent, p <= 0.0125::double as rejected, 0.0125::double + case when p <= 0.0125::double then 0.025::double else 0::double end as wealth from m where n = 1
  union all select m.family, m.k, m.n, w.wealth * 0.5::double, m.p <= w.wealth * 0.5::double, w.wealth * 0.5::double + case when m.p <= w.wealth * 0.5::double then 0.025::double else 0::double end from m join w on w.family = m.family and m.n = w.n + 1)
select r.k, r.hypothesis, r.family, r.stage, r.refused, round(w.alpha_spent, 9) as alpha_spent, w.rejected from r left join w on w.family = r.family and w.k = r.k""")
def discovery_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on tests of registered hypotheses with complete manifests; manifests 0 and 4 of each five are incomplete or
    missing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    families = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hypothesis"), F.col("c_mktsegment").alias("family"))
    tests = table(spark, sf_dir, "orders").select(k.alias("k"), c.alias("hypothesis"), F.when(k % 4 > 0, k % 12).alias("experiment"), (k * 13 % 1000 / 40000).alias("p")).join(families, "hypothesis")
    registered = families.filter("hypothesis % 6 > 0").select("hypothesis", F.lit("Discovery").alias("stage"))
    manifests = spark.range(12).filter("id % 5 < 4").select(F.col("id").alias("experiment"), (F.col("id") % 5 > 0).alias("complete"))
    return rounded(cp.decided(tests, registered, manifests, "family", "k", "p").select("k", "hypothesis", "family", "stage", "refused", "alpha_spent", "rejected"), places=9)


@query("""with a as (select avg(l_extendedprice) as m, stddev_pop(l_quantity) / sqrt(count(*)) as h from lineitem), g as (select unnest(range(5, 50, 5))::double as "at"), w as (select "at", exp(-0.5::double * (((l_quantity - "at") / h) ** 2)) as w, l_extendedprice / 1000 as y from lineitem, a, g),
s as (select "at", sum(w * y) / sum(w) as mean, sum(w * y * y) / sum(w) as q from w group by 1), v as (select "at", mean, greatest(q - mean * mean, 0) as variance from s)
select 'active_learning' as method, (select "at" from v order by round(variance, 6) desc, "at" limit 1) as "at" union all select 'bayesian', (select "at" from v order by round(mean + 1.96::double * sqrt(variance), 6) desc, "at" limit 1)""")
def next_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators import discovery as ds

    seen = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return cp.next_points(rounded(ds.surrogate(seen, spark.range(5, 50, 5).select(F.col("id").cast("double").alias("x")), "x", "y")))


# the knowledge graph: families are nations, versions parts, campaigns customers, hypotheses suppliers

def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")

    def nodes(df, kind, prefix, key, label=None, family=None, tier=None):
        kind = kind if not isinstance(kind, str) else F.lit(kind)
        return df.select(name(prefix, key).alias("id"), kind.alias("node_type"), F.col(key).cast("string").alias("ref"), (label if label is not None else none).alias("label"), (family if family is not None else none).alias("family"), (tier if tier is not None else none).alias("tier"))

    def edges(df, kind, a, b, seq, note=None):
        return df.select(F.lit(kind).alias("edge_type"), a.alias("from_node"), b.alias("to_node"), F.col(seq).cast("long").alias("seq"), (note if note is not None else none).alias("note"))

    o = t("orders").withColumn("s", F.col("o_orderkey") % 97 + 1)
    all_nodes = [
        nodes(t("nation"), "representationFamily", "F", "n_nationkey", F.col("n_name")), nodes(t("part"), "searchSpaceVersion", "V", "p_partkey", F.col("p_name")), nodes(t("part"), "feature", "P", "p_partkey", family=F.col("p_brand")),
        nodes(t("customer"), F.when(F.col("c_custkey") % 2 == 0, "discoveryCampaign").otherwise("replicationCampaign"), "C", "c_custkey", F.col("c_name"), F.when(F.col("c_custkey") % 9 > 0, name("F", "c_nationkey"))),
        nodes(t("supplier"), "hypothesis", "H", "s_suppkey"), nodes(t("orders"), "evidenceSummary", "E", "o_orderkey", tier=pick(mc.TIERS, "o_custkey")),
    ]
    li = t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    all_edges = [
        edges(li, "implements", name("P", "l_partkey"), F.concat(F.lit("M"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")), "k"),
        edges(t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("k")), "tests", F.concat(F.lit("M"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")), name("H", "l_suppkey"), "k"),
        edges(t("supplier").filter("s_acctbal < 2000"), "screenedNotPromoted", name("H", "s_suppkey"), name("F", "s_nationkey"), "s_suppkey", F.lit("round 3")), edges(t("supplier"), "instanceOfFamily", name("H", "s_suppkey"), name("F", "s_nationkey"), "s_suppkey"),
        edges(li.filter("l_quantity > 48"), "generatedFrom", name("H", "l_suppkey"), name("V", "l_partkey"), "k"), edges(o.filter("o_orderkey % 3 = 0"), "summarizes", name("E", "o_orderkey"), name("H", "s"), "o_orderkey"),
        edges(o.filter("o_custkey % 2 = 1"), "replicatedIn", name("H", "s"), name("C", "o_custkey"), "o_orderkey"), edges(o.filter("o_custkey % 2 = 0"), "memberOfCampaign", name("H", "s"), name("C", "o_custkey"), "o_orderkey"),
    ]
    join = lambda xs: __import__("functools").reduce(DataFrame.unionByName, xs)
    return join(all_nodes), join(all_edges)


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("family"), F.col("s_suppkey").alias("seq"), pick(("Active", "Rejected", "Active", "Retired"), "s_suppkey").alias("status"))


_NEWEST = "z as (select s_nationkey, arg_max(['Active', 'Rejected', 'Active', 'Retired'][s_suppkey % 4 + 1], s_suppkey) as status from supplier group by 1)"


@query(f"with {_NEWEST} select n_nationkey::varchar as family, n_name as label, status from nation join z on s_nationkey = n_nationkey where status = 'Active'")
def active_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.families_with_status(_graph(spark, sf_dir)[0], _statuses(spark, sf_dir), "Active")


@query(f"with {_NEWEST} select n_nationkey::varchar as family, n_name as label, status from nation join z on s_nationkey = n_nationkey where status = 'Rejected'")
def failed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.families_with_status(_graph(spark, sf_dir)[0], _statuses(spark, sf_dir), "Rejected")


_HYP = "fh as (select p_partkey, p_brand, (select arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) from lineitem where l_partkey = p_partkey) as s from part)"


@query(f"""with {_HYP} select p_brand as family, count(*) as features, count(*) filter (s_acctbal < 2000) as eliminated, round(count(*) filter (s_acctbal < 2000) / count(*), 6) as elimination_rate from fh left join supplier on s_suppkey = s group by 1""")
def feature_family_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gr.family_outcomes(*_graph(spark, sf_dir)))


@query(f"""with {_HYP}, e as (select o_orderkey % 97 + 1 as s, arg_max(['None', 'Weak', 'Moderate', 'Strong', 'Extraordinary'][o_custkey % 5 + 1], o_orderkey) as latest_tier, bool_or(o_custkey % 5 >= 4) as passes from orders where o_orderkey % 3 = 0 group by 1)
select 'P' || p_partkey as feature, p_brand as family, latest_tier from fh join e using (s) where passes""")
def surviving_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.surviving(*_graph(spark, sf_dir), F.col("tier") == "Extraordinary")


@query("select 'V' || p_partkey as id, p_name as label from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
def unexplored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.unexplored(*_graph(spark, sf_dir))


@query("""select 'F' || c_nationkey as family, count(distinct c_custkey) as campaigns, round(coalesce(sum(case when o_orderkey % 5 > 0 then o_totalprice end), 0)::double, 2) as cost, coalesce(sum(o_orderkey % 100), 0)::bigint as evaluated, coalesce(sum(o_orderkey % 10), 0)::bigint as promoted
from customer left join orders on o_custkey = c_custkey where c_custkey % 9 > 0 group by 1""")
def campaign_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    metrics = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("campaign"), F.when(k % 5 > 0, F.col("o_totalprice").cast("double")).alias("cost"), (k % 100).alias("evaluated"), (k % 10).alias("promoted"))
    return rounded(gr.campaign_totals(_graph(spark, sf_dir)[0], metrics), places=2)


@query("""select 'H' || (o_orderkey % 97 + 1) as hypothesis, 'C' || o_custkey as campaign, c_name as label, row_number() over (partition by o_orderkey % 97 order by o_orderkey)::int as place from orders join customer on c_custkey = o_custkey where o_custkey % 2 = 1""")
def replication_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.replication_history(*_graph(spark, sf_dir))


@query(f"""with recursive {_PUB}, {_MOVES}, life as (with recursive {_LIFE} select hypothesis, max_by("to", k) as stage from f where valid group by 1), st as (select hypothesis, max_by("to", k) as status from f where valid group by 1),
v as (select l_suppkey as s, arg_min('V' || l_partkey, l_orderkey * 10 + l_linenumber) as version from lineitem where l_quantity > 48 group by 1),
o as (select o_orderkey % 97 + 1 as s, string_agg('C' || o_custkey, ',' order by o_orderkey) filter (o_custkey % 2 = 0) as campaigns, string_agg('C' || o_custkey, ',' order by o_orderkey) filter (o_custkey % 2 = 1) as replications, string_agg('E' || o_orderkey, ',' order by o_orderkey) filter (o_orderkey % 3 = 0) as summaries from orders group by 1)
select 'H' || s_suppkey as hypothesis, 'F' || s_nationkey as family, version, campaigns, case when s_acctbal < 2000 then 'round 3' end as eliminations, replications, summaries, stage, status from supplier left join v on v.s = s_suppkey left join o on o.s = s_suppkey left join life on life.hypothesis = s_suppkey left join st on st.hypothesis = s_suppkey""")
def evidence_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each hypothesis; its lists are put together for comparison."""
    last = lambda df, name: df.filter("valid").groupBy("hypothesis").agg(F.max_by("to", "k").alias(name)).withColumn("hypothesis", F.concat(F.lit("H"), F.col("hypothesis").cast("string")))
    rows = gr.evidence(*_graph(spark, sf_dir), last(_lifecycle(spark, sf_dir), "stage"), last(_publication(spark, sf_dir), "status"))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("campaigns", "eliminations", "replications", "summaries")})


@query("""select 'feature' as node_type, count(*) as n from part union all select 'searchSpaceVersion', count(*) from part""")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)[0]
    return gr.of_type(nodes, "feature").unionByName(gr.of_type(nodes, "searchSpaceVersion")).groupBy("node_type").agg(F.count("*").alias("n"))


@query("""with n as (select n_nationkey as r, min(n_name) as label from nation where n_nationkey % 2 = 0 group by 1 union all select s_nationkey, min('again ' || s_name) from supplier group by 1), f as (select r, min(label) as label from n where r not in (select n_nationkey from nation where n_nationkey % 2 = 0) group by 1)
select 'representationFamily' as node_type, r::varchar as ref, label from f""")
def graph_add_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New family nodes, some of them known and many repeated; of repeats the one with the smallest name is taken."""
    nodes = gr.of_type(_graph(spark, sf_dir)[0], "representationFamily").filter("int(ref) % 2 = 0")
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("again "), F.col("s_name")).alias("id"), F.lit("representationFamily").alias("node_type"), F.col("s_nationkey").cast("string").alias("ref"))
    return gr.add_nodes(nodes, new).select("node_type", "ref", F.col("id").alias("label"))


@query("""with h as (select o_orderkey % 97 + 1 as s, max(o_orderkey) as top from orders where o_custkey % 2 = 1 group by 1), known as (select s_suppkey, greatest(coalesce(max(h.top), -1), coalesce(max(x.m), -1), coalesce(max(c.m), -1), coalesce(max(g.m), -1), max(s_suppkey)) as top from supplier left join h on h.s = s_suppkey
  left join (select l_suppkey as s, max(l_orderkey * 10 + l_linenumber) as m from lineitem where l_quantity > 48 group by 1) x on x.s = s_suppkey left join (select o_orderkey % 97 + 1 as s, max(o_orderkey) as m from orders where o_custkey % 2 = 0 group by 1) c on c.s = s_suppkey left join (select -1 as s, -1 as m) g on g.s = s_suppkey group by 1)
select 'observes' as edge_type, 'H' || l_suppkey as from_node, 'V' || l_partkey as to_node, (top + row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber, 'V' || l_partkey))::bigint as seq from lineitem join known on s_suppkey = l_suppkey join part on p_partkey = l_partkey""")
def graph_add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges of hypotheses, those from or to unknown nodes left out, numbered on from what their source has."""
    nodes, edges = _graph(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    new = li.select(F.lit("observes").alias("edge_type"), name("H", "l_suppkey").alias("from_node"), name("V", "l_partkey").alias("to_node"), F.col("k"))
    new = new.unionByName(li.select(F.lit("observes").alias("edge_type"), name("H", "l_suppkey").alias("from_node"), name("nowhere", "l_partkey").alias("to_node"), F.col("k")))
    return gr.add_edges(nodes, edges, new, "k").select("edge_type", "from_node", "to_node", "seq")
