"""Queries over snapshots, statistics and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import governance as gv
from tidewright.operators import machines as mc
from tidewright.operators import resampling as rs
from tidewright.operators import runs as rn
from tidewright.operators import snapshots as sn
from tidewright.operators import statistics as st
from tidewright.sources.shared import stored
from tidewright.sources.ticks import table, ticks

from .streams import E3, T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SN = E3 + """,
h as (select e.event_key, e.symbol, e.direction, e.i, list(t.price order by t.i) as h from e join t on t.symbol = e.symbol and t.i between e.i - 19 and e.i group by all having count(*) = 20),
dd as (select *, list_transform(range(1, 20), lambda k: h[k + 1] - h[k]) as d from h),
ss as (select *, list_transform(d, lambda x: sign(x)::int) as s, list_filter(list_transform(d, lambda x: sign(x)::int), lambda x: x <> 0) as z from dd),
bb as (select *, list_filter(range(1, 20), lambda k: k = 1 or s[k] <> s[k - 1]) as b,
  list_transform(range(1, 19), lambda k: case when h[k] <= h[k+1] and h[k+1] <= h[k+2] then 0 when h[k] <= h[k+2] and h[k+2] <= h[k+1] then 1 when h[k+1] <= h[k] and h[k] <= h[k+2] then 2
    when h[k+1] <= h[k+2] and h[k+2] <= h[k] then 3 when h[k+2] <= h[k] and h[k] <= h[k+1] then 4 else 5 end) as o from ss),
rr as (select *, list_transform(range(1, len(b) + 1), lambda k: coalesce(b[k + 1], 20) - b[k]) as r, len(list_filter(d, lambda x: x > 0)) as up, len(list_filter(d, lambda x: x < 0)) as dn from bb),
ff as (select event_key, symbol, direction, i, round(h[20] - h[1], 6) as ncf_net_displacement, round(list_sum(list_transform(d, lambda x: abs(x))), 6) as ncf_abs_path_length,
  round(coalesce(abs(h[20] - h[1]) / nullif(list_sum(list_transform(d, lambda x: abs(x))), 0), 0), 6) as ncf_path_efficiency, round((list_max(h) - h[1]) / abs(h[1]), 6) as ncf_mfe, round((h[1] - list_min(h)) / abs(h[1]), 6) as ncf_mae,
  up as ncf_up_tick_count, dn as ncf_down_tick_count, round((up - dn) / 19, 6) as ncf_dir_imbalance, r[-1] as ncf_current_run_len, list_max(r) as ncf_max_run_len,
  len(list_filter(range(1, len(z)), lambda k: z[k] <> z[k + 1])) as ncf_reversal_count, round((h[20] - h[1]) / 19, 6) as ncf_mean_first_diff, round(list_stddev_samp(d), 6) as ncf_std_first_diff,
  round(list_sum(list_transform(d, lambda x: abs(x))) / 19, 6) as ncf_mean_abs_first_diff, round((d[19] - d[1]) / 18, 6) as ncf_mean_second_diff,
  round(list_entropy(s) * ln(2), 6) as ncf_dir_entropy, round(list_entropy(r) * ln(2), 6) as ncf_run_entropy, round(list_entropy(o) * ln(2), 6) as ncf_perm_entropy3 from rr)"""


def _snapshots(spark: SparkSession, sf_dir: str, length: int = 3) -> DataFrame:
    stream = ticks(spark, sf_dir)
    return sn.snapshots(rn.runs(stream, length), stream)


@query(f"with {SN} select * from ff")
def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sn.enriched(_snapshots(spark, sf_dir)).filter("history_valid").drop("run_length", "run_start_epoch", "detected_at", "trigger_price", "history", "history_valid"))


@query(f"with {SN} select symbol, direction, count(*) as runs, round(avg(ncf_path_efficiency), 6) as path_efficiency, round(avg(ncf_dir_imbalance), 6) as direction_imbalance from ff group by 1, 2")
def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each symbol and direction: how many runs, and the path efficiency and imbalance when they end."""
    rows = snapshot_features(spark, sf_dir)
    return rounded(rows.groupBy("symbol", "direction").agg(F.count("*").alias("runs"), F.avg("ncf_path_efficiency").alias("path_efficiency"), F.avg("ncf_dir_imbalance").alias("direction_imbalance")))


@query("""select 'l_discount' as field, count(nullif(l_discount, 0)) as present, count(*) as n, count(nullif(l_discount, 0)) / count(*) as completeness from lineitem
union all select 'l_tax', count(nullif(l_tax, 0)), count(*), count(nullif(l_tax, 0)) / count(*) from lineitem""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return sn.quality(rows, ["l_discount", "l_tax"])


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
V = """li as (select l_orderkey * 10 + l_linenumber as id, (l_returnflag = 'R')::int as label, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount, l_tax::double as l_tax from lineitem),
v as (select id, label, feature, value from (unpivot li on l_quantity, l_extendedprice, l_discount, l_tax into name feature value value))"""
RANKED = V + """,
m as (select feature, min(value) as lo, max(value) as hi, count(*) as n, sum(label) as pos from v group by 1),
j as (select feature, least(floor((value - lo) / (hi - lo) * 8), 7) as b, label, n, count(*) as c from v join m using (feature) group by all),
mi as (select j.feature, sum(j.c / j.n * log2(j.c * j.n / (x.c * y.c))) as mutual_information from j join (select feature, b, sum(c) as c from j group by all) x on x.feature = j.feature and x.b = j.b
  join (select feature, label, sum(c) as c from j group by all) y on y.feature = j.feature and y.label = j.label group by 1),
cu as (select feature, n::double as n, pos::double as pos, row_number() over w::double as nl, sum(label) over w::double as pl from v join m using (feature) window w as (partition by feature order by value, id rows unbounded preceding)),
gi as (select feature, greatest(max(1 - (pos / n) ** 2 - (1 - pos / n) ** 2 - (nl / n * (1 - (pl / nl) ** 2 - (1 - pl / nl) ** 2) + (n - nl) / n * (1 - ((pos - pl) / (n - nl)) ** 2 - (1 - (pos - pl) / (n - nl)) ** 2))), 0) as split_gain from cu where nl < n group by 1),
le as (select feature, abs(covar_pop(value, label)) / stddev_pop(label) as linear_effect, avg(value) filter (label = 1) as mean_rise, avg(value) filter (label = 0) as mean_fall from v group by 1),
al as (select feature, mutual_information, split_gain, linear_effect, mean_rise, mean_fall, mean_rise - mean_fall as delta, (mutual_information + 2 * split_gain + linear_effect) / 4 as composite from mi join gi using (feature) join le using (feature))"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("id", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return st.unpivoted(rows, "id", (F.col("l_returnflag") == "R").cast("int"), FEATURES)


@query(f"""with {RANKED} select feature, round(mutual_information, 6) as mutual_information, round(split_gain, 6) as split_gain, round(linear_effect, 4) as linear_effect, round(mean_rise, 4) as mean_rise, round(mean_fall, 4) as mean_fall,
  round(delta, 4) as delta, round(composite, 4) as composite, row_number() over (order by composite desc, feature)::int as rank from al""")
def feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.ranked(_values(spark, sf_dir), "id")
    return rounded(rows.withColumns({c: F.round(c, 4) for c in ("linear_effect", "mean_rise", "mean_fall", "delta", "composite")}))


@query(f"""with {V}, k as (select feature, value, count(*) filter (label = 1) as a, count(*) filter (label = 0) as b from v group by 1, 2)
select x.feature, sum(x.a * (coalesce((select sum(y.b) from k y where y.feature = x.feature and y.value < x.value), 0) + x.b / 2)) as u, sum(x.a)::bigint as n1, sum(x.b)::bigint as n0,
  round(2 * sum(x.a * (coalesce((select sum(y.b) from k y where y.feature = x.feature and y.value < x.value), 0) + x.b / 2)) / (sum(x.a) * sum(x.b)) - 1, 6) as r from k x group by 1""")
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.rank_biserial(_values(spark, sf_dir)))


@query(f"""with {V}, k as (select feature, value, sum(label) as a, count(*) - sum(label) as b from v group by 1, 2),
g as (select feature, a, b, abs(sum(a) over w / sum(a) over (partition by feature) - sum(b) over w / sum(b) over (partition by feature)) as gap from k window w as (partition by feature order by value)),
s as (select feature, max(gap) as statistic, sum(a)::bigint as n_a, sum(b)::bigint as n_b from g group by 1),
x as (select *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * statistic as l from s)
select feature, round(statistic, 6) as statistic, n_a, n_b, round(greatest(0, least(1, case when l < 1 then 1 - sqrt(2 * pi()) / l * list_sum(list_transform(range(1, 101), lambda k: exp(-1 * ((2 * k - 1) ** 2) * (pi() ** 2) / (8 * l * l))))
  else 2 * list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 1 else -1 end * exp(-2 * k * k * l * l))) end)), 6) as p_value from x""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.kolmogorov_smirnov(_values(spark, sf_dir), F.col("label") == 1, "value", ["feature"]))


P = "pt as (select p_brand as family, p_partkey as k, (p_partkey * 7919 % 1000) / 20000::double as p from part)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("k"), (F.pmod(F.col("p_partkey") * 7919, F.lit(1000)) / 20000).alias("p"))


@query(f"""with {P}, r as (select *, row_number() over (order by p, k) as rank, count(*) over () as m from pt)
select family, k, p, rank::int as rank, round(least(1, min(p * m / rank) over (order by rank desc)), 6) as adjusted_p, least(1, min(p * m / rank) over (order by rank desc)) <= 0.05 as rejected from r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.benjamini_hochberg(_tests(spark, sf_dir), "k", "p"), "p")


WL = f"""{P}, o as (select *, row_number() over (partition by family order by k) - 1 as seq from pt),
l as (select family, seq, k, p, 0.0125::double as alpha_spent, p <= 0.0125 as rejected, 0.025::double as wealth_before, 0.0125::double + case when p <= 0.0125 then 0.025::double else 0 end as wealth_after from o where seq = 0
  union all select o.family, o.seq, o.k, o.p, l.wealth_after * 0.5::double, o.p <= l.wealth_after * 0.5::double, l.wealth_after, l.wealth_after - l.wealth_after * 0.5::double + case when o.p <= l.wealth_after * 0.5::double then 0.025::double else 0 end
  from l join o on o.family = l.family and o.seq = l.seq + 1)"""


@query(f"with recursive {WL} select family, seq, k, p, round(alpha_spent, 9) as alpha_spent, rejected, round(wealth_before, 9) as wealth_before, round(wealth_after, 9) as wealth_after from l")
def online_fdr_wealth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gv.wealth(_tests(spark, sf_dir), "family", "k", "p"), "p", places=9)


@query(f"with recursive {WL} select family, max(seq) as seq, round(arg_max(wealth_after, seq), 9) as wealth_after from l group by 1")
def latest_wealth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gv.latest(gv.wealth(_tests(spark, sf_dir), "family", "k", "p"), ["family"], "seq").select("family", "seq", "wealth_after"), places=9)


@query(f"""with recursive {WL}, a as (select family, count(*) filter (p < 0.01) as supported_count, count(*) filter (p < 0.01 and k % 2 = 0) as replicated_count, arg_max(wealth_after, seq) as w from l group by 1),
b as (select *, replicated_count / nullif(supported_count, 0) as edr, 1 - w as t from a)
select family, supported_count, replicated_count, round(w, 6) as allocated_wealth, round(edr, 6) as edr, round(t, 6) as implied_target, round(t - edr, 6) as divergence,
  case when t - edr > 0 then 'below-target' when t - edr < 0 then 'above-target' when t = edr then 'on-target' end as direction, supported_count < 5 as below_minimum_sample, coalesce(abs(t - edr) > 0.1 and supported_count >= 5, false) as material_divergence from b""")
def fdr_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = gv.wealth(_tests(spark, sf_dir), "family", "k", "p")
    return rounded(gv.canary(ledger, "family", F.col("p") < 0.01, F.col("k") % 2 == 0))


@query("""with e as (select event_type as stream, event_id as k, value > 100 as raw from events),
o as (select *, row_number() over (partition by stream order by k) as n, list(raw) over (partition by stream order by k rows between 2 preceding and current row) as l from e),
a as (select stream, n, case when len(l) = 3 and list_min(l) = list_max(l) then case when raw then 'drifted' else 'stable' end end as agreed from o),
s as (select o.stream, o.k, o.raw, o.n, coalesce((select arg_max(a.agreed, a.n) from a where a.stream = o.stream and a.n <= o.n and a.agreed is not null), 'stable') as state_after from o)
select stream, k, raw, state_after, state_after <> coalesce(lag(state_after) over (partition by stream order by k), 'stable') as published from s""")
def drift_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("k"), (F.col("value") > 100).alias("raw"))
    return gv.hysteresis(e, "stream", "k", "raw", 3)


_STAGE = "['" + "', '".join(mc.LIFECYCLE) + "']"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*[F.lit(s) for s in mc.LIFECYCLE])
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hypothesis"), F.col("o_orderkey").alias("seq"), F.get(stages, (F.col("o_orderkey") % 8).cast("int")).alias("to"))


@query(f"""with o as (select c_mktsegment as family, o_custkey as h, o_orderkey as seq, {_STAGE}[o_orderkey % 8 + 1] as t from orders join customer on c_custkey = o_custkey),
e as (select family, h, max((t = 'Replication')::int) as ever, arg_max(t, seq) as now from o group by 1, 2)
select family, count(*) as hypotheses, round(avg(ever), 6) as discovery_yield, round(avg((now = 'Replication')::int), 6) as survival_rate from e group by 1""")
def discovery_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hypothesis"), F.col("c_mktsegment").alias("family"))
    return rounded(gv.yields(_moves(spark, sf_dir).join(families, "hypothesis"), "family", "hypothesis", "to", "Replication", "seq"))


G = """ed as (select 'uses' as edge_type, 'P' || l_partkey as f, 'S' || l_suppkey as t, l_orderkey * 10 + l_linenumber as seq from lineitem
  union all select 'tests', 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey from supplier union all select 'explains', 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey from nation)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t("part").select(F.lit("feature").alias("node_type"), name("P", "p_partkey").alias("id")).unionByName(t("region").select(F.lit("behavior").alias("node_type"), name("R", "r_regionkey").alias("id")))
    edges = t("lineitem").select(F.lit("uses").alias("edge_type"), name("P", "l_partkey").alias("from_node"), name("S", "l_suppkey").alias("to_node"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    edges = edges.unionByName(t("supplier").select(F.lit("tests").alias("edge_type"), name("S", "s_suppkey").alias("from_node"), name("N", "s_nationkey").alias("to_node"), F.col("s_suppkey").alias("seq")))
    return nodes, edges.unionByName(t("nation").select(F.lit("explains").alias("edge_type"), name("N", "n_nationkey").alias("from_node"), name("R", "n_regionkey").alias("to_node"), F.col("n_nationkey").cast("long").alias("seq")))


@query(f"with {G} select a.t as behavior, count(distinct a.f) as hypotheses, count(distinct b.f) as candidates, count(distinct c.f) as features from ed a left join ed b on b.edge_type = 'tests' and b.t = a.f left join ed c on c.edge_type = 'uses' and c.t = b.f where a.edge_type = 'explains' group by 1")
def behavior_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.behaviors(*_graph(spark, sf_dir))


@query(f"""with {G}, u as (select edge_type, f, arg_min(t, seq) as t from ed group by 1, 2)
select 'P' || p_partkey as feature, a.t as candidate, b.t as hypothesis, c.t as behavior from part left join u a on a.edge_type = 'uses' and a.f = 'P' || p_partkey
  left join u b on b.edge_type = 'tests' and b.f = a.t left join u c on c.edge_type = 'explains' and c.f = b.t""")
def feature_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.lineage(*_graph(spark, sf_dir))


@query("""with recursive e as (select c_custkey + 1 as child, (c_custkey + 1) // 3 as parent from customer), c as (select child as node, parent as ancestor, 1 as distance from e
  union all select c.node, e.parent, c.distance + 1 from c join e on e.child = c.ancestor) select node, ancestor, min(distance) as distance from c group by 1, 2""")
def provenance_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") + 1
    return gv.closure(table(spark, sf_dir, "customer").select(n.alias("child"), F.floor(n / 3).alias("parent")))


@query("""with a as (select o_orderkey as access_id, o_custkey % 50 as dataset, o_orderkey as s from orders),
r as (select p_partkey as h, p_partkey % 50 as dataset, p_partkey * 50 as s, p_partkey * 100 as at from part)
select r.h as hypothesis_id, a.access_id from a join r on a.dataset = r.dataset and a.s <= r.s + 600 and r.s <= a.s + 10 and a.s < r.at where not exists (select 1 from lineitem where l_partkey = r.h and l_orderkey = a.access_id)""")
def undisclosed_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("access_id"), (F.col("o_custkey") % 50).alias("dataset"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 10).alias("end"), F.col("o_orderkey").alias("at"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hypothesis_id"), (F.col("p_partkey") % 50).alias("dataset"), (F.col("p_partkey") * 50).alias("start"), (F.col("p_partkey") * 50 + 600).alias("end"), (F.col("p_partkey") * 100).alias("registered_at"))
    disclosed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hypothesis_id"), F.col("l_orderkey").alias("access_id"))
    return gv.prior_access(a, r, disclosed)


@query("select o_orderpriority as campaign, count(*) as evaluated, count(*) filter (o_orderstatus = 'F') as promoted, round(count(*) filter (o_orderstatus = 'F') / count(*), 6) as rate from orders group by rollup (o_orderpriority)")
def funnel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("campaign"), F.lit(1).alias("evaluated"), (F.col("o_orderstatus") == "F").cast("int").alias("promoted"))
    return rounded(gv.funnel(rounds))


@query("""with a as (select o_custkey as arm, count(*) as pulls, count(*) filter (o_orderstatus = 'F') as reward from orders group by 1), s as (select *, reward / pulls + sqrt(2) * sqrt(ln(sum(pulls) over ()) / pulls) as score from a)
select arm, pulls, reward, round(score, 6) as score, row_number() over (order by score desc, arm)::int as rank from s""")
def bandit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("arm")).agg(F.count("*").alias("pulls"), F.count_if(F.col("o_orderstatus") == "F").alias("reward"))
    return rounded(gv.ucb(arms, "arm", "pulls", "reward"))


@query("select p_partkey, p_retailprice, row_number() over (order by p_retailprice desc, p_partkey)::int as rank from part qualify rank <= greatest(1, ceil(count(*) over () * 0.05))")
def round_one_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.screened(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 0.05)


@query("""with n as (select p_partkey, p_retailprice, row_number() over (order by p_retailprice, p_partkey) - 1 as k, count(*) over () as n from part),
c as (select max(case when k = floor(0.25 * n) - 1 then p_retailprice end) as a, max(case when k = floor(0.5 * n) - 1 then p_retailprice end) as b, max(case when k = floor(0.75 * n) - 1 then p_retailprice end) as d from n)
select p_partkey, p_retailprice, a as cut_25, b as cut_50, d as cut_75, (p_retailprice >= a)::int as above_25, (p_retailprice < a)::int as below_25, (p_retailprice >= b)::int as above_50, (p_retailprice < b)::int as below_50,
  (p_retailprice >= d)::int as above_75, (p_retailprice < d)::int as below_75 from n, c""")
def percentile_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.binarized(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"])


@query("""with p as (select c_custkey as id, c_nationkey as dataset, c_custkey * 7 as s, c_custkey * 7 + 100 as e from customer)
select a.dataset, a.id as first_id, b.id as second_id from p a join p b on a.dataset = b.dataset and a.id < b.id and a.s <= b.e and b.s <= a.e""")
def partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.overlapping(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset"), (F.col("c_custkey") * 7).alias("start"), (F.col("c_custkey") * 7 + 100).alias("end")))


_MASK = "4294967295"


def _mixed(x: str) -> str:
    """SQL of a 32-bit mixing function."""
    for by, k in (("16", "2146121005"), ("15", "2221713035")):
        x = f"(list_transform([{x}], lambda v: xor(v, v >> {by}) * {k}::ubigint & {_MASK})[1])"
    return f"(list_transform([{x}], lambda v: xor(v, v >> 16))[1])"


def _shifts(times: int, seed: int = 42) -> str:
    """SQL of the shifts ``sh`` (symbol, k, s) of each series of ``z`` (symbol, k, n), 0 among them."""
    return f"""g0 as (select k, ({seed}::ubigint + (k::ubigint + 1) * 1831565813::ubigint) & {_MASK} as a from range({times}) u(k)),
g1 as (select k, xor(a, a >> 15) * (a | 1) & {_MASK} as t from g0), g2 as (select k, xor(t, (t + (xor(t, t >> 7) * (t | 61) & {_MASK})) & {_MASK}) as t from g1),
g as (select k + 1 as k, xor(t, t >> 14) / 4294967296::double as u from g2), n as (select symbol, count(*) as n from z group by 1),
sh as (select symbol, k, greatest(1, floor(0.05 * n)) + floor(u * (n - 2 * greatest(1, floor(0.05 * n)))) as s, n from n, g union all select symbol, 0, 0, n from n)"""


def _resampled(times: int, seed: int) -> str:
    """SQL of the correlations ``b`` (symbol, t, r) of resamples of ``z`` (symbol, k, x, y)."""
    weight = " + ".join(f"(h >= {v}::ubigint)::int" for v in rs.POISSON)
    return f"""zi as (select *, {_mixed('k::ubigint')} as hk from z), ti as (select t, {_mixed(f'({seed}::ubigint + t::ubigint * 2654435769::ubigint) & {_MASK}')} as ht from range({times}) u(t)),
hs as (select symbol, t, x, y, {_mixed('xor(hk, ht)')} as h from zi, ti), ws as (select *, {weight} as w from hs),
bs as (select symbol, t, sum(w) as w, sum(w * x) as wx, sum(w * y) as wy, sum(w * x * x) as wxx, sum(w * y * y) as wyy, sum(w * x * y) as wxy from ws group by 1, 2),
b as (select symbol, t, (wxy / w - wx / w * (wy / w)) / sqrt((wxx / w - wx / w * (wx / w)) * (wyy / w - wy / w * (wy / w))) as r from bs)"""


#: Each tick's price and the change to the next, numbered by symbol; and their values in deviations from the mean.
_PRICES = f"""{T}, z0 as (select symbol, i as k, price as x, lead(price) over (partition by symbol order by i) - price as y from t), z as (select * from z0 where y is not null)"""
_SCALED = "select symbol, row_number() over (partition by symbol order by k) - 1 as k, (x - avg(x) over v) / stddev_pop(x) over v as x, (y - avg(y) over v) / stddev_pop(y) over v as y from {0} window v as (partition by symbol)"


@query(f"""with {_PRICES}, c as (select symbol, k, least(floor((x - min(x) over v) / (max(x) over v - min(x) over v) * 8), 7) as x, least(floor((y - min(y) over v) / (max(y) over v - min(y) over v) * 8), 7) as y from z window v as (partition by symbol)),
{_shifts(1000)}, sa as materialized (select s.symbol, s.k, s.n, a.x, (a.k - s.s::bigint + s.n) % s.n as kb from sh s join c a on a.symbol = s.symbol),
j as (select s.symbol, s.k, s.n, s.x, b.y, count(*) as v from sa s join c b on b.symbol = s.symbol and b.k = s.kb group by 1, 2, 3, 4, 5),
m as (select symbol, k, n, greatest(sum(v / n * log2(v::double * n / (r * q))), 0) as s from (select *, sum(v) over (partition by symbol, k, x) as r, sum(v) over (partition by symbol, k, y) as q from j) group by 1, 2, 3)
select o.symbol, o.n, round(o.s, 6) as statistic, round((1 + count(*) filter (m.s >= o.s - 1e-9)) / 1001, 6) as p_value from m o join m on m.symbol = o.symbol and m.k > 0 where o.k = 0 group by o.symbol, o.n, o.s""")
def permutation_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rs.permutation_test(_pairs(spark, sf_dir), ["symbol"], "i", "x", "y"))


@query(f"""with {_PRICES.replace(', z as (', ', z1 as (')}, z as ({_SCALED.format('z1')}), {_resampled(2000, 43)}, o as (select symbol, count(*) as n, avg(x * y) as r from z group by 1)
select o.symbol, n, round(o.r, 6) as r, round(list_sort(list(b.r))[50], 6) as low, round(list_sort(list(b.r))[1950], 6) as high, round(stddev_samp(b.r), 6) as error from o join b on b.symbol = o.symbol group by o.symbol, n, o.r""")
def bootstrap_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rs.bootstrap(_pairs(spark, sf_dir), ["symbol"], "i", "x", "y"))


@query(f"""with {T}, z0 as (select symbol, i as k, case when i >= 10 then price - lag(price, 10) over w end as x, lead(price) over w as p1, lead(price, 2) over w as p2, price from t window w as (partition by symbol order by i)),
z1 as (select symbol, k, x, (p1 > price and p2 > p1)::int as y from z0 where x is not null and p2 is not null), z as ({_SCALED.format('z1')}), {_shifts(1000)}, {_resampled(2000, 43)},
sa as materialized (select s.symbol, s.k, s.n, a.x, (a.k - s.s::bigint + s.n) % s.n as kb from sh s join z a on a.symbol = s.symbol),
j as (select s.symbol, s.k, s.n, sum(s.x * b.y) / s.n as r from sa s join z b on b.symbol = s.symbol and b.k = s.kb group by 1, 2, 3),
o as (select * from j where k = 0), f as (select o.symbol, o.n, abs(o.r) as statistic, o.r as effect, (1 + count(*) filter (abs(j.r) >= abs(o.r) - 1e-9)) / 1001 as p_value, avg(abs(j.r)) as null_mean, var_samp(abs(j.r)) as null_variance
  from o join j on j.symbol = o.symbol and j.k > 0 group by o.symbol, o.n, o.r),
d as (select symbol, list_sort(list(r))[50] as ci_lower, list_sort(list(r))[1950] as ci_upper, stddev_samp(r) as error, avg(pow((r - m) / sd, 3)) as skewness
  from (select *, avg(r) over (partition by symbol) as m, stddev_samp(r) over (partition by symbol) as sd from b) group by 1)
select symbol, n, round(statistic, 6) as statistic, round(effect, 6) as effect, round(error, 6) as error, round(ci_lower, 6) as ci_lower, round(ci_upper, 6) as ci_upper, round(p_value, 6) as p_value, round(null_mean, 6) as null_mean,
  round(null_variance, 6) as null_variance, round(sqrt(p_value * (1 - p_value) / 1000), 6) as monte_carlo_error, round(skewness, 6) as skewness,
  nullif(concat_ws(',', case when abs(skewness) > 1 then 'skewed' end, case when ci_upper - ci_lower > 1.5 then 'wide' end, case when p_value <= 1 / 1001::double + 1e-12 then 'least p' end), '') as warnings from f join d using (symbol)""")
def confirmation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's 10-tick momentum against whether the next two ticks rise: effect, p-value, interval and warnings."""
    from tidewright.functions import indicators as ind

    stream = ticks(spark, sf_dir)
    rows = ind.windowed(stream, ["momentum"]).select("symbol", "i", F.col("momentum").alias("x"))
    y = st.outcome_series(stream, "Rise", 2).withColumnRenamed("outcome", "y")
    return rounded(rs.confirmation(rows.join(y, ["symbol", "i"]), ["symbol"], "i", "x", "y"))


@query(f"""with {T} select symbol, i, (list_min(l) > 0)::int as outcome from (select symbol, i, list(d) over (partition by symbol order by i rows between 1 following and 3 following) as l
from (select symbol, i, case when price > lag(price) over (partition by symbol order by i) then 1 else 0 end as d from t)) where len(l) = 3""")
def outcome_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of a tick's next three moves is a rise."""
    return st.outcome_series(ticks(spark, sf_dir), "Rise", 3)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of each symbol: price and the change to the next one."""
    stream = ticks(spark, sf_dir)
    nxt = stream.select("symbol", (F.col("i") - 1).alias("i"), F.col("price").alias("next_price"))
    return stream.join(nxt, ["symbol", "i"]).select("symbol", "i", F.col("price").alias("x"), (F.col("next_price") - F.col("price")).alias("y"))


@query()
def generated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions import generated

    return rounded(generated.of_ticks(ticks(spark, sf_dir)))


@query()
def generated_feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All generated features against whether the next tick rises, by the composite of three measures."""
    from tidewright.functions import generated

    stream = ticks(spark, sf_dir).select("symbol", "i", "price")
    nxt = stream.select("symbol", (F.col("i") - 1).alias("i"), F.col("price").alias("next_price"))
    # a symbol's last tick has no label
    rise = F.coalesce((F.col("next_price") > F.col("price")).cast("int"), F.lit(-1)).alias("rise")
    labelled = stream.join(nxt, ["symbol", "i"], "left").select(*stream.columns, rise, F.xxhash64("symbol", "i").alias("id"))
    count = stream.count()
    # chunks are few and each is much work, so they are dealt evenly over some tasks for each core, of about a million ticks at most
    tasks = max(4 * spark.sparkContext.defaultParallelism, count // 1_000_000)
    rows = stored(generated.packed(labelled, ("rise", "id")), "chunks").repartition(tasks, "symbol", "chunk")

    def columns(batch):
        for kept, features in generated.unpacked(batch, ("rise", "id")):
            there = kept["rise"] >= 0
            yield kept["id"][there], kept["rise"][there], [f.at(there) for f in features]

    return rounded(st.ranked_columns(rows, generated.NAMES, columns, count))
