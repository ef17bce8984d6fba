"""Queries over registries, logs, audits and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import candles as cd
from tidewright.operators import machines as mc
from tidewright.operators import registries as rg
from tidewright.sources.ticks import table, ticks

from .lab import pick, sql_pick

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select o_orderkey, o_totalprice::double as o_totalprice, try_cast(o_orderstatus as double) as o_orderstatus from orders")
def field_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.whitelisted(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderstatus", "not_there"])


@query("""with d as (select s_suppkey as id, s_nationkey % 3 as market, s_suppkey % 4 as target, s_suppkey % 5 / 10 as threshold, s_suppkey % 7 as horizon, s_suppkey % 6 = 0 as has_cap from supplier)
select a.id, b.id as other, a.market = b.market and a.target = b.target and abs(a.threshold - b.threshold) <= 0.1000001 and abs(a.horizon - b.horizon) <= 0.1000001 and a.has_cap = b.has_cap as equivalent from d a join d b on b.id = a.id + 4""")
def target_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of targets against the one four places on: equal fields, numbers within a tolerance."""
    k = F.col("s_suppkey")
    numbers = F.map_concat(F.create_map(F.lit("threshold"), k % 5 / 10, F.lit("horizon"), (k % 7).cast("double")), F.when(k % 6 == 0, F.create_map(F.lit("cap"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>")))
    d = table(spark, sf_dir, "supplier").select(k.alias("id"), F.struct((F.col("s_nationkey") % 3).alias("market"), (k % 4).alias("target"), numbers.alias("numbers")).alias("d"))
    other = d.select((F.col("id") - 4).alias("id"), F.col("id").alias("other"), F.col("d").alias("e"))
    return d.join(other, "id").select("id", "other", rg.equivalent(F.col("d"), F.col("e"), ["market", "target"], 0.1000001).alias("equivalent"))


@query("""with i as (select distinct l_suppkey as s, l_partkey % 8 as v from lineitem where l_quantity > 45), n as (select s, count(*) as n from i group by 1), p as (select a.s as a, b.s as b, count(*) as shared from i a join i b on a.v = b.v and a.s < b.s group by 1, 2)
select a, b, shared, x.n as n_a, y.n as n_b, case when shared = x.n and shared = y.n then 'full' else 'partial' end as overlap from p join n x on x.s = a join n y on y.s = b""")
def shared_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers stand on the same inputs."""
    return rg.shared_inputs(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 8).alias("v")), "s", "v")


@query("""with l as (select 'f' || o_custkey as fingerprint, ['screening', 'triage', 'confirmation'][o_orderkey % 3 + 1] as stage from orders) select fingerprint, stage, count(*) as n from l group by 1, 2 union all select fingerprint, null, count(*) from l group by 1""")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fingerprint"), pick(("screening", "triage", "confirmation"), "o_orderkey").alias("stage"))
    return rg.rejections(log, "fingerprint", "stage")


_S = tuple(mc.LIFECYCLE)


@query(f"""with q as (select c_custkey as id, {sql_pick(_S, 'c_custkey')} as "to", c_custkey % 5 = 0 as again, case when c_custkey % 4 > 0 then c_custkey % 9 > 0 end as attested, case when c_custkey % 11 > 0 then {sql_pick(_S, '(c_custkey + case when c_custkey % 3 = 0 then 7 when c_custkey % 5 = 0 then 0 else 5 end)')} end as stage from customer),
n(a, b) as (values ('Registration', 'FeatureGeneration'), ('FeatureGeneration', 'Discovery'), ('Discovery', 'Replication'), ('Replication', 'Lockbox'), ('Lockbox', 'Publication'), ('Publication', 'Retirement'), ('Retirement', 'Archive')),
r as (select q.*, array_to_string(list_filter([case when stage is null then 'registration-complete' end, case when not coalesce(b = "to" or (again and stage = "to" and "to" in ('Discovery', 'Replication')), again and stage = "to" and "to" in ('Discovery', 'Replication'), false) then 'lifecycle-adjacency' end,
  case when not attested then 'data-access-attestation-valid' end], lambda x: x is not null), ',') as failed from q left join n on n.a = stage)
select id, "to", stage, failed, failed = '' as passed from r""")
def compliance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested moves with the checks that they fail."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    requests = c.select(k.alias("id"), pick(_S, "c_custkey").alias("to"), (k % 5 == 0).alias("again"), F.when(k % 4 > 0, k % 9 > 0).alias("attested"))
    current = c.filter(k % 11 > 0).select(k.alias("id"), pick(_S, "c_custkey + case when c_custkey % 3 = 0 then 7 when c_custkey % 5 = 0 then 0 else 5 end").alias("stage"))
    return rg.audit(requests, current, "id").select("id", "to", "stage", "failed", "passed")


@query("""with s as (select o_orderkey as id, ['event', 'batch', 'time', 'other'][o_orderkey % 4 + 1] as policy, case when o_orderkey % 7 > 0 then o_custkey % 50 end as threshold, o_custkey as observed, o_custkey - o_orderkey % 60 as last_observed, o_orderkey % 1000 as written, o_orderkey % 900 as last_written,
  case when o_orderkey % 5 > 0 then 1000 - o_custkey % 90 end as last_run, 950 as boot from orders)
select id, policy, coalesce(case when policy = 'event' then observed - last_observed >= coalesce(threshold, 1) when policy = 'batch' and threshold > 0 then floor(written / threshold) > floor(last_written / threshold) when policy = 'time' and threshold > 0 then 1000 - coalesce(last_run, boot) >= threshold end, false) as due,
  case when policy = 'time' and threshold > 0 then coalesce(last_run, boot) + threshold end as next_at from s""")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    states = table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(("event", "batch", "time", "other"), "o_orderkey").alias("policy"), F.when(k % 7 > 0, c % 50).alias("threshold"), c.alias("observed"), (c - k % 60).alias("last_observed"), (k % 1000).alias("written"), (k % 900).alias("last_written"),
        F.when(k % 5 > 0, 1000 - c % 90).alias("last_run"), F.lit(950).alias("boot"),
    )
    return rg.due(states, 1000).select("id", "policy", "due", "next_at")


_F = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _F])


@query(f"""with l as (select unnest([{', '.join(f"'{c}'" for c in _F)}]) as feature, unnest([{', '.join(f'{c}::double' for c in _F)}]) as value from lineitem), e as (select feature, min(value) as lo, max(value) as hi, avg(value) as mean, stddev_samp(value) as deviation from l group by 1)
select feature, coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 10), 9), 0)::int as bin, round(mean, 6) as mean, round(deviation, 6) as deviation, count(*) as n from l join e using (feature) group by all""")
def feature_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.distributions(_features(spark, sf_dir), list(_F)))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 6) as r from lineitem" for i, a in enumerate(_F) for b in _F[i + 1 :]))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.correlations(_features(spark, sf_dir), list(_F)))


@query("""with j as (select l_suppkey as id, l_quantity::double as x, case when l_suppkey % 7 > 0 then l_discount::double else 0 end as y from lineitem)
select id, round(case when count(*) >= 60 and stddev_pop(x) > 0 and stddev_pop(y) > 0 then abs(corr(x, y)) else 0 end, 6) as score from j group by 1""")
def quick_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("double").alias("x"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_discount").cast("double")).otherwise(0.0).alias("y"))
    return rounded(rg.quick_scores(rows, ["id"], "x", "y"))


@query("""select 'hypotheses' as section, count(*)::double as value, count(*) as denominator, 'lab' as scope from supplier union all select 'promoted', count(*) filter (o_orderstatus = 'F')::double, count(*), 'campaign' from orders union all select 'mean effect', round(avg(l_discount)::double, 6), count(*), 'family' from lineitem""")
def dashboard_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, value, scope: table(spark, sf_dir, t).agg(value.alias("value"), F.count("*").alias("denominator")).withColumn("scope", F.lit(scope))
    return rounded(rg.snapshot([("hypotheses", one("supplier", F.count("*"), "lab")), ("promoted", one("orders", F.count_if(F.col("o_orderstatus") == "F"), "campaign")), ("mean effect", one("lineitem", F.avg(F.col("l_discount").cast("double")), "family"))]))


@query("""with a as (select p_partkey as id, ['Generated', 'Screened', 'Triaged', 'Confirmed', 'Replicated'][p_size % 5 + 1] as stage, case when p_partkey % 3 > 0 then p_partkey % 3 = 1 end as lockbox, case when p_partkey % 7 > 0 then p_partkey % 10 / 10 end as stability from part)
select id, stage, case when stage = 'Confirmed' and lockbox and stability is not null then case when stability >= 0.5 then 'Replicated' else 'Deprecated' end else stage end as after from a""")
def replication_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), pick(("Generated", "Screened", "Triaged", "Confirmed", "Replicated"), "p_size").alias("stage"), F.when(k % 3 > 0, k % 3 == 1).alias("lockbox"), F.when(k % 7 > 0, k % 10 / 10).alias("stability"))
    return rg.replicated(rows).select("id", "stage", "after")


@query("""with m as (select event_id as message_id, case when event_id % 3 = 0 then 'ohlc' else 'tick' end as kind, event_type as symbol, [60, 300, 3600][event_id % 3 + 1] as granularity, [60, 300, 3600][event_id // 3 % 3 + 1] as g from events),
p(panel, symbol, granularity) as (values ('a', 'click', 60), ('b', 'click', 300), ('c', 'view', 60))
select panel, kind, p.symbol, p.granularity, message_id from m join p on p.symbol = m.symbol and (kind = 'tick' or p.granularity = m.g)""")
def message_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    messages = table(spark, sf_dir, "events").select(e.alias("message_id"), F.when(e % 3 == 0, "ohlc").otherwise("tick").alias("kind"), F.col("event_type").alias("symbol"), F.get(F.array(F.lit(60), F.lit(300), F.lit(3600)), (F.floor(e / 3) % 3).cast("int")).alias("granularity"))
    panels = spark.createDataFrame([("a", "click", 60), ("b", "click", 300), ("c", "view", 60)], "panel string, symbol string, granularity int")
    return rg.routed(messages, panels)


@query("select event_type as symbol, count(*) as observed, count(*) filter (value > 100) as written, count(distinct event_id) as distinct_events from events group by rollup (event_type)")
def bus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed and written by symbol and in all."""
    e = table(spark, sf_dir, "events")
    return e.rollup(F.col("event_type").alias("symbol")).agg(F.count("*").alias("observed"), F.count_if(F.col("value") > 100).alias("written"), F.countDistinct("event_id").alias("distinct_events"))


@query("select event_type as symbol, event_id as i, value as price from events qualify row_number() over (partition by event_type order by event_id desc) <= 500")
def learning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 entries of each symbol: a log of that length is the feature."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("i"), F.col("value").alias("price"))
    return cd.newest(e, 500, "i")


@query("""with t as (select event_type as symbol, row_number() over (partition by event_type order by ts, event_id) - 1 as i, value as price from events), n as (select symbol, count(*) as n from t group by 1), h as (select t.symbol, price, i >= n // 2 as late, n from t join n using (symbol)),
g as (select symbol, price, count(*) filter (not late) as a, count(*) filter (late) as b from h group by 1, 2), w as (select symbol, price, sum(a) over w / sum(a) over (partition by symbol) as fa, sum(b) over w / sum(b) over (partition by symbol) as fb from g window w as (partition by symbol order by price))
select symbol, round(max(abs(fa - fb)), 6) as statistic from w group by 1""")
def regime_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance between the earlier and the later half of each symbol's prices."""
    from tidewright.operators import statistics as st

    stream = ticks(spark, sf_dir)
    n = stream.groupBy("symbol").agg(F.count("*").alias("n"))
    halves = stream.join(n, "symbol").withColumn("late", F.col("i") >= F.floor(F.col("n") / 2))
    return rounded(st.kolmogorov_smirnov(halves, ~F.col("late"), "price", ["symbol"]).select("symbol", "statistic"))
