"""Queries over scores and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import indicators as ind
from tidewright.functions.indicators import windowed
from tidewright.functions.windows import rounded
from tidewright.operators import bursts as bs
from tidewright.operators import campaign as cp
from tidewright.operators import discovery as ds
from tidewright.operators import scoring as sc
from tidewright.operators import search as se
from tidewright.sources.shared import place, stored
from tidewright.sources.ticks import candles_by_count, candles_by_time, index_by_day, table, ticks
from tidewright.streaming import bars, live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ticks(spark, sf_dir)
    return sc.summary(candles_by_count(stream), candles_by_count(stream, 5))


@query()
def probability_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir)
    return rounded(sc.probability(rows, F.when(F.col("trend") == "up", "bullish").when(F.col("trend") == "down", "bearish").otherwise("neutral")))


@query()
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.rules(_summary(spark, sf_dir)))


@query()
def market_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ladders from rules and trend to a bias."""
    rows = stored(_summary(spark, sf_dir), "summary")
    return sc.biases(rows, sc.rules(rows))


@query()
def cascade_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each symbol and timeframe, on candles numbered within it."""
    from functools import reduce

    stream = ticks(spark, sf_dir)
    each = []
    for name, seconds in sc.CASCADE.items():
        c = index_by_day(candles_by_time(stream, seconds), ["symbol"], ["epoch"], F.floor(F.col("epoch") / 86400), "c")
        each.append(sc.cascade(stored(c, "candles"), name))
    return reduce(DataFrame.unionByName, each)


@query("""with t as (select o_orderkey as id, case when o_orderstatus = 'F' then 1 else -1 end as won, o_orderkey % 3 - 1 as trend, o_custkey % 5 - 2 as momentum, o_orderkey % 7 - 3 as genome from orders),
u as (select won, dimension, score from (unpivot t on trend, momentum, genome into name dimension value score) where score <> 0),
g as (select dimension, count(*) as relevant, count(*) filter (sign(score) = won) as agreeing from u group by 1),
r as (select *, case dimension when 'trend' then 0.15 when 'momentum' then 0.12 else 0.10 end * case when relevant >= 5 and agreeing >= 3 then least(greatest(2 * agreeing / relevant, 0.5), 1.5) else 1 end as raw from g)
select dimension, relevant, agreeing, round((raw / sum(raw) over ())::double, 6) as weight from r""")
def calibrated_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    trades = o.select(F.col("o_orderkey").alias("trade_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("won"), *[(F.col(c) % m - k).cast("double").alias(n) for n, c, m, k in (("trend", "o_orderkey", 3, 1), ("momentum", "o_custkey", 5, 2), ("genome", "o_orderkey", 7, 3))])
    return rounded(sc.calibrated(trades, ["trend", "momentum", "genome"]))


def _registry_sql() -> str:
    """The candidates written out from the names alone: neighbours by number, contexts round and round."""
    names = [("indicator", n) for n in ds.INDICATORS] + [("state", n) for n in ds.STATE_NAMES] + [("proxy", n) for n in ds.PROXY_NAMES] + [("event", n) for n in ds.EVENT_NAMES]
    listed = ", ".join(f"({k}, '{t}', '{n}')" for k, (t, n) in enumerate(names))
    contexts = "[" + ", ".join(f"'{n}'" for n in ds.CONTEXT_NAMES) + "]"
    return f"""with r(k, type, name) as (values {listed}), i as (select type, name, unnest([10, 14, 20, 30]) as period, [name] as parts, null::varchar as context from r where type = 'indicator'),
o as (select type, name, case type when 'state' then 20 when 'proxy' then 10 end as period, [name] as parts, null::varchar as context, k from r where type <> 'indicator'),
c as (select 'composite' as type, a.name || '+' || b.name as name, a.period, [a.name, b.name] as parts, null::varchar as context from o a join o b on b.k = a.k + 1 and b.type = a.type where a.type <> 'event'),
h as (select 'conditional' as type, name || '|' || {contexts}[(row_number() over (order by k) - 1) % {len(ds.CONTEXT_NAMES)} + 1] as name, period, parts, {contexts}[(row_number() over (order by k) - 1) % {len(ds.CONTEXT_NAMES)} + 1] as context from o where type in ('state', 'proxy')),
u as (select * from i union all select type, name, period, parts, context from o union all select * from c union all select * from h)
select type, name, period::int as period, array_to_string(parts, ',') as parts, context, (select count(*) from events) as ticks, sha256('{{"name":"' || name || '","parts":["' || array_to_string(parts, '","') || '"],' || case when period is not null then '"period":' || period || ',' else '' end || '"type":"' || type || '"}}') as fingerprint from u"""


@query(_registry_sql())
def candidate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, with how many ticks its candidates are to be evaluated on."""
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("ticks"))
    return ds.candidates(spark).withColumn("parts", F.array_join("parts", ",")).join(F.broadcast(n))


@query("""with a as (select avg(l_extendedprice) as m, stddev_pop(l_quantity) / sqrt(count(*)) as h from lineitem), g as (select unnest(range(5, 50, 5))::double as "at"),
w as (select "at", exp(-0.5::double * (((l_quantity - "at") / h) ** 2)) as w, l_extendedprice / 1000 as y from lineitem, a, g),
s as (select "at", sum(w * y) / sum(w) as mean, sum(w * y * y) / sum(w) as q from w group by 1)
select "at", round(mean, 3) as mean, round(greatest(q - mean * mean, 0), 3) as variance, round(mean + 1.96::double * sqrt(greatest(q - mean * mean, 0)), 3) as upper from s""")
def surrogate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return rounded(ds.surrogate(seen, spark.range(5, 50, 5).select(F.col("id").cast("double").alias("x")), "x", "y"), places=3)


@query()
def thompson_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("arm")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count_if(F.col("o_orderstatus") != "F").alias("lost"))
    return ds.thompson(arms, "arm", "won", "lost")


@query()
def novel_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ind.windowed(ticks(spark, sf_dir), ["momentum", "volatility", "entropy", "zscore", "autocorrelation"])
    return rounded(ds.novel(rows, ["momentum", "volatility", "entropy", "zscore", "autocorrelation"], spark.createDataFrame([([0.0] * 5,)], "centre array<double>")))


@query("""with e as (select p_brand as family, count(*) as pulls, count(*) filter (p_size > 25) as reward, 1 - count(*) filter (p_size > 25) / count(*) as elimination_rate from part group by 1)
select family, pulls, reward, round(elimination_rate, 6) as elimination_rate, row_number() over (order by elimination_rate nulls first, family)::int as rank from e""")
def family_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.lit(1).alias("evaluated"), (F.col("p_size") > 25).cast("int").alias("promoted"))
    return rounded(ds.prioritized(rounds))



_CONDITIONS = ("l_quantity > 25", "l_discount >= 0.05", "l_tax < 0.04", "l_linenumber <= 3")
_LIFT = f"""with b as (select l_extendedprice::double as y, {', '.join(f'({c}) as c{k}' for k, c in enumerate(_CONDITIONS))} from lineitem), m as (select unnest(range(16)) as m),
l as (select m, avg(y) - (select avg(y) from b) as lift, count(*) as n from b, m where {' and '.join(f'(m & {1 << k} = 0 or c{k})' for k in range(4))} group by 1) select round(max(case when n >= 30 then lift else 0 end), 6) as lift from l"""


def _lift(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), *[F.expr(c).alias(f"c{k}") for k, c in enumerate(_CONDITIONS)])
    return lambda masks: se.lift(rows, [F.col(f"c{k}") for k in range(4)], "y", masks)


@query(_LIFT)
def evolutionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions that raise the mean price most, by evolution; SQL tries all sixteen sets."""
    return rounded(spark.createDataFrame([(se.evolved(_lift(spark, sf_dir), 4)[1],)], "lift double"))


@query(_LIFT)
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tree search: of the sets that were played out the best."""
    known: dict = {}
    score = _lift(spark, sf_dir)

    def remembered(masks):
        known.update(score(masks))
        return {m: known[m] / 10_000 for m in masks}

    se.tree_search(remembered, 4)
    return rounded(spark.createDataFrame([(max(known.values()),)], "lift double"))



@query()
def burst_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bs.metrics(ticks(spark, sf_dir)))


@query()
def burst_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.signals(ticks(spark, sf_dir))


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that persists, unlike the raw one: of each tick from the 14th on the mean of it and the 13 before it."""
    rows = windowed(ticks(spark, sf_dir), ["sma"], sma=14).filter("sma is not null")
    return rows.select("symbol", (F.col("i") - 13).alias("i"), "ts", "event_id", F.col("sma").alias("price"))


@query()
def burst_signals_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.signals(_smooth(spark, sf_dir))


@query()
def streaming_burst_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream with state, once they are settled."""
    rows = _smooth(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price")
    folder = place(spark, "smoothed")
    rows.write.parquet(folder)
    return bars.run_once(live.signals(spark.readStream.schema(rows.schema).parquet(folder)), "signals")
