"""Queries over versioned stores, live candles, learning, lineages, provenance and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import learning as ln
from tidewright.operators import lineages as lg
from tidewright.operators import provenance as pv
from tidewright.operators import runs as rn
from tidewright.operators.reconciliation import Sweep
from tidewright.sources.shared import place, stored
from tidewright.sources.ticks import candles_by_count, table, ticks
from tidewright.sources.versions import Versions
from tidewright.streaming import bars, live

from .streams import E3, ORACLES as STREAMS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The priorities of orders, in order of their names.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("select o_custkey as customer, min(o_orderpriority) as priority, arg_min(o_orderkey, o_orderpriority || lpad(o_orderkey::varchar, 20, '0')) as order_id, count(distinct o_orderpriority)::int as writers from orders group by 1")
def first_written_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that keeps the first order of each customer, offered one priority after the other; how many writers had something."""
    store = Versions(spark, place(spark, "first-orders"), "customer long, priority string, order_id long", ["customer"])
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority")).agg(F.min("o_orderkey").alias("order_id"))
    # each is written by itself: together, a task of the last stage would hold the sorts of all five at once
    offered = [stored(store.write_once(orders.filter(F.col("priority") == p)).select("customer"), "offered") for p in PRIORITIES]
    writers = reduce(DataFrame.unionByName, offered).groupBy("customer").agg(F.count("*").cast("int").alias("writers"))
    return store.read().join(writers, "customer")


@query("""with t as (select l_returnflag as flag, l_suppkey * 20 + l_linenumber as part, min(l_orderkey) as by_order from lineitem group by 1, 2),
f as (select *, min(flag) over (partition by part) = flag as first, part in (select p_partkey from part) as there from t)
select part, flag as consumed_by, by_order, there and first as ok, case when not there then 'not-found' when not first then 'precondition-failed' end as reason from f""")
def consumed_lockboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockboxes, one for each part, that three takers want one after the other: the first to ask gets one."""
    store = Versions(spark, place(spark, "lockboxes"), "part long, allocated_by string, consumed_at long, consumed_by string", ["part"], guard="consumed_at")
    store.add(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("allocated_by"), F.lit(None).cast("long").alias("consumed_at"), F.lit(None).cast("string").alias("consumed_by")))
    wanted = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("part"), F.col("l_returnflag").alias("consumed_by")).agg(F.min("l_orderkey").alias("by_order"))
    ends = []
    for flag in ("A", "N", "R"):
        asked = wanted.filter(F.col("consumed_by") == flag)
        ends.append(asked.join(store.consume_once(asked.select("part", "consumed_by"), 1), "part"))
    return reduce(DataFrame.unionByName, ends).select("part", "consumed_by", "by_order", "ok", "reason")


_MESSAGES = """m as (select event_type as symbol, 3600::bigint as granularity, epoch_us(ts) // 3600000000 * 3600 as epoch, value as open, value + event_id % 5 as high, value - event_id % 3 as low, value + event_id % 2 as close,
  2 * event_id + case when event_id % 17 = 0 then 8001 else 0 end as seq from events)"""


@query(f"""with {_MESSAGES}, a as (select *, max(epoch) over (partition by symbol order by seq rows between unbounded preceding and 1 preceding) as newest from m)
select symbol, granularity, epoch, arg_max(open, seq) as open, arg_max(high, seq) as high, arg_max(low, seq) as low, arg_max(close, seq) as close, max(seq) as seq from a where newest is null or epoch >= newest group by 1, 2, 3""")
def live_candle_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles by the hour as messages bring and correct them, one in seventeen of which comes late."""
    rows = spark.readStream.schema(bars.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at, k = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600, F.col("event_id")
    messages = rows.select(
        F.col("event_type").alias("symbol"), F.lit(3600).cast("long").alias("granularity"), at.cast("long").alias("epoch"), F.col("value").alias("open"), (F.col("value") + k % 5).alias("high"),
        (F.col("value") - k % 3).alias("low"), (F.col("value") + k % 2).alias("close"), (2 * k + F.when(k % 17 == 0, 8001).otherwise(0)).cast("long").alias("seq"),
    )
    store = Versions(spark, place(spark, "live-candles"), live.CANDLE, ["symbol", "granularity", "epoch"])
    live.upserted(live.live_candles(messages), store, place(spark, "live-progress")).trigger(availableNow=True).start().awaitTermination()
    return store.read()


@query(f"select * from ({STREAMS['aggression_candles']}) qualify start < max(start) over (partition by symbol)")
def streaming_aggression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggression of each day that has ended, from the stream."""
    return rounded(bars.run_once(live.aggression(bars.tick_stream(spark, sf_dir), 86_400), "aggression"))


_DIMENSIONS = {"trend": ("close", "open"), "momentum": ("close", "before"), "structure": ("high", "before_high"), "genome": ("low", "before_low")}


def _evidence(stream: DataFrame) -> DataFrame:
    """Scores of each candle of ten ticks, known at its last: the signs of what moved within it and since the one before."""
    c = candles_by_count(stream).filter("n = 10")
    before = c.select("symbol", (F.col("c") + 1).alias("c"), F.col("close").alias("before"), F.col("high").alias("before_high"), F.col("low").alias("before_low"))
    rows = c.join(before, ["symbol", "c"])
    scores = F.create_map(*[x for k, (a, b) in _DIMENSIONS.items() for x in (F.lit(k), F.signum(F.col(a) - F.col(b)))])
    return rows.select("symbol", (F.col("c") * 10 + 9).alias("i"), scores.alias("dimensions"))


def _trades(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A trade opens at each run of three moves, in its direction, and closes seven ticks later; of those at odd ticks nobody saw
    the opening."""
    events = rn.runs(stream, 3)
    later = stream.select("symbol", (F.col("i") - 7).alias("i"), F.col("price").alias("_later"))
    rows = events.join(later, ["symbol", "i"]).select(F.col("event_key").alias("trade"), "symbol", "i", "direction", ((F.col("_later") - F.col("trigger_price")) * F.col("direction")).alias("pnl"))
    closed = rows.select("trade", "symbol", (F.col("i") + 7).alias("i"), "direction", (F.col("pnl") > 0).alias("won"), "pnl")
    return rows.filter("i % 2 = 0").select("trade", "symbol", "i"), closed


_LOG = E3 + """,
cs as (select symbol, i // 10 as c, arg_min(price, i) as open, max(price) as high, min(price) as low, arg_max(price, i) as close from t group by all having count(*) = 10),
ev as (select a.symbol, a.c * 10 + 9 as i, sign(a.close - a.open) as trend, sign(a.close - b.close) as momentum, sign(a.high - b.high) as structure, sign(a.low - b.low) as genome from cs a join cs b on b.symbol = a.symbol and b.c = a.c - 1),
tr as (select e.event_key as trade, e.symbol, e.i, e.direction, (t.price - e.trigger_price) * e.direction as pnl from e join t on t.symbol = e.symbol and t.i = e.i + 7),
op as (select tr.trade, ev.* exclude (symbol, i) from tr asof join ev on tr.symbol = ev.symbol and tr.i >= ev.i where tr.i % 2 = 0),
cl as (select tr.trade, ev.* exclude (symbol, i) from (select * replace (i + 7 as i) from tr) tr asof join ev on tr.symbol = ev.symbol and tr.i >= ev.i where tr.trade not in (select trade from op)),
lg as (select tr.*, pnl > 0 as won, k.* exclude (trade) from tr join (select *, false as approximate from op union all select *, true from cl) k using (trade))"""


@query(f"with {_LOG} select trade, symbol, i + 7 as i, direction, won, round(pnl, 6) as pnl, approximate, trend, momentum, structure, genome from lg")
def learning_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with the evidence that stood when they were opened or, where nobody saw that, when they closed."""
    stream = ticks(spark, sf_dir)
    log = ln.learned(*_trades(stream), _evidence(stream))
    return rounded(log.select("trade", "symbol", "i", "direction", "won", "pnl", "approximate", *[F.col("dimensions")[k].alias(k) for k in _DIMENSIONS]))


@query(f"""with {_LOG}, al as (select count(*) as n, avg(won::int) as rate from lg), ud as (select dimension, score, direction, won from (unpivot lg on trend, momentum, structure, genome into name dimension value score) where score <> 0),
gd as (select dimension, count(*) as relevant, count(*) filter (score = direction) as agreeing, count(*) filter (score = direction and won) as right_ from ud group by 1),
bw as (select * from (values ('trend', 0.15::double), ('momentum', 0.12::double), ('structure', 0.15::double), ('liquidity', 0.10::double), ('order_flow', 0.15::double), ('history', 0.13::double), ('genome', 0.10::double), ('alignment', 0.10::double)) v(dimension, base)),
wt as (select dimension, coalesce(relevant, 0) as relevant, coalesce(agreeing, 0) as agreeing, n as sample_size, n >= 20 as calibrated,
  base * case when n >= 20 and relevant >= 5 and agreeing >= 3 then least(greatest(1 + (right_ / agreeing - rate) * 2, 0.5), 1.5) else 1 end as raw from bw left join gd using (dimension), al)
select dimension, relevant, agreeing, round(case when calibrated then raw / sum(raw) over () else raw end, 6) as weight, calibrated, sample_size from wt""")
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ticks(spark, sf_dir)
    return rounded(ln.calibrated(ln.learned(*_trades(stream), _evidence(stream))))


_ATTEMPTS = """ats as (select o_custkey % 40 as lineage, o_orderkey as hypothesis, o_custkey * 7 % 13 as seq, case when o_orderkey % 11 > 0 then o_totalprice / 500000 end as power, o_orderstatus = 'F' as drift,
  case when o_orderpriority < '4' then o_orderpriority end as approved_by, case when o_orderkey % 6 > 0 then 'rationale' else '' end as rationale from orders),
mt as (select *, coalesce(power < 0.8 and drift and approved_by is not null and rationale <> '', false) as met from ats),
gt as (select *, met and row_number() over (partition by lineage, met order by seq, hypothesis) = 1 as chosen from mt)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an attempt of a hypothesis in one of forty lineages."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("lineage"), k.alias("hypothesis"), (F.col("o_custkey") * 7 % 13).alias("seq"), F.when(k % 11 > 0, F.col("o_totalprice") / 500_000).alias("power"), (F.col("o_orderstatus") == "F").alias("drift"),
        F.when(F.col("o_orderpriority") < "4", F.col("o_orderpriority")).alias("approved_by"), F.when(k % 6 > 0, "rationale").otherwise("").alias("rationale"),
    )


@query(f"""with {_ATTEMPTS} select lineage, hypothesis, seq, case when chosen then 'Indeterminate' else 'Rejected' end as classification,
case when chosen then '{lg.REASONS["granted"]}' when met then '{lg.REASONS["used"]}' else '{lg.REASONS["criteria"]}' end as reason from gt""")
def indeterminate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.gated(_attempts(spark, sf_dir)).select("lineage", "hypothesis", "seq", "classification", "reason")


@query(f"""with {_ATTEMPTS} select lineage, count(*) as generations, max(hypothesis % 1000) as newest_generation, count(*) filter (not chosen) as failures, count(*) filter (chosen) as indeterminate from gt group by 1""")
def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir)
    return lg.counted(rows.select("lineage", "hypothesis", (F.col("hypothesis") % 1000).alias("generation")), lg.gated(rows))


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers derived from those with half their number, in order of their numbers. Every fiftieth, from 25 on, is what the one
    with a quarter of its number was derived from: of these edges every other comes before all others, the rest at the end."""
    nodes = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id"))
    n = F.col("id")
    tree = nodes.select(n.alias("child"), F.floor(n / 2).alias("parent"), n.alias("seq"))
    back = nodes.filter("id % 50 = 25").select(F.floor(n / 4).alias("child"), n.alias("parent"), F.when(n % 100 == 25, -n).otherwise(n + 10**9).alias("seq"))
    return nodes, tree.unionByName(back)


@query("""with n as (select c_custkey + 1 as id from customer)
select id as child, id // 2 as parent, id as seq, case when id = 1 then 'unknown' when id % 100 = 25 then 'cycle' end as refused from n
union all select id // 4, id, case when id % 100 = 25 then -id else id + 1000000000 end, case when id % 100 = 75 then 'cycle' end from n where id % 50 = 25""")
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph with cycles in it. What its SQL says follows from how it is made: a customer with an early edge back can't
    be derived from its half any more, as that was derived from its quarter; late edges back close cycles themselves."""
    return pv.admitted(*_derived(spark, sf_dir))


@query("""with recursive n as (select c_custkey + 1 as id from customer), a as (select id // 2 as node, id as descendant, 1 as distance from n where id > 1 union all select node // 2, descendant, distance + 1 from a where node > 1)
select node, count(*) as descendants, max(distance)::int as depth from a group by 1""")
def provenance_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    edges = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id")).filter("id > 1").select(n.alias("child"), F.floor(n / 2).alias("parent"))
    return pv.descendants(edges).groupBy("node").agg(F.count("*").alias("descendants"), F.max("distance").alias("depth"))


@query("""select 'orders without customer' as stage, true as ok, count(*) as value, null::varchar as error, 'partial' as status from orders where o_custkey not in (select c_custkey from customer)
union all select 'customers without order', true, count(*), null, 'partial' from customer where c_custkey not in (select o_custkey from orders)
union all select 'lines without part', true, count(*), null, 'partial' from lineitem where l_partkey not in (select p_partkey from part)
union all select 'labels without document', true, count(*), null, 'partial' from labels where doc_id not in (select doc_id from documents)
union all select 'a table that is gone', false, null, 'AnalysisException', 'partial'""")
def reconciliation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refers to rows that aren't there, one stage for each pair of tables; one stage fails and the others don't."""
    sweep = Sweep(spark)

    def missing(a: str, key: str, b: str, other: str):
        return lambda: table(spark, sf_dir, a).join(table(spark, sf_dir, b).select(F.col(other).alias(key)), key, "left_anti").count()

    sweep.register("orders without customer", missing("orders", "o_custkey", "customer", "c_custkey"))
    sweep.register("customers without order", missing("customer", "c_custkey", "orders", "o_custkey"))
    sweep.register("lines without part", missing("lineitem", "l_partkey", "part", "p_partkey"))
    sweep.register("labels without document", missing("labels", "doc_id", "documents", "doc_id"))
    sweep.register("a table that is gone", missing("orders", "o_custkey", "no_such_table", "key"))
    return sweep.run()
