"""Queries over ticks, candles and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import indicators as ind
from tidewright.functions.windows import rounded
from tidewright.operators import candles as cd
from tidewright.operators import runs as rn
from tidewright.sources.ticks import candles_by_count, candles_by_time, epoch, ticks

DAY = 86_400
T = """t as (
  select event_type as symbol, ts, event_id, value as price, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events)"""
D = T + """,
d as (select *, price - lag(price) over (partition by symbol order by i) as d from t)"""
TC = T + """,
c as (
  select symbol, i // 10 as c, min(epoch_us(ts) // 1000000) as epoch, arg_min(price, i) as open, max(price) as high, min(price) as low, arg_max(price, i) as close, count(*) as n
  from t group by all)"""
R = D + """,
g as (select *, sign(d)::int as sign, case when d is not null and (d = 0 or sign(d) is distinct from lag(sign(d)) over (partition by symbol order by i)) then i end as b from d),
r as (select *, case when sign is not null then i - max(b) over (partition by symbol order by i) + 1 end as run_length from g)"""
E3 = R + """,
w as (select *, floor(epoch(lag(ts, 3) over (partition by symbol order by i)))::bigint as s from r),
e as (
  select symbol || '::' || sign || '::' || s as event_key, symbol, sign as direction, 3::bigint as run_length, s as run_start_epoch,
    floor(epoch(ts))::bigint as detected_at, price as trigger_price, i
  from w where sign <> 0 and run_length % 3 = 0)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {T} select symbol, (epoch_us(ts) // 1000000 // {DAY}) * {DAY} as epoch, arg_min(price, i) as open, max(price) as high, min(price) as low, arg_max(price, i) as close, count(*) as n from t group by 1, 2")
def candles_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_by_time(ticks(spark, sf_dir), DAY)


@query(f"with {TC} select * from c")
def candles_tick_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_by_count(ticks(spark, sf_dir))


@query(f"""with {TC} select symbol, count(*) as candle_count, count(*) filter (close >= open) as bullish_count, count(*) filter (close < open) as bearish_count,
  round(avg(abs(close - open)), 6) as avg_body_size, round(avg(high - low - abs(close - open)), 6) as avg_wick_size,
  (array_agg(c order by high - low desc, c))[1] as largest_candle, (array_agg(c order by high - low, c))[1] as smallest_candle,
  max(high) as highest_high, min(low) as lowest_low, max(epoch) - min(epoch) as duration_seconds,
  round((arg_max(close, c) - arg_min(open, c)) / arg_min(open, c) * 100, 6) as momentum_pct, round(stddev_pop(high - low) / avg(high - low) * 100, 6) as volatility_pct
from c group by symbol""")
def candle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cd.statistics(candles_by_count(ticks(spark, sf_dir)), "c"))


@query(f"""with {TC}, f as (select *, case when high = low then 1e-9 else high - low end as s from c),
o as (select *, ((close - low) / s - 0.5::double) * 2 * s as dl from f),
a as (select symbol, arg_max(dl, c) as delta, sum(dl) as cvd, floor(count(*) filter (close >= open) * 100::double / count(*) + 0.5)::bigint as imbalance_pct, count(*) as volume,
  abs(arg_max(close, c) - arg_min(open, c)) / sum(s) as absorption, sum(greatest(dl, 0)) as b, sum(greatest(-dl, 0)) as x from o group by symbol)
select symbol, round(delta, 6) as delta, round(cvd, 6) as cvd, imbalance_pct, volume, round(absorption, 6) as absorption, round(100 * b / (b + x), 6) as buying_pressure_pct,
  round(100 - 100 * b / (b + x), 6) as selling_pressure_pct from a""")
def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cd.order_flow(candles_by_count(ticks(spark, sf_dir)), "c"))


@query(f"""with {D}, b as (
  select symbol, (epoch_us(ts) // 1000000 // {DAY}) * {DAY} as start, count(*) filter (d > 0) as up_ticks, count(*) filter (d < 0) as down_ticks, count(*) as ticks,
    coalesce(sum(d) filter (d > 0), 0) as up_mag, coalesce(sum(-d) filter (d < 0), 0) as down_mag from d group by 1, 2),
s as (select *, up_mag + down_mag as m, avg(up_mag + down_mag) over (partition by symbol order by start rows between 10 preceding and 1 preceding) as usual,
  floor((0.4::double * (up_ticks - down_ticks) / (up_ticks + down_ticks) + 0.6::double * (up_mag - down_mag) / (up_mag + down_mag)) * 100 + 0.5)::bigint as score from b),
i as (select *, m / coalesce(usual, m) as intensity from s)
select symbol, start, up_ticks, down_ticks, ticks, round(up_mag, 6) as up_mag, round(down_mag, 6) as down_mag, score, round(intensity, 6) as intensity,
  case when abs(score) >= 60 and intensity >= 1.3 then case when score > 0 then 'STRONG BUY AGGRESSION' else 'STRONG SELL AGGRESSION' end
    when abs(score) >= 35 then case when score > 0 then 'MODERATE BUY PRESSURE' else 'MODERATE SELL PRESSURE' end
    when abs(score) >= 15 then case when score > 0 then 'MILD BUY BIAS' else 'MILD SELL BIAS' end else 'NEUTRAL' end as verdict
from i""")
def aggression_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cd.aggression(ticks(spark, sf_dir), DAY))


@query(f"with {T} select symbol, i, event_id, price from t qualify row_number() over (partition by symbol order by i desc) <= 800")
def bounded_tick_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.newest(ticks(spark, sf_dir).select("symbol", "i", "event_id", "price"), 800, "i")


@query(f"with {TC} select * from c where epoch + 3600 <= 1705000000")
def replay_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.before(candles_by_count(ticks(spark, sf_dir)), 1_705_000_000, 3600)


@query(f"""with {T}, g as (select *, epoch_ms(ts) - epoch_ms(lag(ts) over (partition by symbol order by i)) > 3600000 as apart from t),
s as (select *, sum(case when apart then 1 else 0 end) over (partition by symbol order by i) as session from g)
select symbol, session::bigint as session, count(*) as n, min(i) as first_i, max(i) as last_i from s group by 1, 2""")
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rn.sessions(ticks(spark, sf_dir), 3_600_000)
    return rows.groupBy("symbol", "session").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query(f"with {E3} select * from e")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.runs(ticks(spark, sf_dir), 3)


@query(f"with {E3} select * from e where event_key not in (select event_key from e where i % 2 = 0)")
def run_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rn.runs(ticks(spark, sf_dir), 3)
    return rn.backfill(found, found.filter("i % 2 = 0"))


@query(f"""with {E3} select *, lag(event_key) over w as previous_event, (detected_at - lag(detected_at) over w) * 1000 as time_gap, i - lag(i) over w as tick_gap,
  case when lag(direction) over w is not null then (direction <> lag(direction) over w)::int end as alternating from e window w as (partition by symbol order by i)""")
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.linked(rn.runs(ticks(spark, sf_dir), 3))


@query(f"""with {E3}, l as (select e.*, unnest(range(1, 6))::int as lead_time from e)
select l.*, t.price as later_price, sign(t.price - l.trigger_price)::int as outcome from l join t on t.symbol = l.symbol and t.i = l.i + l.lead_time""")
def lead_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ticks(spark, sf_dir)
    return rn.outcomes(rn.runs(stream, 3), stream)


@query(f"with {R} select symbol, i, sign, run_length from r")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.run_lengths(ticks(spark, sf_dir)).select("symbol", "i", "sign", "run_length")


def _last(n: int) -> str:
    return f"(partition by symbol order by i rows between {n - 1} preceding and current row)"


@query(f"""with {D}, x as (select *, coalesce(d, 0) as d0, lag(d) over (partition by symbol order by i) as db from d),
v as (select *,
  avg(price) over {_last(14)} as m14, avg(price) over {_last(20)} as m20, list(price) over {_last(20)} as l20, list(price) over {_last(14)} as l14, list(d) over {_last(30)} as d30,
  list(d) over {_last(20)} as d20, stddev_pop(price) over {_last(20)} as s20, max(price) over {_last(20)} as h20, min(price) over {_last(20)} as n20,
  max(price) over {_last(14)} as h14, min(price) over {_last(14)} as n14, stddev_pop(d0) over {_last(14)} as sd0, max(d0) over {_last(14)} = min(d0) over {_last(14)} as f0,
  lag(price, 10) over (partition by symbol order by i) as p10, count(*) filter (d > 0) over {_last(20)} as u, count(*) filter (d < 0) over {_last(20)} as dn, count(*) filter (d = 0) over {_last(20)} as z,
  list(d) over {_last(19)} as a19, list(db) over {_last(19)} as b19 from x),
q as (select *, list_avg(d30) as dm, list_stddev_pop(d30) as ds, list_avg(d20) as e1, list_stddev_pop(d20) as es, list_max(d20) = list_min(d20) as ef from v),
h as (select *, list_transform(range(1, 31), lambda k: list_sum(d30[1:k]) - k * dm) as cum from q)
select symbol, i,
  round(case when i >= 13 then m14 end, 6) as sma,
  round(case when i >= 13 then list_sum(list_transform(l14, lambda x, k: x * k)) / 105 end, 6) as wma,
  round(case when i >= 19 then case when h20 = n20 then 0 else (price - m20) / (0.015::double * list_avg(list_transform(l20, lambda x: abs(x - m20)))) end end, 6) as cci,
  round(price - p10, 6) as momentum, round(100 * ((price - p10) / nullif(p10, 0)), 6) as roc,
  round(case when i >= 19 then 4 * case when h20 = n20 then 0 else s20 end / nullif(m20, 0) end, 6) as bollinger_width,
  round(case when i >= 19 and h20 > n20 then (price - m20 + 2 * s20) / (4 * s20) end, 6) as bollinger_position,
  round(case when i >= 13 then case when f0 then 0 else sd0 end end, 6) as volatility,
  round(case when i >= 13 then h14 - n14 end, 6) as range, round(case when i >= 19 and h20 > n20 then (price - m20) / s20 end, 6) as zscore,
  round(case when i >= 20 then -(coalesce(u / 20 * log2(nullif(u / 20, 0)), 0) + coalesce(dn / 20 * log2(nullif(dn / 20, 0)), 0) + coalesce(z / 20 * log2(nullif(z / 20, 0)), 0)) end, 6) as entropy,
  round(case when i >= 30 and ds > 0 then ln((list_max(cum) - list_min(cum)) / ds) / ln(30) end, 6) as hurst,
  round(case when i >= 30 and ds > 0 then 2 - ln((list_max(cum) - list_min(cum)) / ds) / ln(30) end, 6) as fractal_dimension,
  round(case when i >= 20 then (u - dn) / 20 end, 6) as tick_imbalance,
  round(case when i >= 20 and u + dn > 0 then -(coalesce(u / (u + dn) * log2(nullif(u / (u + dn), 0)), 0) + coalesce(dn / (u + dn) * log2(nullif(dn / (u + dn), 0)), 0)) end, 6) as directional_entropy,
  round(case when i >= 13 then case when h14 = n14 then 50 else (price - n14) / (h14 - n14) * 100 end end, 6) as stochastic_k,
  round(case when i >= 20 then list_sum(list_transform(list_zip(a19, b19), lambda p: (p[1] - list_avg(a19)) * (p[2] - list_avg(b19)))) / 19 / (list_stddev_pop(a19) * list_stddev_pop(b19)) end, 6) as autocorrelation,
  round(case when i >= 20 then case when ef then 0 else list_avg(list_transform(d20, lambda x: (x - e1) ** 3)) / es ** 3 end end, 6) as skewness,
  round(case when i >= 20 then case when ef then -3 else list_avg(list_transform(d20, lambda x: (x - e1) ** 4)) / es ** 4 - 3 end end, 6) as kurtosis
from h""")
def indicators_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.windowed(ticks(spark, sf_dir)).drop("ts", "event_id", "price"))


_K = {n: f"(2::double / {n + 1})" for n in (9, 12, 14, 20, 26)}


@query(f"""with recursive {D}, x as (
  select *, greatest(coalesce(d, 0), 0) as up, greatest(-coalesce(d, 0), 0) as dn, avg(price) over {_last(20)} as m20 from d),
s as (
  select symbol, i, price, m20, price as e14, null::double as slope, price as e12, price as e26, 0::double as sig, 0::double as line, 0::double as pu, 0::double as md, 0::double as tr, 0::double as tr20,
    0::double as adx, 0::double as ga, 0::double as lo from x where i = 0
  union all
  select symbol, i, price, m20, e14n, e14n - e14, e12n, e26n, k9 * (e12n - e26n) + (1 - k9) * sig, e12n - e26n, pun, mdn, trn, tr20n,
    {_K[14]} * (case when trn = 0 or pun + mdn = 0 then 0 else 100 * abs(100 * pun / trn - 100 * mdn / trn) / (100 * pun / trn + 100 * mdn / trn) end) + (1 - {_K[14]}) * adx,
    case when i <= 14 then ga + up / 14 else (ga * 13 + up) / 14 end, case when i <= 14 then lo + dn / 14 else (lo * 13 + dn) / 14 end
  from (
    select x.symbol, x.i, x.price, x.m20, x.up, x.dn, s.e14, s.sig, s.adx, s.ga, s.lo, {_K[9]} as k9,
      {_K[14]} * x.price + (1 - {_K[14]}) * s.e14 as e14n, {_K[12]} * x.price + (1 - {_K[12]}) * s.e12 as e12n, {_K[26]} * x.price + (1 - {_K[26]}) * s.e26 as e26n,
      {_K[14]} * x.up + (1 - {_K[14]}) * s.pu as pun, {_K[14]} * x.dn + (1 - {_K[14]}) * s.md as mdn, {_K[14]} * (x.up + x.dn) + (1 - {_K[14]}) * s.tr as trn,
      {_K[20]} * (x.up + x.dn) + (1 - {_K[20]}) * s.tr20 as tr20n
    from s join x on x.symbol = s.symbol and x.i = s.i + 1))
select symbol, i, round(e14, 6) as ema, round(slope, 6) as ema_slope, round(line - sig, 6) as macd,
  round(case when i >= 14 then case when lo = 0 then 100 else 100 - 100 / (1 + ga / lo) end end, 6) as rsi, round(adx, 6) as adx, round(tr, 6) as atr,
  round(case when i >= 19 then 2 * tr20 / m20 end, 6) as keltner_width from s""")
def indicators_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.recursive(ticks(spark, sf_dir)).drop("price"))
