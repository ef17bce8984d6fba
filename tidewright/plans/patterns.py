"""Queries over candle patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.functions.windows import rounded
from tidewright.operators import commentary as cm
from tidewright.operators import patterns as pt
from tidewright.sources.ticks import candles_by_count, ticks

from .streams import TC

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_by_count(ticks(spark, sf_dir))


L = TC + """,
k as (select *, greatest(open, close) as t, least(open, close) as b, abs(close - open) as body, close >= open as up, high - low as span from c),
l as (select *, lag(t) over w as t1, lag(b) over w as b1, lag(body) over w as body1, lag(up) over w as up1, lag(high) over w as h1, lag(low) over w as l1, lag(high, 2) over w as h2, lag(low, 2) over w as l2,
  lead(high) over w as hn1, lead(low) over w as ln1, lead(high, 2) over w as hn2, lead(low, 2) over w as ln2, avg(body) over (partition by symbol order by c rows between 10 preceding and 1 preceding) as usual
  from k window w as (partition by symbol order by c))"""
STICKS = """
select symbol, 'engulfing' as type, c, case when up then 'bullish' else 'bearish' end as direction from l where up <> up1 and t >= t1 and b <= b1 and body > body1
union all select symbol, 'outsideBar', c, case when up then 'bullish' else 'bearish' end from l where high > h1 and low < l1
union all select symbol, 'insideBar', c, 'none' from l where high <= h1 and low >= l1
union all select symbol, 'pinBar', c, case when b - low >= 2 * body and high - t <= 0.3::double * (b - low) then 'bullish' else 'bearish' end from l
  where body > 0 and ((b - low >= 2 * body and high - t <= 0.3::double * (b - low)) or (high - t >= 2 * body and b - low <= 0.3::double * (high - t)))
union all select symbol, 'doji', c, 'none' from l where span > 0 and body / span <= 0.1::double"""
SW = L + """,
s as (select symbol, c, 'high' as type, high as price from l where high > h1 and high > h2 and high > hn1 and high > hn2
  union all select symbol, c, 'low', low from l where low < l1 and low < l2 and low < ln1 and low < ln2)"""
# for each candle its past swings by correlated lookups rather than by frames
ST = SW + """,
o as (select *, row_number() over (partition by symbol order by c, type) as k from s),
h as (select l.symbol, l.c, (select max(o.k) from o where o.symbol = l.symbol and o.c < l.c) as k from l),
f as (select h.symbol, h.c, list(o.price order by o.k) filter (o.type = 'high') as hs, list(o.price order by o.k) filter (o.type = 'low') as ls
  from h join o on o.symbol = h.symbol and o.k between h.k - 3 and h.k group by 1, 2),
tr as (select symbol, c, case when len(hs) >= 2 and len(ls) >= 2 and hs[-1] > hs[-2] and ls[-1] > ls[-2] then 'up'
  when len(hs) >= 2 and len(ls) >= 2 and hs[-1] <= hs[-2] and ls[-1] <= ls[-2] then 'down' else 'none' end as trend from f),
x as (select l.symbol, l.c, l.high, l.low, l.close, tr.trend,
  (select arg_max(s.price, s.c) from s where s.symbol = l.symbol and s.type = 'high' and s.c < l.c) as sh,
  (select arg_max(s.price, s.c) from s where s.symbol = l.symbol and s.type = 'low' and s.c < l.c) as sl
  from l left join tr on tr.symbol = l.symbol and tr.c = l.c),
br as (
  select symbol, case when trend = 'down' then 'choch' else 'bos' end as type, c, 'bullish' as direction, sh as level from x where close > sh
  union all select symbol, case when trend = 'up' then 'choch' else 'bos' end, c, 'bearish', sl from x where close < sl
  union all select symbol, 'liquiditySweep', c, 'bearish', sh from x where high > sh and close < sh
  union all select symbol, 'liquiditySweep', c, 'bullish', sl from x where low < sl and close > sl)"""
ZN = """zn as (
  select symbol, 'fvg' as type, c, 'bullish' as direction, ln1 as top, h1 as bottom, c + 1 as confirmed_at from l where h1 < ln1
  union all select symbol, 'fvg', c, 'bearish', l1, hn1, c + 1 from l where l1 > hn1 and not h1 < ln1
  union all select m.symbol, 'orderBlock', o.c, case when m.up then 'bullish' else 'bearish' end, o.t, o.b, m.c from l m
    join l o on o.symbol = m.symbol and o.c = (select max(q.c) from l q where q.symbol = m.symbol and q.c < m.c and q.c >= m.c - 6 and q.up <> m.up)
    where m.c >= 10 and m.usual > 0 and m.body >= 2 * m.usual)"""


@query(f"with {L} {STICKS}")
def candlestick_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.candlesticks(candles(spark, sf_dir))


@query(f"""with {SW}, p as (select *, lag(price) over (partition by symbol, type order by c) as q from s)
select symbol, c, type, price, case when q is null then case type when 'high' then 'H' else 'L' end when type = 'high' then case when price > q then 'HH' else 'LH' end
  else case when price > q then 'HL' else 'LL' end end as label from p""")
def swing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.swing_labels(candles(spark, sf_dir))


@query(f"with {ST} select * from br")
def structure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.structure(candles(spark, sf_dir))


@query(f"with {L}, {ZN} select * from zn")
def zone_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.zones(candles(spark, sf_dir))


_NAMES = " ".join(f"when '{k}' then '{v}'" for k, v in pt.LABELS.items())


@query(f"""with {ST}, {ZN}, a as ({STICKS} union all select symbol, type, c, direction from br union all select symbol, type, c, direction from zn),
n as (select *, case type {_NAMES} end as label from a)
select *, case direction when 'none' then label || ' at candle ' || c when 'bullish' then 'Bullish ' || lower(label) || ' at candle ' || c else 'Bearish ' || lower(label) || ' at candle ' || c end as description from n""")
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.scan(candles(spark, sf_dir))


@query(f"""with {L}, n as (select * exclude (n), count(*) over (partition by symbol) as n, avg(span) over (partition by symbol order by c rows between 19 preceding and current row) as m from k),
g as (select a.symbol, a.c, a.n, a.close, a.up, list([case when b.span > 0 then b.body / b.span else 0 end, case when b.span > 0 then (b.high - b.t) / b.span else 0 end,
    case when b.span > 0 then (b.b - b.low) / b.span else 0 end, b.up::int * 2 - 1, b.span / a.m] order by b.c) as v
  from n a join k b on b.symbol = a.symbol and b.c between a.c - 2 and a.c where a.m > 0 group by all),
j as (select g.symbol, g.close, g.up::int * 2 - 1 as sg, (select close from k where k.symbol = g.symbol and k.c = g.c + 6) as after,
  list_sum(list_transform(range(1, 4), lambda i: (g.v[i][1] - z.v[i][1]) ** 2 + (g.v[i][2] - z.v[i][2]) ** 2 + (g.v[i][3] - z.v[i][3]) ** 2 + least(1, (g.v[i][5] - z.v[i][5]) ** 2 / 4)
    + case when g.v[i][4] <> z.v[i][4] then 0.5 else 0 end)) as far
  from g join g z on z.symbol = g.symbol and z.c = z.n - 1 where g.c >= 22 and g.c < g.n - 6),
o as (select symbol, count(*) as sample_size, count(*) filter (sg * (after - close) / close > 0.001) as continued, count(*) filter (sg * (after - close) / close < -0.001) as reversed from j where sqrt(far) <= 0.6 group by 1)
select z.symbol, z.up::int * 2 - 1 as current_direction, coalesce(sample_size, 0) as sample_size, coalesce(continued, 0) as continued, coalesce(reversed, 0) as reversed, coalesce(sample_size - continued - reversed, 0) as neutral,
  coalesce(floor(100::double * continued / sample_size + 0.5), 0)::bigint as continued_pct, coalesce(floor(100::double * reversed / sample_size + 0.5), 0)::bigint as reversed_pct
from g z left join o on o.symbol = z.symbol where z.c = z.n - 1 and z.n >= 39""")
def candle_genome_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.genome_analogs(candles(spark, sf_dir))


@query()
def historical_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.historical_analogs(candles(spark, sf_dir))


@query()
def similar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pt.similar_windows(candles(spark, sf_dir)))


@query(f"""with {L}, n as (select * exclude (n), count(*) over (partition by symbol) as n, max(high) over (partition by symbol order by c rows between 1 following and 20 following) as h from k)
select symbol, floor(greatest(5, least(95, 100::double * count(*) filter ((h - close) / close >= 0.05) / count(*))) + 0.5)::bigint as probability, count(*) as sample_size
from n where c < n - 20 and close <> 0 group by 1""")
def reach_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.reach(candles(spark, sf_dir))


@query(f"""with {SW}, n as (select symbol, arg_max(close, c) as now from c group by 1), j as (select s.*, now from s join n using (symbol))
select symbol, now, coalesce(arg_max(price, c) filter (type = 'low' and price <= now), arg_max(price, c) filter (type = 'low')) as support, coalesce(arg_max(price, c) filter (type = 'high' and price >= now), arg_max(price, c) filter (type = 'high')) as resistance,
  arg_max(price, c) filter (type = 'low' and price < now) as strict_support, arg_min(price, c) filter (type = 'high' and price > now) as first_resistance from j group by 1, 2""")
def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators import scoring as sc

    return sc.nearest_levels(candles(spark, sf_dir))


def _t(name: str, **words: str) -> str:
    """A sentence as an SQL expression."""
    text = "'" + cm.SAID[name].replace("'", "''") + "'"
    for k, v in words.items():
        text = text.replace("{" + k + "}", f"' || {v} || '")
    return text


_UP, _DOWN = "(trend = 'up' and not choch_down)", "(trend = 'down' and not choch_up)"
_FMT = "case when now < 10 then printf('%.4f', {0}) when now < 1000 then printf('%.3f', {0}) else printf('%.2f', {0}) end"
_SIDE, _OTHER, _ACTING = "case when up then 'buyers' else 'sellers' end", "case when up then 'Sellers' else 'Buyers' end", "case when up then 'buying' else 'selling' end"


@query(f"""with {ST}, lb as (select *, lag(price) over (partition by symbol, type order by c) as q from s),
ll as (select *, case when q is null then case type when 'high' then 'H' else 'L' end when type = 'high' then case when price > q then 'HH' else 'LH' end else case when price > q then 'HL' else 'LL' end end as label from lb),
la as (select symbol, count(*) as cn, arg_max(close, c) as now, arg_max(open, c) as op, arg_max(high, c) as hi, arg_max(low, c) as lo, arg_max(close, c) >= arg_max(open, c) as up,
  (arg_max(close, c) - arg_min(open, c)) / arg_min(open, c) * 100 as momentum, stddev_pop(high - low) / avg(high - low) * 100 as volatility from c group by 1 having count(*) >= 20),
fl as (select symbol, abs(arg_max(close, c) - arg_min(open, c)) / sum(w) as absorption, sum(greatest(dl, 0)) as b, sum(greatest(-dl, 0)) as x
  from (select c.*, case when high = low then 1e-9 else high - low end as w, ((close - low) / case when high = low then 1e-9 else high - low end - 0.5::double) * 2 * case when high = low then 1e-9 else high - low end as dl from c join la using (symbol) where c.c >= la.cn - 20) group by 1),
bk as (select symbol, bool_or(type = 'bos' and direction = 'bullish') as bos_up, bool_or(type = 'bos' and direction = 'bearish') as bos_down, bool_or(type = 'choch' and direction = 'bullish') as choch_up, bool_or(type = 'choch' and direction = 'bearish') as choch_down
  from br join la using (symbol) where br.c >= la.cn - 10 group by 1),
lv as (select symbol, coalesce(arg_max(ll.label, c) filter (type = 'low' and price <= now), arg_max(ll.label, c) filter (type = 'low')) as sl, coalesce(arg_max(price, c) filter (type = 'low' and price <= now), arg_max(price, c) filter (type = 'low')) as sp,
  coalesce(arg_max(ll.label, c) filter (type = 'high' and price >= now), arg_max(ll.label, c) filter (type = 'high')) as rl, coalesce(arg_max(price, c) filter (type = 'high' and price >= now), arg_max(price, c) filter (type = 'high')) as rp,
  arg_max(price, c) filter (type = 'low' and label in ('HL', 'L')) as held_low, arg_max(price, c) filter (type = 'high' and label in ('LH', 'H')) as held_high from ll join la using (symbol) group by 1),
f4 as (select symbol, list(price order by k) filter (type = 'high') as hs, list(price order by k) filter (type = 'low') as ls from o where k > (select max(z.k) - 4 from o z where z.symbol = o.symbol) group by 1),
t4 as (select symbol, case when len(hs) >= 2 and len(ls) >= 2 and hs[-1] > hs[-2] and ls[-1] > ls[-2] then 'up' when len(hs) >= 2 and len(ls) >= 2 and hs[-1] <= hs[-2] and ls[-1] <= ls[-2] then 'down' else 'none' end as trend from f4),
al as (select la.*, absorption, b > x as buyers, coalesce(bos_up, false) as bos_up, coalesce(bos_down, false) as bos_down, coalesce(choch_up, false) as choch_up, coalesce(choch_down, false) as choch_down, sl, sp, rl, rp, held_low, held_high, coalesce(trend, 'none') as trend,
  abs(now - op) as body, case when up then hi - greatest(op, now) else least(op, now) - lo end as wick from la join fl using (symbol) left join bk using (symbol) left join lv using (symbol) left join t4 using (symbol))
select symbol, case when {_UP} then case when bos_up then 'Bullish Continuation' else 'Bullish, Awaiting Confirmation' end when {_DOWN} then case when bos_down then 'Bearish Continuation' else 'Bearish, Awaiting Confirmation' end else 'Transitioning / Unclear' end as trend_label,
  case when {_UP} then {_t('bullish')} || coalesce({_t('bullish_level', price=_FMT.format('held_low'))}, '') || {_t('bullish_end')} when {_DOWN} then {_t('bearish')} || coalesce({_t('bearish_level', price=_FMT.format('held_high'))}, '') || {_t('bearish_end')} else {_t('unclear')} end as trend_narrative,
  {_t('active', side=_SIDE)} || ' ' || case when up then {_t('defend_up')} else {_t('defend_down')} end || ' ' || case when body > 0 and wick > body * 0.3 then {_t('attempted', Other=_OTHER, way="case when up then 'lower' else 'higher' end")} else {_t('little', Other=_OTHER)} end
    || ' ' || case when hi > lo and body > 0.45 * (hi - lo) then {_t('healthy', acting=_ACTING)} else {_t('small', acting=_ACTING)} end || ' ' || {_t('unless', against="case when up then 'bearish' else 'bullish' end", side=_SIDE)} as candle_psychology,
  case when momentum > 0.3 then 'positive' when momentum < -0.3 then 'negative' else 'flat' end as momentum_label, case when volatility < 50 then {_t('calm')} else {_t('wild')} end || ' ' || case when abs(momentum) < 3 then {_t('fresh')} else {_t('tired')} end as momentum_observations,
  case when buyers then 'buyers' else 'sellers' end as order_flow_control, case when buyers then {_t('pressure_up')} else {_t('pressure_down')} end || ' ' || case when absorption < 0.35 then {_t('distribution')} else {_t('no_distribution')} end
    || ' ' || case when {_UP} or {_DOWN} then {_t('collection')} else {_t('mixed')} end || ' ' || case when buyers then {_t('demand')} else {_t('supply')} end as order_flow_observations,
  sl as support_label, sp as support_price, rl as resistance_label, rp as resistance_price, case when {_UP} then {_t('warn_up')} when {_DOWN} then {_t('warn_down')} else {_t('warn')} end as warning_signs from al""")
def candle_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each symbol's candles of ten ticks as they stand at their end."""
    return cm.commentary(candles(spark, sf_dir))
