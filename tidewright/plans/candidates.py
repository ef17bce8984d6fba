"""Queries that join the candidates of the registry to data, and the campaign over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.windows import rounded
from tidewright.operators import candidates as cn
from tidewright.operators import discovery as ds
from tidewright.operators import funnel as fn
from tidewright.operators import procedures as pr
from tidewright.operators import runs as rn
from tidewright.operators import snapshots as sn
from tidewright.operators import statistics as st
from tidewright.sources.shared import stored
from tidewright.sources.ticks import ticks

from . import signals as sig
from .analytics import SN
from .streams import D, R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PERIODS = (10, 14, 20, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _last(n: int) -> str:
    return f"(partition by symbol order by i rows between {n - 1} preceding and current row)"


def _share(x: str, of: str) -> str:
    return f"coalesce({x} / {of} * log2(nullif({x} / {of}, 0)), 0)"


def _windowed(p: int) -> str:
    """The indicators of bounded windows for one period, in SQL."""
    w = _last(p)
    return f"""
v{p} as (select *, avg(price) over {w} m, list(price) over {w} l, list(d) over {w} dl, stddev_pop(price) over {w} s, max(price) over {w} h, min(price) over {w} n, stddev_pop(d0) over {w} sd0,
  max(d0) over {w} = min(d0) over {w} f0, lag(price, {p}) over (partition by symbol order by i) pp, count(*) filter (d > 0) over {w} u, count(*) filter (d < 0) over {w} dn, count(*) filter (d = 0) over {w} z,
  list(d) over {_last(p - 1)} a, list(db) over {_last(p - 1)} b from x),
q{p} as (select *, list_avg(dl) dm, list_stddev_pop(dl) ds, list_max(dl) = list_min(dl) ef from v{p}),
h{p} as (select *, list_transform(range(1, {p + 1}), lambda k: list_sum(dl[1:k]) - k * dm) cum from q{p}),
w{p} as (select symbol, i, case when i >= {p - 1} then m end as sma_{p}, case when i >= {p - 1} then list_sum(list_transform(l, lambda x, k: x * k)) / {p * (p + 1) // 2} end as wma_{p},
  case when i >= {p - 1} then case when h = n then 0 else (price - m) / (0.015::double * list_avg(list_transform(l, lambda x: abs(x - m)))) end end as cci_{p},
  price - pp as momentum_{p}, 100 * ((price - pp) / nullif(pp, 0)) as roc_{p}, case when i >= {p - 1} then 4 * case when h = n then 0 else s end / nullif(m, 0) end as bollinger_width_{p},
  case when i >= {p - 1} and h > n then (price - m + 2 * s) / (4 * s) end as bollinger_position_{p}, case when i >= {p - 1} then case when f0 then 0 else sd0 end end as volatility_{p},
  case when i >= {p - 1} then h - n end as range_{p}, case when i >= {p - 1} and h > n then (price - m) / s end as zscore_{p},
  case when i >= {p} then -({_share('u', str(p))} + {_share('dn', str(p))} + {_share('z', str(p))}) end as entropy_{p},
  case when i >= {p} and ds > 0 then ln((list_max(cum) - list_min(cum)) / ds) / ln({p}) end as hurst_{p}, case when i >= {p} and ds > 0 then 2 - ln((list_max(cum) - list_min(cum)) / ds) / ln({p}) end as fractal_dimension_{p},
  case when i >= {p} then (u - dn) / {p} end as tick_imbalance_{p}, case when i >= {p} and u + dn > 0 then -({_share('u', '(u + dn)')} + {_share('dn', '(u + dn)')}) end as directional_entropy_{p},
  case when i >= {p - 1} then case when h = n then 50 else (price - n) / (h - n) * 100 end end as stochastic_k_{p},
  case when i >= {p} then list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - list_avg(a)) * (p[2] - list_avg(b)))) / {p - 1} / (list_stddev_pop(a) * list_stddev_pop(b)) end as autocorrelation_{p},
  case when i >= {p} then case when ef then 0 else list_avg(list_transform(dl, lambda x: (x - dm) ** 3)) / ds ** 3 end end as skewness_{p},
  case when i >= {p} then case when ef then -3 else list_avg(list_transform(dl, lambda x: (x - dm) ** 4)) / ds ** 4 - 3 end end as kurtosis_{p} from h{p})"""


def _recursive(p: int) -> str:
    """The smoothed indicators for one period, step by step."""
    k = {n: f"(2::double / {n + 1})" for n in (9, 12, 20, 26, p)}
    return f"""
s{p} as (select symbol, i, m20, price e, null::double sl, price e12, price e26, 0::double sig, 0::double line, 0::double pu, 0::double md, 0::double tr, 0::double tr20, 0::double adx, 0::double ga, 0::double lo from y where i = 0
  union all select symbol, i, m20, en, en - e, e12n, e26n, {k[9]} * (e12n - e26n) + (1 - {k[9]}) * sig, e12n - e26n, pun, mdn, trn, tr20n,
    {k[p]} * (case when trn = 0 or pun + mdn = 0 then 0 else 100 * abs(100 * pun / trn - 100 * mdn / trn) / (100 * pun / trn + 100 * mdn / trn) end) + (1 - {k[p]}) * adx,
    case when i <= {p} then ga + up / {p} else (ga * {p - 1} + up) / {p} end, case when i <= {p} then lo + dn / {p} else (lo * {p - 1} + dn) / {p} end
  from (select y.symbol, y.i, y.m20, y.up, y.dn, s.e, s.sig, s.adx, s.ga, s.lo, {k[p]} * y.price + (1 - {k[p]}) * s.e en, {k[12]} * y.price + (1 - {k[12]}) * s.e12 e12n, {k[26]} * y.price + (1 - {k[26]}) * s.e26 e26n,
    {k[p]} * y.up + (1 - {k[p]}) * s.pu pun, {k[p]} * y.dn + (1 - {k[p]}) * s.md mdn, {k[p]} * (y.up + y.dn) + (1 - {k[p]}) * s.tr trn, {k[20]} * (y.up + y.dn) + (1 - {k[20]}) * s.tr20 tr20n
    from s{p} s join y on y.symbol = s.symbol and y.i = s.i + 1)),
r{p} as (select symbol, i, e as ema_{p}, sl as ema_slope_{p}, line - sig as macd_{p}, case when i >= {p} then case when lo = 0 then 100 else 100 - 100 / (1 + ga / lo) end end as rsi_{p}, adx as adx_{p}, tr as atr_{p},
  case when i >= 19 then 2 * tr20 / m20 end as keltner_width_{p} from s{p})"""


def _series_sql(end: str) -> str:
    """The series of all candidates as u (symbol, i, candidate, value) and names, a list of them, before ``end``."""
    states, proxies = list(ds.STATE_NAMES), list(ds.PROXY_NAMES)
    plain = [(n, "st") for n in states] + [(n, "px") for n in proxies]
    pairs = [(a[0], b[0]) for a, b in zip(plain, plain[1:]) if a[1] == b[1]]
    composite = ", ".join(f"case when {a} is not null and {b} is not null then ({a} <> 0 and {b} <> 0)::int::double end as \"{a}+{b}\"" for a, b in pairs)
    masked = [(n, ds.CONTEXT_NAMES[k % len(ds.CONTEXT_NAMES)]) for k, (n, _) in enumerate(plain)]
    conditional = ", ".join(f"case when {c} = '{cn.REQUIRED[c]}' then {n}::double end as \"{n}|{c}\"" for n, c in masked)
    long = lambda t: f"select symbol, i, candidate, value from (unpivot (select * from {t}) on columns(* exclude (symbol, i)) into name candidate value value)"
    parts = " union all ".join(long(f"{k}{p}") for p in PERIODS for k in "wr") + " union all " + " union all ".join(long(t) for t in ("n", "b", "c", "k"))
    every = [f"{n}_{p}" for n in ds.INDICATORS for p in PERIODS] + [n for n, _ in plain] + [f"{a}+{b}" for a, b in pairs] + [f"{n}|{c}" for n, c in masked]
    names = ", ".join(f"'{n}'" for n in every)
    return f"""with recursive {D}, x as (select *, coalesce(d, 0) as d0, lag(d) over (partition by symbol order by i) as db from d),
y as (select *, greatest(coalesce(d, 0), 0) as up, greatest(-coalesce(d, 0), 0) as dn, avg(price) over {_last(20)} as m20 from d),
{",".join(_windowed(p) + "," + _recursive(p) for p in PERIODS)},
n as (select symbol, i, {", ".join(f"run_length::double as run_length_{p}" for p in PERIODS)} from (with {R} select symbol, i, run_length from r)),
st as ({sig.ORACLES['market_states']}), px as (select * from ({sig.ORACLES['market_proxies']}) join ({sig.ORACLES['tick_clusters']}) using (symbol, i)),
o as (select symbol, i, prior_direction as prior_candle, * exclude (symbol, i, candle_start, prior_direction) from ({sig.ORACLES['observable_contexts']}) join ({sig.ORACLES['prior_candle_context']}) using (symbol, i)),
a as (select * from st join px using (symbol, i) join o using (symbol, i)),
b as (select symbol, i, {", ".join(f"{n}::double as {n}" for n, _ in plain)} from a), c as (select symbol, i, {composite} from a), k as (select symbol, i, {conditional} from a),
u as ({parts}), names as (select unnest([{names}]) as candidate) {end}"""


_SUMMARY = """, g as (select symbol, candidate, count(*) as known, round(avg(round(value::double, 5)), 4) as mean, count(*) filter (round(value::double, 5) <> 0) as active from u group by 1, 2)
select symbol, candidate, coalesce(known, 0) as known, mean, coalesce(active, 0) as active from (select * from (select distinct event_type as symbol from events), names) left join g using (symbol, candidate)"""


@query(_series_sql(_SUMMARY))
def candidate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the registry that ticks can show, over all ticks: where each is known, its mean and where it isn't 0."""
    specs = ds.candidates(spark, PERIODS).filter("type <> 'event'").collect()
    return rounded(cn.summary(cn.wide(ticks(spark, sf_dir), specs), [cn.label(c) for c in specs], 5), places=4)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots at run events of three moves, with whether the next move goes on in their direction; flat ones have no label."""
    stream = ticks(spark, sf_dir)
    events = rn.runs(stream, 3)
    rows = rounded(sn.enriched(sn.snapshots(events, stream)).filter("history_valid"))
    label = rn.outcomes(events.select("event_key", "symbol", "i", "trigger_price"), stream, 1).filter("outcome <> 0").select("event_key", "outcome")
    return rows.join(label, "event_key").withColumn("goes_on", (F.col("outcome") == F.col("direction")).cast("int"))


_INFORMATION = """, y2 as (select symbol, i, (lead(price) over (partition by symbol order by i) > price)::int as label from t),
vv as (select candidate, label, round(value::double, 5) as v from u join y2 using (symbol, i) where label is not null and value is not null),
ee as (select candidate, min(v) as lo, max(v) as hi, count(*) as n, avg(label) as rises from vv group by 1),
bn as (select candidate, label, n, lo, hi, case when hi = lo then 0 else least(floor((v - lo) / (hi - lo) * 10), 9) end as bin from vv join ee using (candidate)),
ct as (select candidate, bin, label, n, lo, hi, count(*) as c from bn group by all), mg as (select *, sum(c) over (partition by candidate, bin) as r, sum(c) over (partition by candidate, label) as k from ct),
mi as (select candidate, case when any_value(n) < 3 or any_value(hi) = any_value(lo) then 0 else greatest(sum(c / n * log2(c * n / (r * k))), 0) end as information from mg group by 1)
select candidate, n as pairs, round(rises, 6) as rises, round(information, 6) as information from ee join mi using (candidate)"""


@query(_series_sql(_INFORMATION))
def candidate_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each candidate says of whether the next tick rises, over all ticks at which both are known, each type of candidate by
    the procedure that is registered for it."""
    stream = ticks(spark, sf_dir)
    labelled = stream.join(st.outcome_series(stream, "Rise", 1).withColumnRenamed("outcome", "label"), ["symbol", "i"], "left")
    specs = ds.candidates(spark, PERIODS).filter("type <> 'event'").collect()
    rows = stored(cn.wide(labelled, specs, keep=("label",)).filter("label is not null"), "candidate-columns")
    out = pr.core(pr.columns_information).run_columns(rows, {cn.label(c): c["type"] for c in specs})
    return rounded(out.withColumnRenamed("feature", "candidate"))


_LABELLED = f"""{SN}, lb as (select ff.*, (sign(t.price - e.trigger_price) = e.direction)::int as label from ff join e using (event_key) join t on t.symbol = e.symbol and t.i = e.i + 1 where t.price <> e.trigger_price),
vv as (select event_key, label, feature, value from (unpivot (select event_key, label, {", ".join(f"{n}::double as {n}" for n in fn.FEATURES)} from lb) on {", ".join(fn.FEATURES)} into name feature value value)),
nn as (select feature, count(*) as n, min(value) as lo, max(value) as hi, list(value order by value) as l from vv group by 1),
cc as (select feature, feature || '__raw' as candidate, 'raw' as kind, null::varchar as direction, null::double as threshold, lo, hi from nn
  union all select feature, feature || '__p' || p || '_' || d, 'threshold', d, l[greatest(0, floor(p / 100::double * n)::bigint - 1) + 1], lo, hi from nn, (select unnest([25, 50, 75]) as p), (select unnest(['above', 'below']) as d)),
bn as (select candidate, feature, kind, direction, threshold, label, case when kind = 'raw' then case when hi = lo then 0 else least(floor((value - lo) / (hi - lo) * 10), 9) end
  when direction = 'above' then (value >= threshold)::int else (value < threshold)::int end as bin from vv join cc using (feature)),
ct as (select candidate, any_value(feature) as feature, any_value(kind) as kind, any_value(direction) as direction, any_value(threshold) as threshold, bin, label, count(*) as c from bn group by candidate, bin, label),
mg as (select *, sum(c) over (partition by candidate) as n, sum(c) over (partition by candidate, bin) as r, sum(c) over (partition by candidate, label) as k from ct),
sc as (select candidate, any_value(feature) as feature, any_value(kind) as kind, any_value(direction) as direction, any_value(threshold) as threshold, max(n)::bigint as rows,
  greatest(sum(c / n * log2(c * n / (r * k))), 0) as score from mg group by candidate)"""


@query(f"with {_LABELLED} select candidate, feature, kind, direction, round(threshold, 6) as threshold, rows, round(score, 6) as score from sc")
def campaign_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 1 of the campaign: the candidates of all snapshot features, seven each, with their information on the next move."""
    rows = fn.screening(_labelled(spark, sf_dir), "event_key", F.col("goes_on"))
    return rounded(rows.select("candidate", "feature", "kind", "direction", "threshold", "rows", "score"))


@query()
def adaptive_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rounds over the same candidates."""
    rows = fn.campaign(_labelled(spark, sf_dir), "event_key", F.col("goes_on"), "non_classical")
    return rounded(rows.select("candidate", "rows", "score", "cheap_p", "deep_p", "alpha_spent", "round", "outcome", "lockbox"))
