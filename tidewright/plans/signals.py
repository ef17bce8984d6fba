"""Queries over derived features, proxies, states and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import signals as sg
from tidewright.functions.windows import rounded
from tidewright.sources.ticks import ticks

from .streams import R, T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


C = T + """,
q as (select *, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 // 86400 * 86400 as cs from t),
p as (select *, price - lag(price) over (partition by symbol order by i) as d,
  max(price) over (partition by symbol, cs order by i) as ch, min(price) over (partition by symbol, cs order by i) as cl from q)"""


def _w(a: int, b: int) -> str:
    side = lambda k: f"{-k} preceding" if k < 0 else "current row" if k == 0 else f"{k} following"
    return f"(partition by symbol order by i rows between {side(a)} and {side(b)})"


W = "(partition by symbol order by i)"


@query(f"""with {C}, l as (select *, list(price) over {_w(-19, 0)} as x, list(price) over {_w(-9, 0)} as y, list(d) over {_w(-7, 0)} as e, lag(d, 8) over {W} as d8 from p),
b as (select *, list_min(x) as lo, list_max(x) as hi from l),
h as (select *, list_transform(range(0, 5), lambda k: len(list_filter(x, lambda v: least(floor((v - lo) / nullif((hi - lo) / 5, 0)), 4) = k)) / 20) as sh from b)
select symbol, i, round(case when i >= 19 then case when hi = lo then 0 else list_var_samp(x) end end, 3) as rolling_variance,
  round(case when i >= 19 then case when hi = lo then 0 else -list_sum(list_transform(sh, lambda s: case when s > 0 then s * log2(s) else 0 end)) end end, 5) as rolling_entropy,
  round(case when i >= 9 then list_sum(list_transform(y, lambda v, k: v * (k - 5.5::double))) / 82.5 end, 5) as rolling_slope,
  round(case when i >= 9 then (d - d8) / 8 end, 5) as rolling_acceleration,
  round((price - cl) / nullif(ch - cl, 0), 5) as candle_position_normalized from h""")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sg.derived(ticks(spark, sf_dir)).select("symbol", "i", *sg.DERIVED)
    return rounded(rows.withColumn("rolling_variance", F.round("rolling_variance", 3)), places=5)


@query(f"""with {C}, l as (select *, ch - cl as cr,
  min(price) over {_w(-10, -1)} as lo, max(price) over {_w(-10, -1)} as hi, var_samp(price) over {_w(-4, 0)} as v5, var_samp(price) over {_w(-19, 0)} as v20,
  avg(ch - cl) over {_w(-10, -1)} as r10, avg(ch - cl) over {_w(-20, -1)} as r20, ms - lag(ms, 5) over {W} as t5, ms - lag(ms, 20) over {W} as t20,
  max(price) over {_w(-4, 0)} - min(price) over {_w(-4, 0)} as a5, max(price) over {_w(-14, -5)} - min(price) over {_w(-14, -5)} as a10 from p),
s as (select *, (5::double / t5) / (20::double / t20) as sg from l)
select symbol, i, case when i >= 1 and price < lo then 1 else 0 end as local_minimum, case when i >= 1 and price > hi then 1 else 0 end as local_maximum,
  case when i >= 1 and (price < lo or price > hi) then 1 else 0 end as local_extremum,
  round(case when i >= 19 then v5 / v20 end, 5) as volatility_ratio, case when i >= 19 then (v5 / v20 > 2)::int end as volatility_spike,
  round(case when i >= 10 then cr / nullif(r10, 0) end, 5) as range_expansion, round(case when i >= 20 then sg end, 5) as tick_rate_surge,
  case when i >= 14 and a10 > 0 then (a5 > 2 * a10)::int end as compression_release,
  case when i >= 20 then (sg > 2 and coalesce(cr / nullif(r20, 0), 0) > 1.5)::int end as activity_burst from s""")
def market_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sg.proxies(ticks(spark, sf_dir)).select("symbol", "i", *sg.PROXIES), places=5)


@query(f"with {R} select symbol, i, case when sign = 1 then run_length else 0 end as up_cluster, case when sign = -1 then run_length else 0 end as down_cluster from r")
def tick_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.clusters(ticks(spark, sf_dir))


S = C + f""",
l as (select *, stddev_pop(price) over {_w(-19, 0)} as s, stddev_pop(price) over {_w(-19, -10)} as s1, stddev_pop(price) over {_w(-9, 0)} as s2, avg(price) over {_w(-19, 0)} as m,
  max(price) over {_w(-19, 0)} as hi, min(price) over {_w(-19, 0)} as lo, lag(price, 19) over {W} as f, lag(price, 10) over {W} as p10, lag(price, 9) over {W} as p9,
  lag(price, 6) over {W} as p6, lag(price, 12) over {W} as p12, lag(price, 18) over {W} as p18, list(price) over {_w(-19, 0)} as x,
  count(*) filter (d > 0) over {_w(-19, -10)} as u1, count(*) filter (d <> 0) over {_w(-19, -10)} as k1, count(*) filter (d > 0) over {_w(-9, 0)} as u2, count(*) filter (d <> 0) over {_w(-9, 0)} as k2,
  count(*) filter (d > 0) over {_w(-18, -9)} as u3, count(*) filter (d <> 0) over {_w(-18, -9)} as k3, count(*) filter (d > 0) over {_w(-8, 1)} as u4, count(*) filter (d <> 0) over {_w(-8, 1)} as k4 from p),
z as (select *, abs(price - f) as mv, sign(p10 - f) as g1, sign(price - p9) as g2, sign(p12 - p18) as h1, sign(p6 - p12) as h2, sign(price - p6) as h3,
  len(list_filter(range(1, 20), lambda k: (x[k] - m) * (x[k + 1] - m) < 0)) as cx from l),
st as (select symbol, i, price, ms, cs, ch, cl, p10,
  case when i >= 19 then (s > 0 and mv > 0.5 * s)::int end as trend, case when i >= 19 then (mv < 0.25 * s)::int end as ranging,
  case when i >= 19 then (s / abs(m) > 0.02)::int end as high_volatility, case when i >= 19 then (s / abs(m) < 0.002)::int end as low_volatility,
  case when i >= 19 then (s1 > 0 and s2 < 0.5 * s1)::int end as compression, case when i >= 19 then (s2 > 2 * s1)::int end as expansion,
  case when i >= 19 then (g1 * g2 > 0)::int end as persistence, case when i >= 19 then (g1 * g2 < 0)::int end as reversal, case when i >= 19 then (cx >= 3)::int end as oscillation,
  case when i >= 19 then (s > 0 and mv between 0.25 * s and 0.5 * s)::int end as drift,
  case when i >= 19 then ((s1 > 0 and abs(p10 - f) > 0.5 * s1) <> (s2 > 0 and abs(price - p9) > 0.5 * s2))::int end as regime_transition,
  case when i >= 19 then (abs(price - m) < 0.3 * greatest(hi - m, m - lo))::int end as mean_reversion,
  case when i >= 19 then ((h1 * h2 < 0)::int + (h2 * h3 < 0)::int >= 2)::int end as low_persistence,
  case when i >= 19 then (case when s1 = 0 then s2 > 0 else s2 / s1 > 1.75 or s2 / s1 < 0.57 end)::int end as volatility_shift,
  case when i >= 19 then (abs(coalesce(u1 / nullif(k1, 0), 0.5) - coalesce(u2 / nullif(k2, 0), 0.5)) > 0.3)::int end as entropy_shift,
  case when i >= 19 then (abs(coalesce(u3 / nullif(k3, 0), 0.5) - coalesce(u4 / nullif(k4, 0), 0.5)) > 0.3)::int end as entropy_shift_looks_ahead from z)"""


@query(f"with {S} select symbol, i, {', '.join(sg.STATES)} from st")
def market_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.states(ticks(spark, sf_dir)).select("symbol", "i", *sg.STATES)


_ACTIVE = "case when {0} is null then 'UNKNOWN' when {0} = 1 then 'ACTIVE' else 'INACTIVE' end"


@query(f"""with {S}, k as (select *, (price - cl) / nullif(ch - cl, 0) as a, (ms / 1000 - cs) / 86400 as b, ms // 3600000 % 24 as h, price - p10 as mo from st)
select symbol, i, case when ch <= cl then 'UNKNOWN' when a < 0.33 then 'LOWER' when a < 0.67 then 'MIDDLE' else 'UPPER' end as candle_position,
  case when b < 0.33 then 'EARLY' when b < 0.67 then 'MID' else 'LATE' end as candle_timing,
  case when h < 8 then 'ASIA' when h < 16 then 'EUROPE' when h < 21 then 'US' else 'OFF_HOURS' end as market_session,
  case when high_volatility is null then 'UNKNOWN' when high_volatility = 1 then 'HIGH' when low_volatility = 1 then 'LOW' else 'NORMAL' end as volatility_state,
  {_ACTIVE.format('trend')} as trend_state, {_ACTIVE.format('compression')} as compression_state, {_ACTIVE.format('expansion')} as expansion_state, {_ACTIVE.format('ranging')} as range_state,
  case when mo is null then 'UNKNOWN' when mo > 0 then 'POSITIVE' when mo < 0 then 'NEGATIVE' else 'FLAT' end as momentum_state from k""")
def observable_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "candle_position candle_timing market_session volatility_state trend_state compression_state expansion_state range_state momentum_state".split()
    return sg.observed(ticks(spark, sf_dir)).select("symbol", "i", *names)


@query(f"""with {C}, c as (select symbol, cs, arg_min(price, i) as o, max(price) as h, min(price) as l, arg_max(price, i) as e from p group by 1, 2),
w as (select symbol, cs, case when h = l or e = o then 'DOJI' when e > o then 'BULLISH' else 'BEARISH' end as direction, h - l as r, abs(e - o) / nullif(h - l, 0) as b,
  (h - greatest(o, e)) / nullif(h - l, 0) as u, (least(o, e) - l) / nullif(h - l, 0) as lw, (e - l) / nullif(h - l, 0) as cp from c),
k as (select symbol, cs, lag(direction) over v as direction, lag(r) over v as r, lag(b) over v as b, lag(u) over v as u, lag(lw) over v as lw, lag(cp) over v as cp from w window v as (partition by symbol order by cs))
select p.symbol, p.i, p.cs as candle_start, coalesce(direction, 'UNKNOWN') as prior_direction, round(r, 5) as prior_range, round(b, 5) as prior_body, round(u, 5) as prior_upper_wick,
  round(lw, 5) as prior_lower_wick, round(cp, 5) as prior_close_position from p join k on p.symbol = k.symbol and p.cs = k.cs""")
def prior_candle_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sg.prior_candle(ticks(spark, sf_dir)), places=5)
