"""Registered queries against their SQL at the smallest scale, as the driver compares them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewright import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def settled(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = pd.Series([None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v) if isinstance(v, str) else bool(v) if isinstance(v, (bool, np.bool_)) else float(v) for v in df[c]], index=df.index, dtype=object)  # nulls stay None
    keys = [c for c in df.columns if not df[c].map(lambda v: isinstance(v, float) and v != int(v)).any()] or list(df.columns)
    return df.sort_values(keys, key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = settled(plans.QUERIES[name](spark, SF).toPandas()), settled(duck.sql(plans.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        for a, b in zip(got[c], want[c], strict=True):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(b))), (c, a, b)


#: What must hold of every row, or of the whole, where SQL has no answer.
HOLDS = {
    "historical_analogs": lambda d: (d["continued_pct"].fillna(0).between(0, 100) & (d["continued_pct"].fillna(0) + d["reversed_pct"].fillna(0) <= 101)).all() and d["symbol"].is_unique,
    "similar_windows": lambda d: (d.groupby("symbol").size() <= 8).all() and d["distance"].between(0, 0.9).all(),
    "probability_engine": lambda d: (d["p_continue"] + d["p_reverse"] == 100).all() and d["p_continue"].between(5, 95).all() and d["confidence"].between(10, 95).all(),
    "rule_engine": lambda d: d["confidence"].between(0, 100).all() and (d["type"] == "trendStrength").sum() == d["symbol"].nunique(),
    "thompson_sampling": lambda d: d["draw"].between(0, 1).all() and d.sort_values("rank")["draw"].is_monotonic_decreasing and sorted(d["rank"]) == list(range(1, len(d) + 1)),
    "novel_states": lambda d: len(d) == 5 and (d["is_novel"] == (d["distance"] >= 1)).all(),
    "burst_metrics": lambda d: len(d) > 900 and d["exhaustion"].between(0, 100).all() and d["td_pct"].between(-100, 100).all(),
    "burst_signals": lambda d: set(d["result"]) <= {"win", "loss", "pend"},
    "burst_signals_smoothed": lambda d: len(d) > 0 and set(d["result"]) <= {"win", "loss", "pend"} and set(d["direction"]) <= {-1, 1},
    "streaming_burst_signals": lambda d: len(d) > 0 and set(d["result"]) <= {"win", "loss"},
    "market_bias": lambda d: set(d["market"]) <= {"Bullish", "Bearish", "Ranging", "Neutral"} and set(d["narrative"]) <= {"bullish", "bearish", "ranging", "neutral"},
    "gap_partition_effects": lambda d: d["effect"].between(0, 1).all(),
    "null_model_hierarchy": lambda d: ((d["poisson_p"] > 0.05) == (d["verdict"] == "poisson")).all() and d["hawkes_p"].isna()[d["verdict"] == "poisson"].all(),
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_query_without_sql_holds_its_bounds(spark, name):
    assert HOLDS[name](plans.QUERIES[name](spark, SF).toPandas())
