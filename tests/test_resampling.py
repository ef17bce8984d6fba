"""Shifts and resamples over blocks against plain NumPy over whole series."""

import math

import numpy as np
import pytest

from tidewright.operators import resampling as rs

SIZES = {"long": 101, "even": 28, "short": 3, "one": 1, "flat": 20}


def _series() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(4)
    made = {s: (rng.normal(size=n), rng.integers(0, 3, n).astype("f8")) for s, n in SIZES.items()}
    made["flat"] = (np.ones(20), made["flat"][1])
    return made


@pytest.fixture(scope="module")
def df(spark):
    rows = [(s, 10 * i, float(a), float(b), "extra") for s, (x, y) in _series().items() for i, (a, b) in enumerate(zip(x, y))]
    # pairs without a value leave no gap, in whatever order the rows come
    rows += [("long", 15, None, 1.0, "extra"), ("long", 25, 1.0, float("nan"), "extra")]
    return spark.createDataFrame(rows[::-1], "s string, i int, x double, y double, n string")


def _r(x, y) -> float:
    return float(np.corrcoef(x, y)[0, 1]) if np.ptp(x) and np.ptp(y) else 0.0


def _mi(x, y, bins=8) -> float:
    cut = lambda v: np.minimum((v - v.min()) / np.ptp(v) * bins, bins - 1).astype(int) if np.ptp(v) else np.zeros(len(v), int)
    joint = np.zeros((bins, bins))
    np.add.at(joint, (cut(x), cut(y)), 1 / len(x))
    outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    return float((joint[joint > 0] * np.log2(joint[joint > 0] / outer[joint > 0])).sum())


@pytest.mark.parametrize("size", [7, 1000])
def test_shifts_over_blocks_equal_shifts_of_whole_series(df, size):
    got = {r.s: r for r in rs.shift_test(df, ["s"], "i", "x", "y", 50, 9, size).collect()}
    info = {r.s: r for r in rs.permutation_test(df, ["s"], "i", "x", "y", 50, 9, size=size).collect()}
    assert set(got) == set(info) == {s for s, n in SIZES.items() if n >= 3}
    for s, (x, y) in _series().items():
        if s in got:
            moved = [np.roll(y, k) for k in rs.shifts(len(x), 50, 9).tolist()]
            null = np.array([abs(_r(x, m)) for m in moved])
            assert got[s].n == len(x) and math.isclose(got[s].effect, _r(x, y), abs_tol=1e-9) and math.isclose(got[s].statistic, abs(_r(x, y)), abs_tol=1e-9)
            assert math.isclose(got[s].p_value, (1 + (null >= abs(_r(x, y)) - 1e-9).sum()) / 51) and math.isclose(got[s].null_mean, null.mean(), abs_tol=1e-9)
            assert math.isclose(got[s].null_variance, null.var(ddof=1), abs_tol=1e-9)
            assert math.isclose(info[s].statistic, _mi(x, y), abs_tol=1e-9)
            assert math.isclose(info[s].p_value, (1 + sum(_mi(x, m) >= _mi(x, y) - 1e-9 for m in moved)) / 51)


@pytest.mark.parametrize("size", [7, 1000])
def test_resamples_over_blocks_equal_resamples_of_whole_series(df, size):
    got = {r.s: r for r in rs.bootstrap(df, ["s"], "i", "x", "y", 200, 5, size=size).collect()}
    assert set(got) == {s for s, n in SIZES.items() if n >= 2}
    for s in ("long", "even", "flat"):
        x, y = _series()[s]
        w = rs.weights(0, len(x), range(200), 5)
        draws = np.sort([_r(np.repeat(x, k), np.repeat(y, k)) for k in w])
        assert math.isclose(got[s].r, _r(x, y), abs_tol=1e-9) and math.isclose(got[s].error, draws.std(ddof=1), abs_tol=1e-9)
        assert math.isclose(got[s].low, draws[4], abs_tol=1e-9) and math.isclose(got[s].high, draws[194], abs_tol=1e-9)


def test_weights_are_poisson_and_need_no_neighbours():
    w = rs.weights(0, 4000, range(50), 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert (rs.weights(1000, 10, range(20, 30), 1) == w[20:30, 1000:1010]).all()
    # numbers above 32 bits go on
    assert not (rs.weights(2**32, 100, range(50), 1) == w[:, :100]).all()
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


def test_intervals_cover_what_ordinary_resamples_do(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    y = x + rng.normal(size=400)
    got = rs.bootstrap(spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))], "s string, i int, x double, y double"), ["s"], "i", "x", "y", 1000).first()
    draws = [_r(x[k], y[k]) for k in rng.integers(0, 400, (1000, 400))]
    assert abs(got.low - np.quantile(draws, 0.025)) < 0.015 and abs(got.high - np.quantile(draws, 0.975)) < 0.015


def test_tables_without_pairs_give_no_rows(spark):
    empty = spark.createDataFrame([("a", 1, None, 1.0)], "s string, i int, x double, y double")
    for f in (rs.permutation_test, rs.shift_test, rs.bootstrap, rs.confirmation):
        assert f(empty, ["s"], "i", "x", "y").collect() == []
