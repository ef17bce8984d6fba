"""Tests of the gaps between events, a stream at a time: Poisson, renewal, labelled, self-exciting and hidden-state models.

A stream's gaps are what one study looks at, a bounded list; streams are spread over tasks. Randomness is seeded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROW = "stream string, n long, rate double, variation double, distribution string, poisson_statistic double, poisson_p double, max_autocorrelation double, independent boolean, labels_statistic double, labels_p double, hawkes_ratio double, hawkes_p double, hmm_ratio double, hmm_p double, verdict string"


def ks_exponential(gaps: np.ndarray) -> float:
    x = np.sort(gaps)
    f = 1 - np.exp(-x / x.mean())
    i = np.arange(len(x))
    return float(np.maximum(np.abs(f - i / len(x)), np.abs((i + 1) / len(x) - f)).max())


def poisson(gaps: np.ndarray, rng: np.random.Generator, times: int = 1000) -> tuple[float, float]:
    """The distance from an exponential of the same mean, and the share of simulated samples, refitted, at least as far."""
    seen = ks_exponential(gaps)
    return seen, float(np.mean([ks_exponential(rng.exponential(1, len(gaps))) >= seen for _ in range(times)]))


def autocorrelation(x: np.ndarray, k: int) -> float:
    d = x - x.mean()
    total = float((d * d).sum())
    return float((d[k:] * d[:-k]).sum() / total) if total else 0.0


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def renewal(gaps: np.ndarray, alpha: float = 0.05) -> tuple[float, bool]:
    """The largest autocorrelation of up to five lags, and whether none is more than chance allows."""
    lags = range(1, min(5, len(gaps) - 2) + 1)
    r = max((autocorrelation(gaps, k) for k in lags), key=abs, default=0.0)
    return r, abs(r) * math.sqrt(len(gaps)) <= normal_quantile(1 - alpha / (2 * max(1, len(lags))))


def ks_two(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    cut = lambda x: np.searchsorted(np.sort(x), both, side="right") / len(x)
    return float(np.abs(cut(a) - cut(b)).max())


def labelled(gaps: np.ndarray, rises: np.ndarray, rng: np.random.Generator, times: int = 1000) -> tuple[float, float]:
    """Whether gaps after rises and falls differ, against shuffled labels."""
    if rises.all() or not rises.any():
        return 0.0, 1.0
    seen = ks_two(gaps[rises], gaps[~rises])
    mixed = [rng.permutation(rises) for _ in range(times)]
    return seen, float(np.mean([ks_two(gaps[m], gaps[~m]) >= seen for m in mixed]))


def hawkes_likelihood(times: np.ndarray, mu: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Of event times for many parameters at once; past events raise the rate by ``alpha``, which fades by ``beta``."""
    end, excited = times[-1], np.zeros(len(mu))
    total = -mu * end - (alpha / beta) * (1 - np.exp(-np.outer(end - times, beta))).sum(axis=0)
    for k, gap in enumerate(np.diff(times, prepend=times[0])):
        excited = excited * np.exp(-beta * gap) + (alpha * np.exp(-beta * gap) if k else 0)
        total = total + np.log(mu + excited)
    return total


def hawkes_fit(times: np.ndarray, rounds: int = 3, points: int = 7) -> float:
    """The best log-likelihood on a grid of logarithms that narrows around the best point of each round."""
    rate = len(times) / times[-1]
    centre, width, best = np.log([rate / 2, rate / 2, rate * 2]), 2.0, -np.inf
    for _ in range(rounds):
        axes = [np.exp(c + np.linspace(-width, width, points)) for c in centre]
        mu, alpha, beta = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
        stable = alpha < beta
        mu, alpha, beta = mu[stable], alpha[stable], beta[stable]
        if not len(mu):
            break
        score = hawkes_likelihood(times, mu, alpha, beta)
        k = int(score.argmax())
        best, centre, width = max(best, float(score[k])), np.log([mu[k], alpha[k], beta[k]]), width / 3
    return best


def exponential_likelihood(gaps: np.ndarray) -> float:
    return float(-len(gaps) * math.log(gaps.mean()) - len(gaps))


def hidden_likelihood(gaps: np.ndarray, steps: int = 60) -> float:
    """The log-likelihood of two hidden states with exponential gaps after scaled expectation-maximization."""
    rates = np.array([0.5, 2.0]) / gaps.mean()
    move, start, last = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), -np.inf
    for _ in range(steps):
        p = np.maximum(rates * np.exp(-np.outer(gaps, rates)), 1e-300)
        ahead, scale = np.empty_like(p), np.empty(len(gaps))
        for t in range(len(gaps)):
            a = (start if t == 0 else ahead[t - 1] @ move) * p[t]
            scale[t] = a.sum()
            ahead[t] = a / scale[t]
        back = np.ones_like(p)
        for t in range(len(gaps) - 2, -1, -1):
            back[t] = move @ (p[t + 1] * back[t + 1]) / scale[t + 1]
        here = ahead * back
        here /= here.sum(axis=1, keepdims=True)
        pairs = ahead[:-1, :, None] * move[None] * (p[1:] * back[1:] / scale[1:, None])[:, None, :]
        move = pairs.sum(axis=0)
        move /= np.maximum(move.sum(axis=1, keepdims=True), 1e-300)
        start, rates = here[0], here.sum(axis=0) / np.maximum((here * gaps[:, None]).sum(axis=0), 1e-300)
        now = float(np.log(scale).sum())
        if now - last < 1e-6:
            return now
        last = now
    return last


def hierarchy(gaps: np.ndarray, rises: np.ndarray, seed: int = 42, times: int = 200, alpha: float = 0.05) -> dict:
    """Poisson first; if that fails, whether gaps are independent; if they are, their spread names the renewal process, if
    not, what kind of dependence explains them. Stages that aren't reached have no figures."""
    rng = np.random.default_rng(seed)
    n, mean = len(gaps), gaps.mean()
    variation = float(gaps.std() / mean)
    kind = "exponential-like" if abs(variation - 1) <= 0.1 else "under-dispersed" if variation < 1 else "over-dispersed"
    d, p = poisson(gaps, rng)
    out = dict(n=n, rate=1 / mean, variation=variation, distribution=None, poisson_statistic=d, poisson_p=p, max_autocorrelation=None, independent=None, labels_statistic=None, labels_p=None, hawkes_ratio=None, hawkes_p=None, hmm_ratio=None, hmm_p=None)
    if p > alpha:
        return {**out, "verdict": "poisson"}
    r, independent = renewal(gaps)
    out |= {"max_autocorrelation": r, "independent": bool(independent)}
    if independent:
        return {**out, "distribution": kind, "verdict": f"renewal, {kind}"}
    out["labels_statistic"], out["labels_p"] = labelled(gaps, rises, rng)
    if out["labels_p"] <= alpha:
        return {**out, "verdict": "semi-markov"}
    flat = exponential_likelihood(gaps)
    sims = [rng.exponential(mean, n) for _ in range(times)]
    for stage, verdict, ratio in (("hawkes", "hawkes", lambda g: hawkes_fit(np.cumsum(g))), ("hmm", "hidden states", hidden_likelihood)):
        seen = ratio(gaps) - flat
        out |= {f"{stage}_ratio": seen, f"{stage}_p": float(np.mean([ratio(g) - exponential_likelihood(g) >= seen for g in sims]))}
        if out[f"{stage}_p"] <= alpha:
            return {**out, "verdict": verdict}
    return {**out, "verdict": "unexplained"}


def tests(events: DataFrame, stream: str, order: str, gap: str, rise: str, least: int = 20) -> DataFrame:
    """A row for each stream with ``least`` positive gaps or more."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part[gap] > 0].sort_values(order)
        if len(part) < least:
            return pd.DataFrame(columns=[x.split()[0] for x in ROW.split(", ")])
        return pd.DataFrame([{"stream": part[stream].iat[0], **hierarchy(part[gap].to_numpy("f8"), part[rise].to_numpy(bool))}])

    return events.select(stream, order, gap, rise).groupBy(stream).applyInPandas(run, ROW)


def partition_effects(events: DataFrame, stream: str, order: str, gap: str, parts: int = 4, least: int = 10) -> DataFrame:
    """The distance from an exponential within each of ``parts`` contiguous parts of a stream, the last with the rest."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        g = x[x[gap] > 0].sort_values(order)[gap].to_numpy("f8")
        size = len(g) // parts
        rows = [(x[stream].iat[0], k, len(p), ks_exponential(p)) for k in range(parts) if len(p := g[k * size : (k + 1) * size if k < parts - 1 else len(g)]) >= least]
        return pd.DataFrame(rows, columns=["stream", "part", "n", "effect"])

    return events.select(stream, order, gap).groupBy(stream).applyInPandas(run, "stream string, part int, n long, effect double")
