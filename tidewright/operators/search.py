"""Searches whose steps are scored by Spark jobs: a generation, or all states of a tree level, in one aggregation. The driver
holds only what is searched, not what it is scored on."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mask = tuple[bool, ...]


def lift(rows: DataFrame, conditions: list[Column], outcome: str, masks: list[Mask], least: int = 30) -> dict[Mask, float]:
    """For each mask how much the mean of ``outcome`` where all its conditions hold is above the mean of all rows, 0 where
    fewer than ``least`` rows are left; one pass for all masks."""
    tests = {m: F.coalesce(_all([c for c, on in zip(conditions, m, strict=True) if on]), F.lit(False)) for m in dict.fromkeys(masks)}
    one = rows.agg(F.avg(outcome).alias("all"), *[x for k, t in enumerate(tests.values()) for x in (F.avg(F.when(t, F.col(outcome))).alias(f"m{k}"), F.count_if(t).alias(f"n{k}"))]).first()
    return {m: (one[f"m{k}"] - one["all"]) if one[f"n{k}"] >= least else 0.0 for k, m in enumerate(tests)}


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def evolved(score: Callable[[list[Mask]], dict[Mask, float]], genes: int, size: int = 12, generations: int = 20, seed: int = 42, mutation: float = 0.1) -> tuple[Mask, float]:
    """The fittest mask after ``generations``: parents by tournaments of three, uniform crossing, mutation, and the best one
    kept. A generation's unseen masks are scored together."""
    rng = random.Random(seed)
    known: dict[Mask, float] = {}
    people = [tuple(rng.random() < 0.5 for _ in range(genes)) for _ in range(size)]
    for _ in range(generations):
        fresh = [p for p in dict.fromkeys(people) if p not in known]
        if fresh:
            known |= score(fresh)
        best = max(people, key=lambda p: (known[p], p))
        parent = lambda: max(rng.sample(people, 3), key=lambda p: (known[p], p))  # noqa: B023, E731
        children = [tuple((a if rng.random() < 0.5 else b) != (rng.random() < mutation) for a, b in zip(parent(), parent(), strict=True)) for _ in range(size - 1)]
        people = [best, *children]
    fresh = [p for p in dict.fromkeys(people) if p not in known]
    known |= score(fresh) if fresh else {}
    best = max(people, key=lambda p: (known[p], p))
    return best, known[best]


def tree_search(score: Callable[[list[Mask]], dict[Mask, float]], genes: int, playouts: int = 200, batch: int = 20, seed: int = 42) -> tuple[Mask, float, dict[int, int]]:
    """Monte-Carlo tree search over masks built gene by gene: children by upper confidence bound, unvisited ones first, random
    playouts, rewards added up the path. ``batch`` playouts are walked before their masks are scored together. The mask that
    the most visited children lead to, its score, and the visits of the root's children."""
    rng = random.Random(seed)
    visits: dict[Mask, int] = {(): 0}
    rewards: dict[Mask, float] = {(): 0.0}
    known: dict[Mask, float] = {}
    for _ in range(0, playouts, batch):
        walked = []
        for _ in range(batch):
            node: Mask = ()
            path = [node]
            while len(node) < genes:
                children = [(*node, b) for b in (False, True)]
                new = [c for c in children if c not in visits]
                if new:
                    node = rng.choice(new)
                    visits[node], rewards[node] = 0, 0.0
                    path.append(node)
                    break
                node = max(children, key=lambda c: (math.inf if not visits[c] else rewards[c] / visits[c] + math.sqrt(2 * math.log(max(visits[node], 1)) / visits[c]), c))  # noqa: B023
                path.append(node)
            for n in path:
                visits[n] += 1  # a visit counts at once, so that walks of one batch spread out
            walked.append((path, (*node, *(rng.random() < 0.5 for _ in range(genes - len(node))))))
        fresh = [m for m in dict.fromkeys(m for _, m in walked) if m not in known]
        known |= score(fresh) if fresh else {}
        for path, m in walked:
            for n in path:
                rewards[n] += known[m]
    node = ()
    while len(node) < genes:
        node = max([(*node, b) for b in (False, True)], key=lambda c: (visits.get(c, 0), c))
    if node not in known:
        known |= score([node])
    return node, known[node], {int(c[0]): visits.get(c, 0) for c in ((False,), (True,))}
