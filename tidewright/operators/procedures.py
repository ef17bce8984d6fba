"""Which statistical procedure tests which type of candidate, and what a feature must say of itself to be registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import column_information, mutual_information

#: What a feature says of itself, and how well it may be tested.
DESCRIBED = ("name", "version", "description", "assumptions", "dependencies", "complexity", "validation_status", "max_lookahead")
VALIDATION = ("THEORETICAL", "HEURISTIC", "VALIDATED", "REPLICATED")


class Unregistered(LookupError):
    """A type of candidate has no procedure, or has one already."""


class Procedures:
    """Procedures by type of candidate. Each takes values (feature, value, label 0 or 1) and returns a row for each feature; all
    have the same columns."""

    def __init__(self) -> None:
        self._by_type: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, procedure: Callable[[DataFrame], DataFrame]) -> Procedures:
        if not kind or kind in self._by_type:
            raise Unregistered(f"{kind!r} is no type or has a procedure already")
        self._by_type[kind] = procedure
        return self

    def unregister(self, kind: str) -> bool:
        return self._by_type.pop(kind, None) is not None

    def types(self) -> list[str]:
        return list(self._by_type)

    def run(self, values: DataFrame, kinds: DataFrame) -> DataFrame:
        """``values`` (feature, value, label) by the procedures of their features' types; ``kinds`` (feature, type) is the registry, a few
        hundred rows. A type without a procedure is refused, never tested by another's."""
        by = self._chosen([r.type for r in kinds.select("type").distinct().collect()])
        typed = values.join(F.broadcast(kinds), "feature")
        return reduce(DataFrame.unionByName, [run(typed.filter(F.col("type").isin(*types)).drop("type")) for run, types in by.items()])

    def run_columns(self, rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
        """As ``run``, over a column for each feature of ``kinds`` (feature: type) and a ``label``; the procedures take such ``rows`` and
        the names of their columns. Values that are columns needn't become rows, of which there would be hundreds for each."""
        by = self._chosen(list(kinds.values()))
        return reduce(DataFrame.unionByName, [run(rows, [n for n, t in kinds.items() if t in types]) for run, types in by.items()])

    def _chosen(self, kinds: list[str]) -> dict[Callable, list[str]]:
        """The procedures with their types; types that share one are tested in one pass."""
        wanted = sorted(set(kinds))
        lacking = [t for t in wanted if t not in self._by_type]
        if lacking:
            raise Unregistered(f"no procedure for candidates of type {lacking}")
        by: dict[Callable, list[str]] = {}
        for t in wanted:
            by.setdefault(self._by_type[t], []).append(t)
        return by


def information(values: DataFrame) -> DataFrame:
    """Mutual information of each feature, in ten bins of equal width, with the label, beside how often the label holds."""
    each = values.groupBy("feature").agg(F.count("*").alias("pairs"), F.avg(F.col("label").cast("double")).alias("rises"))
    return each.join(mutual_information(values, 10).withColumnRenamed("mutual_information", "information"), "feature")


def columns_information(rows: DataFrame, names: list[str]) -> DataFrame:
    """As ``information``, of columns, whose values are rounded to five places."""
    return column_information(rows, names, 10, 5).withColumnRenamed("mutual_information", "information")


def core(procedure: Callable = information) -> Procedures:
    """The procedures for series over ticks."""
    out = Procedures()
    for kind in ("indicator", "state", "proxy", "composite", "conditional"):
        out.register(kind, procedure)
    return out


def breaches(features: DataFrame) -> DataFrame:
    """``features`` (columns of DESCRIBED) with ``errors``, what each has against the contract, and ``valid``: every field is there, the
    status is one of VALIDATION, it looks at nothing ahead, and no other feature has its name."""
    twice = features.groupBy("name").agg(F.count("*").alias("_n"))
    checks: list[tuple[str, Column]] = [(f"{c} is missing", F.col(c).isNull()) for c in DESCRIBED]
    checks.append(("validation_status is unknown", ~F.col("validation_status").isin(*VALIDATION)))
    checks.append(("max_lookahead must be 0", F.col("max_lookahead") != 0))
    checks.append(("name is taken", F.col("_n") > 1))
    errors = F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks]), lambda e: e.isNotNull())
    return features.join(twice, "name", "left").withColumn("errors", errors).drop("_n").withColumn("valid", F.size("errors") == 0)
