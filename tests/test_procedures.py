"""Dispatch by type of candidate, and the contract of features."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import procedures as pr


def test_each_type_gets_its_own_procedure_and_none_another(spark):
    values = spark.createDataFrame([(f, float(k % 4), k % 2) for f in ("a", "b", "c") for k in range(40)], "feature string, value double, label int")
    kinds = spark.createDataFrame([("a", "state"), ("b", "proxy"), ("c", "state"), ("d", "proxy")], "feature string, type string")
    count = lambda v: v.groupBy("feature").agg(F.count("*").alias("out"))
    none = lambda v: v.groupBy("feature").agg(F.lit(-1).cast("long").alias("out"))
    p = pr.Procedures().register("state", count)
    with pytest.raises(pr.Unregistered, match="proxy"):
        p.run(values, kinds)
    p.register("proxy", none)
    assert {r.feature: r.out for r in p.run(values, kinds).collect()} == {"a": 40, "c": 40, "b": -1}
    with pytest.raises(pr.Unregistered):
        p.register("state", none)
    assert p.unregister("proxy") and not p.unregister("proxy") and p.types() == ["state"]
    got = {r.feature: r for r in pr.core().run(values, kinds).collect()}
    assert abs(got["a"].information - 1) < 1e-12 and got["b"].pairs == 40 and got["a"].rises == 0.5


def test_features_that_break_the_contract(spark):
    good = ("f", "1", "d", ["x"], [], "O(n)", "VALIDATED", 0)
    rows = [good, ("g", None, "d", [], [], "O(n)", "GUESSED", 0), ("h", "1", "d", [], [], "O(n)", "HEURISTIC", 2), ("i", "1", "d", [], [], "O(n)", None, 0), ("j", *good[1:]), ("j", *good[1:])]
    df = spark.createDataFrame(rows, "name string, version string, description string, assumptions array<string>, dependencies array<string>, complexity string, validation_status string, max_lookahead int")
    got = sorted((r.name, r.errors, r.valid) for r in pr.breaches(df).collect())
    assert got == [
        ("f", [], True), ("g", ["version is missing", "validation_status is unknown"], False), ("h", ["max_lookahead must be 0"], False),
        ("i", ["validation_status is missing"], False), ("j", ["name is taken"], False), ("j", ["name is taken"], False),
    ]
