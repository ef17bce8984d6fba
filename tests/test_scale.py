"""What must hold whatever the size of the tables: no side of a join that grows is sent to the driver, and hot keys are dealt."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import funnel as fn
from tidewright.operators import governance as gv
from tidewright.operators import graph as gr
from tidewright.operators import registries as rg
from tidewright.operators import snapshots as sn
from tidewright.operators import statistics as st
from tidewright.streaming import bars, live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_joined_without_a_broadcast(spark):
    a = spark.createDataFrame([(1, 0, 5, 15, 5), (2, 0, 90, 95, 90), (3, 1, 5, 15, 5), (4, 0, 7, 9, 7)], "access_id long, dataset long, start long, end long, at long")
    r = spark.createDataFrame([(10, 0, 10, 60, 80)], "hypothesis_id long, dataset long, start long, end long, registered_at long")
    found = gv.prior_access(a, r, spark.createDataFrame([(10, 4)], "hypothesis_id long, access_id long"))
    assert "Broadcast" not in plan(found) and [tuple(x) for x in found.collect()] == [(10, 1)]
    both = gv.overlapping(a.select(F.col("access_id").alias("id"), "dataset", "start", "end"))
    assert "Broadcast" not in plan(both) and {(x.first_id, x.second_id) for x in both.collect()} == {(1, 4)}


def test_histories_with_a_price_of_zero_count(spark):
    prices = [float(k % 3) for k in range(20)]
    stream = spark.createDataFrame([("s", i, p) for i, p in enumerate(prices)] + [("t", i, float(i)) for i in range(20)] + [("u", i, 0.0) for i in range(20)], "symbol string, i long, price double")
    events = spark.createDataFrame([(s, s, 19) for s in "stu"], "event_key string, symbol string, i long")
    got = {r.symbol: r for r in sn.enriched(sn.snapshots(events, stream)).collect()}
    assert all(r.history_valid for r in got.values())
    assert got["s"].ncf_mfe == got["t"].ncf_mfe == math.inf and math.isnan(got["u"].ncf_mfe) and all(math.isnan(r.ncf_mae) for r in got.values())
    assert got["s"].ncf_net_displacement == 1 and got["t"].ncf_abs_path_length == 19 and got["u"].ncf_path_efficiency == 0


def test_a_screened_feature_keeps_values_beyond_all_bounds(spark):
    values = [float(k) for k in range(38)] + [math.inf, math.nan]
    rows = spark.createDataFrame([(k, v, int(k % 2)) for k, v in enumerate(values)], "id long, x double, up int")
    got = {r.candidate: r for r in fn.screening(rows, "id", F.col("up"), ("x",)).collect()}
    assert {r.rows for r in got.values()} == {40} and got["x__p50_above"].threshold == 19 and list(got["x__p50_above"].sizes) == [19, 21]
    # the range is NaN, so is each place in it
    assert list(got["x__raw"].sizes) == [40] and got["x__raw"].score == 0


def test_split_gain_finds_the_best_prefix_whatever_crowds(spark, monkeypatch):
    # no feature is sorted whole
    monkeypatch.setattr(st, "running", None)
    rng = random.Random(3)
    rows = [("even", k, rng.random(), int(rng.random() < 0.5)) for k in range(3000)] + [("step", k, rng.gauss(0, 1), 0) for k in range(3000)]
    rows = [(f, k, v, int(v > 0.3) if f == "step" else y) for f, k, v, y in rows] + [("crowd", k, float(k % 7 == 0), int(900 < k < 1500 or rng.random() < 0.2)) for k in range(3000)]
    rows += [("few", k, float(k), k % 2) for k in range(3)] + [("same", k, 1.0, int(k > 5)) for k in range(12)]
    gini = lambda p, n: 1 - (p / n) ** 2 - ((n - p) / n) ** 2
    want = {}
    for name in ("even", "step", "crowd", "few", "same"):
        labels = [y for _, _, y in sorted((v, k, y) for f, k, v, y in rows if f == name)]
        n, pos, pl, best = len(labels), sum(labels), 0, 0.0
        for nl, y in enumerate(labels[:-1], 1):
            pl += y
            best = max(best, gini(pos, n) - nl / n * gini(pl, nl) - (n - nl) / n * gini(pos - pl, n - nl))
        want[name] = best if n >= 4 else 0.0
    made = st.split_gain(spark.createDataFrame(rows, "feature string, id long, value double, label int"), "id")
    got = {r.feature: r.split_gain for r in made.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-9) for f in want)


def test_a_feature_that_tells_nothing_leaves_few_rows_to_sort(spark, monkeypatch):
    # as coarse for 20,000 rows as 1023 cuts are for 80 million
    monkeypatch.setattr(st, "CUTS", 15)
    tables, stored = [], st.stored
    monkeypatch.setattr(st, "stored", lambda df, name: tables.append((name, stored(df, name))) or tables[-1][1])
    rng = random.Random(5)
    rows = [(f, k, v, int(rng.random() < 0.5)) for k in range(20_000) for f, v in (("noise", rng.random()), ("ties", float(k % 3)))]
    made = st.split_gain(spark.createDataFrame(rows, "feature string, id long, value double, label int"), "id").collect()
    want = {}
    for name in ("noise", "ties"):
        labels = np.array([y for f, k, v, y in sorted(rows, key=lambda r: (r[2], r[1])) if f == name])
        n, pos, nl, pl = len(labels), labels.sum(), np.arange(1, len(labels)), np.cumsum(labels)[:-1]
        gini = lambda p, k: 1 - (p / k) ** 2 - (1 - p / k) ** 2
        want[name] = (gini(pos, n) - nl / n * gini(pl, nl) - (n - nl) / n * gini(pos - pl, n - nl)).max()
    assert {r.feature for r in made} == want.keys() and all(math.isclose(r.split_gain, want[r.feature], abs_tol=1e-12) for r in made)
    buckets = next(df for name, df in tables if name == "buckets")
    # of some 570 buckets; before, all rows stood in open ones
    assert all(0 < len(r["at"]) < 150 for r in buckets.collect())


def test_ranked_columns_equal_ranked_rows_and_write_no_feature(spark, monkeypatch):
    from tidewright.functions.arrays import Values

    tables, stored = [], st.stored
    monkeypatch.setattr(st, "stored", lambda df, name: tables.append(df.columns) or stored(df, name))
    rng = random.Random(6)
    odd = lambda v: rng.choice([None, math.nan, math.inf, -math.inf, -0.0, 0.0, v])
    rows = [(k * 7919 - 5000, int(rng.random() < 0.4), rng.gauss(0, 1), float(k % 2), odd(float(k)), None if k % 3 else rng.random(), 4.0, None, math.inf if k == 9 else 1.0) for k in range(2500)]
    names = tuple("abcdefg")
    table = spark.createDataFrame(rows, "id long, rise int, " + ", ".join(f"{c} double" for c in names)).repartition(3)

    def columns(b):
        v = [b.column(c) for c in names]
        yield b.column("id").to_numpy(), b.column("rise").to_numpy(), [Values(x.to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)) for x in v]

    got = {r.feature: r.asDict() for r in st.ranked_columns(table, names, columns, 2500).collect()}
    assert not any(set(c) & {"a", "value"} for c in tables)
    want = {r.feature: r.asDict() for r in st.ranked(st.unpivoted(table, "id", F.col("rise"), list(names)), "id").collect()}
    same = lambda x, y: x == y or (x is not None and y is not None and (math.isclose(x, y, abs_tol=1e-9) or (math.isnan(x) and math.isnan(y))))
    assert got.keys() == want.keys() == set("abcdeg")
    for f, w in want.items():
        assert w.keys() == got[f].keys()
        for c in w.keys() - {"feature"}:
            assert same(got[f][c], w[c]), (f, c, got[f][c], w[c])


def test_features_over_arrays_follow_the_rules_of_columns(spark):
    from tidewright.functions import arrays as ar

    numbers = [None, math.nan, math.inf, -math.inf, -1.5, -0.0, 0.0, 2.0]
    pairs = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in numbers for b in numbers)]
    rules = lambda a, b: [
        a + b, 1 - a, a * b, a / ar.nullif(b, 0), (a < b).cast("double"), (a <= b).cast("double"), (a > b).cast("double"), (a >= 0).cast("double"), (a == b).cast("double"), (a != b).cast("double"),
        ((a > 0) & (b > 0)).cast("double"), ((a > 0) | (b > 0)).cast("double"), ar.coalesce(a, b, 7.0), ar.coalesce(a > b, False).cast("double"), ar.greatest(a, b, -1.0), ar.least(a, b), ar.size(a), ar.signum(a),
        a.isNull().cast("double"), a.isNotNull().cast("double"), ar.when(a > 0, 1.0).when(b > 0, b).otherwise(a), ar.when((a > 0) & b.isNotNull(), b),
    ]
    frame = spark.createDataFrame(pairs, "k int, a double, b double").repartition(2)
    want = [tuple(r)[1:] for r in sorted(frame.select("k", *[c.alias(f"r{n}") for n, c in enumerate(rules(F.col("a"), F.col("b")))]).collect())]
    made = rules(*[ar.Values(np.array([math.nan if r[c] is None else r[c] for r in pairs]), np.array([r[c] is not None for r in pairs])) for c in (1, 2)])
    got = list(zip(*[x.arrow().to_pylist() for x in made], strict=True))
    assert repr([[None if x is None else x + 0.0 for x in r] for r in got]) == repr([[None if x is None else x + 0.0 for x in r] for r in want])


def test_names_with_shared_inputs_are_paired_by_class(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 3)
    held = {k: {0, 1, 2} if k < 11 else {k % 4, 7} if k < 20 else {k} for k in range(24)}
    rows = spark.createDataFrame([(k, v) for k, vs in held.items() for v in vs for _ in range(2)], "name long, v long")
    got = [(r.a, r.b, r.shared, r.n_a, r.n_b, r.overlap) for r in rg.shared_inputs(rows, "name", "v").collect()]
    want = [(a, b, len(held[a] & held[b]), len(held[a]), len(held[b]), "full" if held[a] == held[b] else "partial") for a in held for b in held if a < b and held[a] & held[b]]
    assert sorted(got) == want


def test_pairs_of_two_blocks_are_not_kept_at_once(spark):
    rows = spark.createDataFrame([(k, v) for k in range(6) for v in range(2)], "name long, v long")
    made = rg.shared_inputs(rows, "name", "v")
    assert len(made.collect()) == 15
    # the plan that has run; a star marks what is compiled together
    explodes = [line.split("Generate")[0][-6:] for line in plan(made).split("Initial Plan")[0].splitlines() if "Generate explode" in line]
    assert len(explodes) == 2 and sum("*" in x for x in explodes) == 1


def test_slices_of_a_batch_change_no_candle_and_no_signal(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [("s", 60, 60 * max(0, k // 9 - rng.choice([0, 0, 1])), rng.random(), 2.0, 0.0, 1.0, k) for k in range(200)]
    rng.shuffle(rows)
    monkeypatch.setattr(live, "SLICE", 7)
    spark.createDataFrame(rows, live.CANDLE).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = bars.run_once(live.live_candles(spark.readStream.schema(live.CANDLE).parquet(f"file://{tmp_path}/in")), "counted")
    newest, want = -1, []
    for r in sorted(rows, key=lambda r: r[-1]):
        if r[2] >= newest:
            newest = r[2]
            want.append(r[-1])
    assert sorted(r.seq for r in got.collect()) == want and {(r.symbol, r.granularity) for r in got.collect()} == {("s", 60)}


def test_new_edges_are_numbered_on_and_need_known_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("e", "a", "b", 4)], "edge_type string, from_node string, to_node string, seq long")
    new = spark.createDataFrame([("e", "a", "b", 2), ("e", "a", "x", 1), ("e", "b", "a", 1)], "edge_type string, from_node string, to_node string, k long")
    made = gr.add_edges(nodes, edges, new, "k")
    assert {(r.from_node, r.seq) for r in made.collect()} == {("a", 5), ("b", 0)}


def test_the_last_stage_of_offers_holds_one_join(spark):
    from tidewright.plans.stores import QUERIES

    made = QUERIES["first_written_orders"](spark, "/root/testdata/sf0.001")
    joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and made.filter("writers between 1 and 5").count() == made.count() > 0
