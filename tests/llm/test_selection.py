"""Filter audit, line dedup and resampling against brute force, over nulls, ties, copies, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, interactions, lines, resample

WORDS = "the of river Cloud GARDEN été straße 你好 x9 data, end.".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", str(rng.randrange(300))]) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.choice([3, 30, 250, 400])), f"s{i % 3}") for i in range(60)]
    rows += [(i, "same few words\n" * 80, "s0") for i in range(60, 90)]
    rows += [(90, None, None), (91, "", "s1"), (92, " \n\t ", None), (93, "#", "s1"), (94, "ABC " * 300, "s2"), (95, prose(rng, 30_000), "s2"), (96, rows[2][1], "s1"), (97, rows[2][1], None)]
    rows += [(5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (None, rows[2][1], "s1"), (-4, rows[3][1], "s1")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in ROWS], "doc_id long, text string, source string, part int, n_lines string").repartition(5).cache()


def failures(t, first, i):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] is not None and i > first[t],
    }


def test_audit_equals_applying_every_order(spark, docs):
    rng = random.Random(2)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 96, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    first = {}
    for i, t, _ in ROWS:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    first = defaultdict(lambda: None, first)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, s in ROWS:
        parts[s or ""].append((i, failures(t or "", first, i)))
    want, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                hit, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in rows)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                want[part, order, step] = (len(left), len(hit), fails - len(hit), alone, sum(r[0] in good for r in hit), sum(r[0] in toxic for r in hit))
                shapley[part, f] += len(hit)
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert sum(want[p, "ABCDE", 1][1] for p in parts) > 0 and any(v[3] for v in want.values())
    assert interactions.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_bitmaps_count_across_words_runs_and_many_parts(spark):
    """Parts of 1 to 200 documents and one that fills several runs of a partition, over three filters."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, F.concat(F.lit("p"), F.sqrt("id").cast("int").cast("string"))).alias("part"),
        *[(F.xxhash64("id", F.lit(c)) % k == 0).alias(c) for c, k in (("X", 2), ("Y", 3), ("Z", 5), ("L", 4))],
    )
    bitmaps = interactions.index(rows.coalesce(2), ["X", "Y", "Z", "L"])
    assert bitmaps.filter("part = 'hot'").count() >= 3
    got = {(r.part, r["mask"]): (r.passed, r.L) for r in interactions.subset_counts(bitmaps, ["X", "Y", "Z"], ["L"]).collect()}
    want = defaultdict(lambda: [0, 0])
    for r in rows.select(F.coalesce("part", F.lit("")).alias("part"), *"XYZL").toPandas().itertuples(index=False):
        failing = r.X | 2 * r.Y | 4 * r.Z
        for mask in range(8):
            want[r.part, mask][0] += not failing & mask
            want[r.part, mask][1] += bool(not failing & mask and r.L)
    assert len(got) == len(want) and all(got[k] == tuple(v) for k, v in want.items())


def line_corpus():
    rng = random.Random(4)
    shared = [prose(rng, 12) + "x" * 40 for _ in range(30)]
    short, exact = "a line of fewer than forty characters", "é" * 40
    rows = []
    for i in range(300):
        of = [rng.choice(shared[: 1 + i // 10]) for _ in range(rng.randrange(4))] + [prose(rng, 9) for _ in range(3)]
        if i % 3 == 0:
            of.append("THE line that A third of all documents hold, " + "and more of it")
        if i % 5 == 0:
            of += [short, f" \t{exact}\x0b" if i % 2 else exact.upper(), "", exact]
        rng.shuffle(of)
        rows.append((i, "\n".join(of)))
    four = "only four documents hold this line, so that it stays there"
    rows += [(300 + k, f"{four}\n\r\n{four}\n{k}") for k in range(4)] + [(304, f"{four}e \n")]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, (shared[0] + "\n") * 2000), (None, shared[1] + "\nrest"), (None, exact)]
    return rows


def lines_by_hand(rows, least=5, chars=40):
    def key(x):
        return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))

    holders = defaultdict(Counter)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders[k][i] += 1
    last = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if sum(h.values()) >= least}
    out = []
    for i, t in rows:
        whole = (t or "").split("\n")
        stay = [x for x in whole if key(x) not in last or last[key(x)] == i]
        text = "\n".join(stay)
        out.append((i, t if len(stay) == len(whole) else text, len(whole), len(whole) - len(stay), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_batches,fan", [(1, 3), (4, 3), (11, 2)])
def test_lines_equal_brute_force(spark, n_batches, fan):
    rows = line_corpus()
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, n_lines int, key string").repartition(4)
    out = lines.dedup(docs, n_batches=n_batches, fan=fan)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()], key=str)
    assert got == lines_by_hand(rows) and sum(r[3] for r in got) > 500
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_of_repeated_rows_and_empty_tables(spark):
    line = "one line of more than forty characters, repeated by rows"
    rows = [(7, line)] * 3 + [(8, f"{line}\n{line}")] * 2
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == [(7, 1, 1, "")] * 3 + [(8, 2, 0, f"{line}\n{line}")] * 2
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled_and_leave_settled_lines_out(spark):
    store = lines.Runs(spark, least=2, fan=2)
    for batch in ([(9, b"a"), (8, b"a"), (9, b"b")], [(7, b"a"), (7, b"b"), (7, b"c")], [(6, b"a"), (6, b"b"), (6, b"d")], [(5, b"c")], [(4, b"e")]):
        store.add(spark.createDataFrame(batch, "doc_id long, key binary"))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert {(bytes(r.key), r.docs, r.last) for r in store.runs()[1].collect()} == {(b"a", 2, 9), (b"b", 2, 9), (b"c", 2, 7), (b"d", 1, 6)}
    assert {bytes(r.key) for r in store.settled().collect()} == {b"a", b"b", b"c"}
    store.close()


def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def test_resampling_equals_brute_force(spark, docs):
    rng = random.Random(9)
    target = [prose(rng, 40) for _ in range(20)] + [None, ""]
    got = resample.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, weight int")).collect()
    s, t = Counter(), Counter()
    made = [(i, *features(x or "")) for i, x, _ in ROWS]
    for _, _, f in made:
        s.update(f)
    for x in target:
        t.update(features(x or "")[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted([r for r in rows if r[1] >= 20], key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    want = sorted([(*r, drawn.get(id(r))) for r in rows], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=str) == want
    assert len(drawn) == 4 and len({r[3] for r in want}) > 50


def test_resampling_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b " * 20) for i in (3, 1, 2)] * 20, "doc_id long, text string")
    got = resample.resample(docs, docs.limit(0), percent=50).collect()
    order = sorted(r.score for r in got if r["rank"] is not None)
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 31))
    assert order[0] >= max(r.score for r in got if r["rank"] is None)
    assert resample.resample(docs.limit(0), docs).count() == 0 and resample.resample(docs.limit(0), docs.limit(0)).count() == 0


def test_counts_of_a_large_vector_are_exact():
    source, target = np.array([0, 3, 10**12]), np.array([5, 0, 2])
    assert resample.gains(source, target).tolist() == [math.floor(1000 * math.log((t + 1) * (float(source.sum()) + 3) / ((s + 1) * 10.0))) for s, t in zip(source.tolist(), target.tolist())]


def test_texts_of_one_table_serve_all_three(spark, docs):
    one = common.texts(docs)
    assert lines.dedup(one).count() == resample.resample(one, one).count() == one.count()
