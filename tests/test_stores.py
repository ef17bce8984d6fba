"""Stores under several writers, the live feed, streams with state, and what is decided one after the other."""

import base64
import hashlib
import json
import math
import random
import socket
import struct
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewright.operators import candles as cd
from tidewright.operators import learning as ln
from tidewright.operators import lineages as lg
from tidewright.operators import provenance as pv
from tidewright.operators.reconciliation import Sweep
from tidewright.sources import feed as fd
from tidewright.sources.ledger import DuplicateKey
from tidewright.sources.shared import place
from tidewright.sources.versions import IdentityChanged, Versions, made_first
from tidewright.streaming import live

BOXES = "id string, owner string, consumed_at long, consumed_by string"


def boxes(spark, name="boxes"):
    return Versions(spark, place(spark, name), BOXES, ["id"], guard="consumed_at", unique=("owner",), indexes={"by_owner": ["owner", "id"]})


def test_of_many_writers_one_makes_a_version(spark):
    path = place(spark, "race")
    Versions(spark, path, "k long", ["k"])
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: made_first(spark, f"{path}/_log/00000000000000000001", f"writer {n}"), range(8)))
    assert sum(won) == 1 and spark.read.text(f"{path}/_log").first().value == f"writer {won.index(True)}"


def test_no_change_of_concurrent_writers_is_lost(spark):
    store = Versions(spark, place(spark, "counter"), "k string, n long", ["k"])
    store.add(spark.createDataFrame([("all", 0)], "k string, n long"))

    def one(n):
        mine = Versions(spark, store.path, "k string, n long", ["k"])
        mine.change(lambda now: now.filter("k = 'all'").select("k", (F.col("n") + 1).alias("n")))
        mine.write_once(spark.createDataFrame([("first", n), (f"w{n}", n)], "k string, n long"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(6)))
    rows = {r.k: r.n for r in store.read().collect()}
    assert rows["all"] == 6 and set(rows) == {"all", "first", *(f"w{n}" for n in range(6))} and store.version() == 13


def test_one_taker_gets_a_lockbox(spark):
    store = boxes(spark)
    store.add(spark.createDataFrame([("a", "x", None, None), ("b", "x", None, None), ("c", "y", 5, "before")], BOXES))
    with ThreadPoolExecutor(4) as pool:
        ends = list(pool.map(lambda n: store.consume_once(spark.createDataFrame([("a", f"t{n}"), ("zz", f"t{n}"), ("c", f"t{n}")], "id string, consumed_by string"), 77 + n).collect(), range(4)))
    got = [{r.id: (r.ok, r.reason) for r in e} for e in ends]
    winner = [n for n, e in enumerate(got) if e["a"][0]]
    assert len(winner) == 1 and all(e["zz"] == (False, "not-found") and e["c"] == (False, "precondition-failed") for e in got)
    now = {r.id: (r.consumed_at, r.consumed_by) for r in store.read().collect()}
    assert now == {"a": (77 + winner[0], f"t{winner[0]}"), "b": (None, None), "c": (5, "before")}
    null_guard = store.consume_once(spark.createDataFrame([("b", None, "t")], "id string, consumed_at long, consumed_by string"), 99)
    assert null_guard.first().ok and {r.consumed_at for r in store.read().filter("id = 'b'").collect()} == {99}
    store.add(spark.createDataFrame([("d", "x", None, None)], BOXES))
    with pytest.raises(IdentityChanged):
        store.consume_once(spark.createDataFrame([("d", "other")], "id string, owner string"), 1)
    with pytest.raises(DuplicateKey):
        store.add(spark.createDataFrame([("e", "x", None, None), ("a", "x", None, None)], BOXES))
    assert store.read().filter("id = 'e'").isEmpty() and store.read(1).filter("consumed_at is null").count() == 2


def test_indexes_and_compaction(spark):
    store = boxes(spark)
    store.add(spark.createDataFrame([("a", "x", None, None), ("b", "x", None, None), ("c", "y", None, None)], BOXES))
    store.consume_once(spark.createDataFrame([("a",)], "id string"), 3)
    before = sorted(map(tuple, store.read().collect()))
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before and store.history().select("_version").distinct().count() == 1
    assert [r.id for r in store.listed("by_owner", ["x"]).collect()] == ["b", "a"] and {r.id for r in store.latest("by_owner").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        store.listed("by_owner", ["x", "a"])
    assert store.problems() == []
    drifted = Versions(spark, store.path, BOXES, ["id"], indexes={"by_owner": ["owner"], "by_time": ["time"]})
    assert drifted.problems() == ["index by_time names time, which the rows lack", "index by_owner isn't unique"]
    empty = boxes(spark, "empty")
    assert empty.version() == 0 and empty.read().isEmpty()
    empty.compact()
    assert empty.version() == 0


class Service(threading.Thread):
    """A service that speaks WebSocket and hangs up without an answer whenever ``drops`` says so."""

    def __init__(self, ticks, now, drops):
        super().__init__(daemon=True)
        self.ticks, self.now, self.drops, self.asked, self.lock = ticks, now, drops, 0, threading.Lock()
        self.server = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.server.getsockname()[1]}/feed?v=1"

    def run(self):
        while True:
            try:
                s, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self.serve, args=(s,), daemon=True).start()

    def serve(self, s):
        f = s.makefile("rb")
        head = {}
        f.readline()
        while line := f.readline().strip():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        accept = base64.b64encode(hashlib.sha1(head["sec-websocket-key"].encode() + fd._GUID).digest()).decode()
        s.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())

        def send(data, opcode=1, fin=128):
            n = len(data)
            s.sendall(bytes([fin | opcode]) + (bytes([n]) if n < 126 else struct.pack("!BH", 126, n) if n < 65536 else struct.pack("!BQ", 127, n)) + data)

        while first := f.read(2):
            n = first[1] & 127
            n = struct.unpack("!H", f.read(2))[0] if n == 126 else n
            mask = f.read(4)
            data = bytes(b ^ mask[i & 3] for i, b in enumerate(f.read(n)))
            if first[0] & 15 == 10:
                continue
            said = json.loads(data)
            with self.lock:
                self.asked += 1
                drop = self.drops(self.asked)
            if drop:
                s.close()
                f.close()
                return
            send(json.dumps({"msg_type": "tick", "tick": {"quote": 1}}).encode())  # unasked
            send(b"", 9)
            if "time" in said:
                out = {"time": self.now}
            elif said["ticks_history"] not in self.ticks:
                out = {"error": {"message": "no such symbol"}}
            else:
                rows = [t for t in self.ticks[said["ticks_history"]] if said["start"] <= t[0] <= said["end"]][: said["count"]]
                out = {"history": {"times": [t for t, _ in rows], "prices": [p for _, p in rows]}}
            whole = json.dumps({**out, "req_id": said["req_id"]}).encode()
            half = len(whole) // 2
            send(whole[:half], 1, 0)
            send(whole[half:], 0)


def service(drops, n=900):
    rng = random.Random(2)
    ticks = {s: sorted((1000 + rng.randrange(600), round(rng.random() * 100, 2)) for _ in range(n)) for s in ("R_10", "R_50")}
    made = Service(ticks, 1500, drops)
    made.start()
    return made, {(s, t, p) for s, rows in ticks.items() for t, p in rows if t <= 1499}, sum(t <= 1499 for rows in ticks.values() for t, _ in rows)


def test_feed_reconnects_to_the_next_address_and_loses_nothing():
    made, _, _ = service(lambda n: n % 3 == 0)
    dead = socket.create_server(("127.0.0.1", 0))
    gone = f"ws://127.0.0.1:{dead.getsockname()[1]}"
    dead.close()
    feed = fd.Feed([gone, made.url], wait=0.01)
    got = list(feed.ticks("R_10", 0, 2000, page=50))
    assert [(t, p) for _, t, _, p in got] == made.ticks["R_10"] and feed.reconnects > 5 and feed.now() == 1500
    assert len({(t, k) for _, t, k, _ in got}) == len(got)
    with pytest.raises(fd.FeedError, match="no such symbol"):
        list(feed.ticks("nothing", 0, 1))
    with pytest.raises(fd.FeedError, match="more than 1 ticks"):
        list(feed.ticks("R_10", 0, 2000, page=1))
    with pytest.raises(fd.FeedError, match="in 2 tries"):
        fd.Feed([gone], wait=0.01, tries=2).now()
    made.server.close()


def test_feed_as_a_streaming_source(spark, tmp_path):
    made, want, n = service(lambda n: n % 4 == 0)
    fd.register(spark)
    options = {"urls": made.url, "symbols": "R_10,R_50", "wait": "0.01", "slice": "100", "start": "1000", "page": "60"}
    past = spark.read.format("tick_feed").options(**options, end="1499").load()
    assert past.count() == n and {(r.symbol, r.epoch, r.price) for r in past.collect()} == want
    out = f"file://{tmp_path}/ticks"

    def start(stream):
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/progress").start()

    q = start(spark.readStream.format("tick_feed").options(**options).load())
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == n
    made.now = 1700  # the service went on while nobody listened
    q = start(spark.readStream.format("tick_feed").options(**options).load())
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(out)
    assert rows.count() == 1800 == rows.select("symbol", "epoch", "k").distinct().count()
    made.server.close()


def in_batches(spark, rows, schema, tmp_path, parts):
    """``rows`` as a stream of one file a batch."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_late_candles_are_dropped_across_batches_and_the_rest_upserted(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(2)}", 60, 60 * max(0, k // 9 - rng.choice([0, 0, 0, 1, 2])), rng.random(), 2.0, 0.0, rng.random(), k) for k in range(300)]
    newest, want = {}, {}
    for r in rows:
        if r[2] >= newest.get(r[0], -1):
            newest[r[0]] = r[2]
            want[r[0], r[2]] = (r[3], r[6], r[7])
    store = Versions(spark, place(spark, "candles"), live.CANDLE, ["symbol", "granularity", "epoch"])
    stream = live.live_candles(in_batches(spark, rows, live.CANDLE, tmp_path, 5))
    for _ in range(2):  # a progress folder of its own: all batches come once more
        live.upserted(stream, store, place(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
        assert {(r.symbol, r.epoch): (r.open, r.close, r.seq) for r in store.read().collect()} == want
    assert store.version() >= 2 and len(want) < 120


def test_streamed_aggression_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows, t = [], 0
    for k in range(500):
        t += rng.choice([0, 1, 5, 40])
        rows.append((rng.choice("ab"), t, k, round(100 + rng.gauss(0, 1) + (k // 50 % 3 - 1) * k % 50, 2)))
    schema = "symbol string, t long, event_id long, price double"
    stream = in_batches(spark, rows, schema, tmp_path, 4).withColumn("ts", F.timestamp_seconds("t"))
    out = f"file://{tmp_path}/out"
    live.aggression(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    got = {(r.symbol, r.start): r for r in spark.read.parquet(out).collect()}
    by = {s: [r for r in rows if r[0] == s] for s in "ab"}
    ticks = spark.createDataFrame([(s, i, r[1], r[3]) for s, rs in by.items() for i, r in enumerate(rs)], "symbol string, i long, t long, price double").withColumn("ts", F.timestamp_seconds("t"))
    want = {(r.symbol, r.start): r for r in cd.aggression(ticks).collect()}
    last = {s: max(k[1] for k in want if k[0] == s) for s in "ab"}
    assert set(got) == {k for k in want if k[1] < last[k[0]]} and len(got) > 40
    for k, r in got.items():
        w = want[k]
        assert (r.up_ticks, r.down_ticks, r.ticks, r.score, r.verdict) == (w.up_ticks, w.down_ticks, w.ticks, w.score, w.verdict)
        assert math.isclose(r.up_mag, w.up_mag, abs_tol=1e-9) and math.isclose(r.intensity, w.intensity, abs_tol=1e-9)
    assert len({r.verdict for r in got.values()}) >= 4


def test_trades_learn_from_what_stood_when_they_opened(spark):
    evidence = spark.createDataFrame([("a", 5, {"trend": 1.0}), ("a", 10, {"trend": -1.0}), ("b", 3, {"trend": 1.0, "genome": 0.0})], "symbol string, i long, dimensions map<string,double>")
    opened = spark.createDataFrame([("t1", "a", 9), ("t2", "a", 10), ("t3", "a", 4), ("t5", "b", 2)], "trade string, symbol string, i long")
    closed = spark.createDataFrame([("t1", "a", 12, 1, True, 1.0), ("t2", "a", 12, 1, False, -1.0), ("t3", "a", 6, -1, True, 2.0), ("t4", "b", 9, 1, True, 1.0), ("t5", "b", 2, 1, True, 1.0)], "trade string, symbol string, i long, direction int, won boolean, pnl double")
    got = {r.trade: (r.dimensions["trend"], r.approximate) for r in ln.learned(opened, closed, evidence).collect()}
    assert got == {"t1": (1.0, False), "t2": (-1.0, False), "t3": (1.0, True), "t4": (1.0, True)}
    few = ln.calibrated(ln.learned(opened, closed, evidence)).collect()
    assert {r.dimension: r.weight for r in few} == ln.WEIGHTS and not few[0].calibrated and few[0].sample_size == 4
    log = [(1 if k % 2 else -1, k % 3 > 0, {"trend": 1.0, "genome": -1.0 if k % 4 else 0.0, "history": 1.0 if k < 4 else None}) for k in range(30)]
    got = {r.dimension: r for r in ln.calibrated(spark.createDataFrame(log, "direction int, won boolean, dimensions map<string,double>")).collect()}
    rate, raw = sum(won for _, won, _ in log) / 30, dict(ln.WEIGHTS)
    for d in ("trend", "genome"):
        agreed = [won for way, won, s in log if s[d] and math.copysign(1, s[d]) == way]
        raw[d] *= max(0.5, min(1.5, 1 + (sum(agreed) / len(agreed) - rate) * 2))
    for d, w in raw.items():
        assert math.isclose(got[d].weight, w / sum(raw.values()), rel_tol=1e-12)
    assert got["history"].relevant == 4


def test_a_lineage_is_indeterminate_once(spark):
    rng = random.Random(4)
    rows = [(f"l{rng.randrange(6)}", f"h{k}", rng.randrange(9), rng.choice([0.1, 0.79, 0.8, None, float("nan")]), rng.choice([True, True, False, None]), rng.choice(["ann", "", None, "bo"]), rng.choice(["why", ""])) for k in range(300)]
    got = {r.hypothesis: (r.classification, r.reason) for r in lg.gated(spark.createDataFrame(rows, "lineage string, hypothesis string, seq int, power double, drift boolean, approved_by string, rationale string")).collect()}
    used, want = set(), {}
    for lineage, h, _, power, drift, by, why in sorted(rows, key=lambda r: (r[2], r[1])):
        met = power is not None and power < 0.8 and drift is True and by and why
        want[h] = ("Rejected", lg.REASONS["used" if met else "criteria"]) if not met or lineage in used else ("Indeterminate", lg.REASONS["granted"])
        used |= {lineage} if met else set()
    assert got == want and len(used) >= 5
    decisions = spark.createDataFrame([("l", "h1", 0.5, "ann", "Indeterminate"), ("l", "h2", 0.5, "ann", "Rejected")], "lineage string, hypothesis string, power double, approved_by string, classification string")
    moves = lg.annotated(decisions, spark.createDataFrame([("h1", "Discovery", 2), ("h2", "Discovery", 1)], "hypothesis string, stage string, seq long")).collect()
    assert [(r.hypothesis, r.seq, r["from"], r.to) for r in moves] == [("h1", 3, "Discovery", "Discovery")]


def admitted_by_hand(nodes, edges):
    parents, out = {}, {}

    def above(n):
        seen, todo = set(), [n]
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    for c, p, s in sorted(edges, key=lambda e: e[2]):
        if c not in nodes or p not in nodes:
            out[s] = "unknown"
        elif c == p:
            out[s] = "self"
        elif c in above(p):
            out[s] = "cycle"
        else:
            out[s] = None
            parents.setdefault(c, set()).add(p)
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 8, 18), (2, 40, 44)])
def test_edges_are_admitted_as_one_after_the_other(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n + 1), rng.randrange(n), s) for s in rng.sample(range(1000), m)]
    got = {r.seq: r.refused for r in pv.admitted(spark.range(n).withColumnRenamed("id", "id"), spark.createDataFrame(edges, "child long, parent long, seq long")).collect()}
    want = admitted_by_hand(set(range(n)), edges)
    assert got == want and "cycle" in want.values()


def test_descendants_and_graphs_without_edges(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("c", "d")], "child string, parent string")
    got = {(r.node, r.descendant): r.distance for r in pv.descendants(edges).collect()}
    assert got == {("a", "b"): 1, ("a", "d"): 1, ("b", "c"): 1, ("d", "c"): 1, ("a", "c"): 2}
    none = spark.createDataFrame([], "child long, parent long, seq long")
    assert pv.admitted(spark.range(3), none).isEmpty()


def test_a_sweep_reports_each_stage_and_never_overlaps(spark):
    begun, go = threading.Event(), threading.Event()
    sweep = Sweep(spark)
    assert sweep.run().isEmpty() and sweep.last_status == "ok"

    def slow():
        begun.set()
        go.wait(20)
        return 4

    def broken():
        raise KeyError("gone")

    sweep.register("slow", slow)
    sweep.register("broken", broken)
    with pytest.raises(ValueError):
        sweep.register("slow", slow)
    with ThreadPoolExecutor(1) as pool:
        first = pool.submit(sweep.run)
        begun.wait(20)
        assert sweep.run() is None
        go.set()
        rows = {r.stage: (r.ok, r.value, r.error, r.status) for r in first.result().collect()}
    assert rows == {"slow": (True, 4, None, "partial"), "broken": (False, None, "KeyError", "partial")}
