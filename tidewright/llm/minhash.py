"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

A sketch has ``coordinates`` bins. In round i every shingle is hashed into one bin with a value that is larger than any
of earlier rounds; rounds go on until each bin is full, and after as many rounds as there are bins the remaining bins
take a minimum of their own, so every bin fills. Bands of a sketch are hashed; documents that share a band are candidates.

Documents with equal shingle sets form a class first, of which the smallest doc_id stands for all, so copies never meet
in a bucket. In each bucket the member whose bands are shared most is the centre, all others are compared with it on
their full sets, and components are joined. Members of a bucket that are then still in different components are compared
with their likeliest partners, and at last with every member of another component whose finer sketch leaves a link
possible. A sketch rules a link out only when its estimate is four standard deviations below the threshold. Each pair is taken from
the first band that both share alone.

A null text, or one without words, has no shingles and links with nothing. With fewer than ``width`` words the whole
sequence is the one shingle. A null doc_id stays alone: its component is null and it is kept. Rows that repeat a document
get the same answer. Shingles are compared as 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import materialize, texts

COORDINATES, ROWS = 130, 5
#: Coordinates of the finer sketches, made only of documents that are still apart from a member of their bucket.
FINE = 512
SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, 2 * max(COORDINATES, FINE) + 1, dtype="u8") * _K[0])


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, width: int = 5, most: int = 500_000):
        import xxhash

        self.width, self.most = width, most
        self.memo = Memo(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"))

    def __call__(self, text: str) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        h = np.frombuffer(b"".join(map(self.memo.__getitem__, text.encode().lower().split())), "<u8")
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, "u8")
        for i in range(width):
            out = mix(out * _K[0] + h[i : len(h) - width + 1 + i])
        return np.unique(out)


def sketch(items: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    out = np.full(n, np.iinfo("u8").max, "u8")
    full = np.iinfo("u8").max
    at, step = 0, max(1, 2048 // len(items))
    while at < n and (out == full).any():
        rounds = np.arange(at, min(n, at + step), dtype="u8")
        h = mix(items[None, :] ^ SEEDS[rounds.astype("i8")][:, None])
        bins = (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype("i8")
        np.minimum.at(out, bins.ravel(), ((rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        at += step
    for j in np.flatnonzero(out == full).tolist():
        out[j] = (np.uint64(n + j) << np.uint64(32)) | (mix(items ^ SEEDS[n + j]) & np.uint64(0xFFFFFFFF)).min()
    return out


def bands(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sk.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype="u8") * _K[0]
    for i in range(rows):
        h = mix(h * _K[1] + parts[:, i])
    return h.view("i8")


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        shingles = Shingler()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                out = []
                part = whole.iloc[at : at + 1000]
                for doc, text in zip(part["doc_id"].tolist(), part["text"].tolist(), strict=True):
                    s = shingles(text)
                    doc = None if pd.isna(doc) else int(doc)
                    if not len(s):
                        out.append((doc, 0, None, None))
                        continue
                    out.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands(sketch(s))))
                frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "bands"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return docs.select("doc_id", "text").mapInPandas(run, SKETCH)


def prints(docs: DataFrame) -> DataFrame:
    """Of each of ``docs`` (doc_id, text) a fine sketch, a byte for each coordinate: doc, print."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for x in batches:
            made = [(mix(sketch(shingles(t), FINE)) >> np.uint64(56)).astype("u1").tobytes() for t in x["text"]]
            yield pd.DataFrame({"doc": x["doc_id"], "print": made})

    return docs.select("doc_id", "text").mapInPandas(run, "doc long, print binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): each node and the smallest node it reaches, as (node, component).

    Large stars and small stars take turns until the edges are a forest of stars whose centres are their smallest nodes.
    A large star ties each larger neighbour of a node to the smallest node of its neighbourhood, a small star does so with
    the node and its smaller neighbours. Both keep components; a longest path shrinks to a fraction in each turn, so the
    number of turns grows with a power of the logarithm of the number of nodes and no cap is set. Edges of a node to itself
    and repeated edges count for nothing, except that the node is listed; an empty table has no components."""
    alone = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    stars = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        spread = stars.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        if spread.filter("low < high").isEmpty() and stars.join(stars.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").isEmpty():
            break
    tied = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = alone.distinct().join(tied.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return materialize(tied.union(centres), "labels")


def _large_star(stars: DataFrame) -> DataFrame:
    """``stars`` (a > b) with each node's larger neighbours tied to the smallest of the node and its neighbours. The minima
    are combined before they are shuffled and joined back, so a node with very many edges makes no group."""
    least = stars.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "b")
    tied = stars.join(least.hint("merge"), "b", "left").select("a", F.coalesce("least", "b").alias("b"))
    return tied.distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """``stars`` (a > b) with each node and its smaller neighbours tied to the smallest of them."""
    least = stars.groupBy("a").agg(F.min("b").alias("least"))
    near = stars.join(least.hint("merge"), "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return near.union(least.select("a", F.col("least").alias("b"))).distinct()


def _verify(pairs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets overlap enough. Rows arrive ordered by b, whose set is made once for many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sets = Shingler(), OrderedDict()

        def known(i: int, text: str) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(text)
                if len(sets) > 64:
                    sets.popitem(last=False)
            return sets[i]

        for x in batches:
            keep = []
            for a, b, ta, tb in zip(x["a"].tolist(), x["b"].tolist(), x["text_a"], x["text_b"], strict=True):
                p, q = shingles(ta), known(b, tb)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    keep.append((a, b))
            yield pd.DataFrame(keep, columns=["a", "b"], dtype="int64")

    left = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInPandas(run, "a long, b long").distinct()


def _candidates(rest: DataFrame, percent: int, most: int | None, lots: int, block: int = 512) -> DataFrame:
    """Pairs of a bucket's members in different components that their sketches don't rule out: for each member its
    ``most`` likeliest, or all. ``rest`` has key, doc, component, print, bands and n, the bucket's number of members; large
    buckets are split into blocks, and each pair of blocks is a group of its own, while small ones are put together in
    ``lots`` groups. A pair that meets in several buckets is made in that of its first common band only."""
    j = percent / 100
    least = j - 4 * math.sqrt(j * (1 - j) / FINE)
    cut = math.ceil(FINE * least)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    rows = rest.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    rows = rows.withColumn("lot", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(lots))))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["key", "doc"])
        keys, docs, comps, part = (x[c].to_numpy() for c in ("key", "doc", "component", "part"))
        prints = np.frombuffer(b"".join(x["print"]), "u1").reshape(len(x), -1)
        marks = np.stack(x["bands"].to_numpy())
        p, q = int(x["p"].iat[0]), int(x["q"].iat[0])
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = int(np.flatnonzero(marks[a] == keys[a])[0])
            right = a + np.flatnonzero(part[a:b] == q)
            for i in (a + np.flatnonzero(part[a:b] == p)).tolist():
                js = right[(comps[right] != comps[i]) & ((docs[right] > docs[i]) | (p != q))]
                agree = (prints[js] == prints[i]).sum(axis=1)
                js, agree = js[agree >= cut], agree[agree >= cut]
                if not len(js):
                    continue
                first = ~(marks[js, :here] == marks[i, :here]).any(axis=1)
                js, agree = js[first], agree[first]
                if most is not None and len(js) > most:
                    js = js[np.argsort(-agree, kind="stable")[:most]]
                out.append(np.stack([np.maximum(docs[i], docs[js]), np.minimum(docs[i], docs[js])], axis=1))
        got = np.concatenate(out) if out else np.zeros((0, 2), "i8")
        return pd.DataFrame(got, columns=["a", "b"])

    return rows.groupBy("lot", F.col("parts") > 1, "p", "q").applyInPandas(run, "a long, b long").distinct()


def link(docs: DataFrame, percent: int = 85, likeliest: int = 4) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): n_shingles, component_id and kept."""
    docs = texts(docs)
    sk = materialize(sketches(docs), "sketches")
    classes = materialize(
        sk.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key", "bands").agg(F.min("doc_id").alias("doc")), "classes"
    )
    lots = max(16, classes.count() // 2000)
    spread = classes.select("doc", F.explode("bands").alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(spread.join(sizes.hint("merge"), "key"), "members")
    shared = members.groupBy("doc").agg(F.sum(F.log2("n")).alias("shared"))
    centre = members.join(shared, "doc").groupBy("key").agg(F.max(F.struct("shared", (-F.col("doc")).alias("minus"))).alias("best"))
    centre = centre.select("key", (-F.col("best.minus")).alias("b"))
    pairs = materialize(members.join(centre, "key").filter("doc != b").select(F.col("doc").alias("a"), "b").distinct(), "pairs")
    taking_part = members.select(F.col("doc").alias("doc_id")).distinct()
    wanted = materialize(docs.join(taking_part.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "wanted")
    links = materialize(_verify(pairs, wanted, percent), "links")
    labels, fine = components(links), None
    for most in (likeliest, None):
        rest = members.join(labels, members.doc == labels.node, "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
        mixed = rest.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
        rest = rest.join(mixed.hint("merge"), "key", "left_semi")
        if fine is None:
            apart = rest.select(F.col("doc").alias("doc_id")).distinct()
            fine = materialize(prints(wanted.join(apart.hint("merge"), "doc_id", "left_semi")), "prints")
        rest = rest.join(fine.hint("merge"), "doc").join(classes.select("doc", "bands").hint("merge"), "doc")
        more = materialize(_candidates(rest, percent, most, lots).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        found = materialize(_verify(more, wanted, percent), "links")
        pairs, links = pairs.union(more), links.union(found)
        if not found.isEmpty():
            labels = components(links)
    roots = classes.join(labels.hint("merge"), classes.doc == labels.node, "left").select("set_key", F.coalesce("component", "doc").alias("root"))
    out = sk.select("doc_id", "n_shingles", "set_key").join(roots.hint("merge"), "set_key", "left")
    component = F.coalesce("root", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates, that with the smallest doc_id."""
    gone = link(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
