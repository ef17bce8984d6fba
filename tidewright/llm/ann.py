"""Approximate nearest neighbours: stable projections to a few dimensions, kd-trees, and a chi-square stopping test.

Vectors of unit length are projected by normal random directions. The square of a projected distance divided by that of
the true one then follows a chi-square distribution with as many degrees of freedom as there are directions. Directions at
right angles keep its mean and narrow its spread, so that the test errs towards going on. A search walks
a kd-tree over the projected points and takes them by growing projected distance, each with its vector verified; once the
next one is so far, in projection, that a vector nearer than the k-th best verified one would have come before with
probability ``stop``, it ends.

The projected points are dealt into cells by the splits of a kd-tree that is fitted on at most ``sample_rows`` of them;
all rows are indexed. There are at most 4096 cells, so their boxes are small whatever the input's size; a cell with more
than ``shard_rows`` rows, whether dense or of copies, is several shards by a hash of vec_id. A query is searched in its
own cell first. Its k-th best distance there and the boxes of the other cells, by the same test, say which of these it
visits too, where the search begins with that distance as its bound.

Rows come to a task ordered by shard, indexed rows first, so a task holds one shard and a batch of queries. Of equal
vectors a shard keeps the ``k + 1`` smallest ids, as no others can be among the nearest. Vectors that are null, zero,
empty or hold null or non-finite components take no part; vectors of different lengths aren't compared; rows with a null
vec_id are left out. Ties go to the smaller vec_id. Of rows that repeat a vec_id, one with the smallest components counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FOUND = "query_id long, vec_id long, score double, verified long"
#: A bound on the table of cells.
MOST_CELLS = 4096


def usable(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def chi_square(x: float, m: int) -> float:
    """The chi-square distribution function for an even number ``m`` of degrees of freedom."""
    if x <= 0:
        return 0.0
    if x > 1400:
        return 1.0
    term = total = math.exp(-x / 2)
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - total


def chi_square_place(p: float, m: int) -> float:
    """Where ``chi_square`` reaches ``p``, by halving: the test then is a comparison of squares."""
    low, high = 0.0, 1400.0
    for _ in range(60):
        half = (low + high) / 2
        low, high = (half, high) if chi_square(half, m) < p else (low, half)
    return high


def lines(dim: int, dims: int, seed: int) -> np.ndarray:
    """The random directions, the same wherever they are made: normal ones, set at right angles where there is room."""
    normal = np.random.default_rng([seed, dim]).standard_normal((dim, dims))
    return np.linalg.qr(normal)[0] * math.sqrt(dim) if dim >= dims else normal


def projected(matrix: np.ndarray, dims: int, seed: int) -> np.ndarray:
    # summed row by row in one order, so that a point is the same in whatever batch it comes
    unit = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    return np.stack([(unit * line).sum(axis=1) for line in lines(matrix.shape[1], dims, seed).T], axis=1)


class KdTree:
    """A kd-tree, split at the median of the widest side; every node has the box of its points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        if len(points):
            self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]

    def _grow(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        part = points[self.order[a:b]]
        me = len(self.spans)
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.spans.append((a, b))
        self.children.append(None)
        widths = self.high[me] - self.low[me]
        if b - a > leaf and widths.any():
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, int(widths.argmax())], half)]
            self.children[me] = (self._grow(points, a, a + half, leaf), self._grow(points, a + half, b, leaf))
        return me

    def square(self, node: int, point: np.ndarray) -> float:
        """The square of the distance from ``point`` to a node's box."""
        off = np.maximum(np.maximum(self.low[node] - point, point - self.high[node]), 0)
        return float(off @ off)

    def nearest(self, point: np.ndarray, at_once: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All points by growing distance, some at a time: their numbers and the squares of their distances. A queue holds
        the nodes not opened yet; points of opened leaves wait until no such node is nearer."""
        queue = [(self.square(0, point), 0)] if self.spans else []
        rows, squares = np.zeros(0, "i8"), np.zeros(0)
        while queue or len(rows):
            new_rows, new_squares = [rows], [squares]
            while queue and len(new_rows) <= at_once:
                _, node = heapq.heappop(queue)
                if self.children[node] is not None:
                    for child in self.children[node]:
                        heapq.heappush(queue, (self.square(child, point), child))
                    continue
                a, b = self.spans[node]
                off = self.points[a:b] - point
                new_rows.append(self.order[a:b])
                new_squares.append(np.einsum("ij,ij->i", off, off))
            rows, squares = np.concatenate(new_rows), np.concatenate(new_squares)
            near = squares <= (queue[0][0] if queue else math.inf)
            if near.any():
                by = np.argsort(squares[near], kind="stable")
                yield rows[near][by], squares[near][by]
                rows, squares = rows[~near], squares[~near]


class Shard:
    """Some vectors in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, dims: int, stop: float, leaf: int, seed: int):
        by = np.argsort(ids, kind="stable")
        ids, vectors = ids[by], vectors[by]
        _, group = np.unique(vectors, axis=0, return_inverse=True)
        rank = pd.Series(group.ravel()).groupby(group.ravel()).cumcount().to_numpy()
        self.ids, self.vectors = ids[rank <= k], vectors[rank <= k]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.k, self.place = k, chi_square_place(stop, dims)
        self.tree = KdTree(projected(self.vectors, dims, seed), leaf)

    def nearest(self, own: int, vector: np.ndarray, point: np.ndarray, bound: float, batch: int = 128) -> tuple[list[tuple[int, float]], int]:
        """The ``k`` nearest found, best first, and how many vectors were verified. ``bound`` is a score that ``k`` vectors
        elsewhere reach, or NaN."""
        norm = math.sqrt(float((vector * vector).sum()))
        ids, scores, seen = np.zeros(0, "i8"), np.zeros(0), 0
        for rows, squares in self.tree.nearest(point):
            for at in range(0, len(rows), batch):
                kth = scores[-1] if len(ids) == self.k else math.nan
                worst = np.fmax(kth, bound)
                reach = math.inf if math.isnan(worst) else self.place * max(2 - 2 * float(worst), 1e-12)
                some = rows[at : at + batch][squares[at : at + batch] <= reach]
                if not len(some):
                    return list(zip(ids.tolist(), scores.tolist(), strict=True)), seen
                some = some[self.ids[some] != own]
                seen += len(some)
                # einsum adds up each row by itself, so equal vectors get equal scores
                found = np.einsum("ij,j->i", self.vectors[some], vector) / (self.norms[some] * norm)
                ids, scores = np.concatenate([ids, self.ids[some]]), np.concatenate([scores, found])
                best = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[best], scores[best]
        return list(zip(ids.tolist(), scores.tolist(), strict=True)), seen


class Cells:
    """The splits that deal projected points into cells: a complete kd-tree of ``depth`` levels, fitted on ``sample``."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(1 << depth, "i8"), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = int(part.var(axis=0).argmax())
                self.value[node] = float(np.median(part[:, self.axis[node]]))
            right = part[:, self.axis[node]] > self.value[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), "i8")
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)


class Plan:
    """Which shards a vector is put into and which a query visits. Shards of vectors of another length than ``dim`` come
    after those of the cells; they have no boxes and every query of another length visits them."""

    def __init__(self, dim: int, cells: Cells, boxes: list, others: int, shard_rows: int, place: float):
        self.dim, self.cells, self.place = dim, cells, place
        self.parts = np.zeros(1 << cells.depth, "i8")
        self.low = np.full((1 << cells.depth, len(boxes[0][2]) if boxes else 1), math.inf)
        self.high = -self.low
        for cell, n, low, high in boxes:
            self.parts[cell], self.low[cell], self.high[cell] = math.ceil(n / shard_rows), low, high
        self.base = np.cumsum(self.parts) - self.parts
        self.total = int(self.parts.sum())
        self.others = math.ceil(others / shard_rows)

    def put(self, dim: np.ndarray, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        in_cell = self.base[cell] + salt % np.maximum(self.parts[cell], 1)
        return np.where(dim == self.dim, in_cell, self.total + salt % max(self.others, 1)).astype("i4")

    def visit(self, dim: int, cell: int, point: np.ndarray, bound: float, first: bool) -> np.ndarray:
        """Shards of the query's own cell (``first``), or of the others that may hold a vector nearer than ``bound``."""
        if dim != self.dim:
            return np.arange(self.total, self.total + self.others if first else self.total, dtype="i4")
        if first:
            which = [cell]
        else:
            off = np.maximum(np.maximum(self.low - point, point - self.high), 0)
            reach = math.inf if math.isnan(bound) else self.place * max(2 - 2 * bound, 1e-12)
            near = ((off * off).sum(axis=1) <= reach) & (self.parts > 0)
            near[cell] = False
            which = np.flatnonzero(near).tolist()
        return np.concatenate([np.arange(self.base[c], self.base[c] + self.parts[c]) for c in which] or [np.zeros(0)]).astype("i4")


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, dims: int = 32, stop: float = 0.8, shard_rows: int = 16_000, leaf: int = 128, seed: int = 7,
    sample_rows: int = 20_000,
) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds, its ``k`` nearest others by cosine; with
    each query stands how many vectors were verified for it. ``dims`` is even."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    @F.pandas_udf("array<double>")
    def project(embedding: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(embedding), dtype=object)
        for _, at in out.groupby(embedding.map(len).to_numpy()).indices.items():
            for i, point in zip(at.tolist(), projected(np.stack(embedding.iloc[at].to_numpy()), dims, seed), strict=True):
                out.iat[i] = point
        return out

    rows = rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("vec_id").alias("salt"), is_query.alias("asks"))
    rows = materialize(rows.withColumn("point", project("embedding")), "vectors")
    # the sample is of the rows whose hashes are smallest: bounded, and the same whenever it is taken
    sample = rows.select("dim", "point", "salt").orderBy("salt").limit(sample_rows).toPandas()
    dim = int(sample["dim"].mode().iat[0]) if len(sample) else 0
    held = rows.filter(F.col("dim") == dim)
    depth = max(0, min(int(math.log2(MOST_CELLS)), math.ceil(math.log2(max(1, held.count() / shard_rows)))))
    mine = sample["point"][sample["dim"] == dim]
    cells = Cells(np.stack(mine.to_numpy()) if len(mine) else np.zeros((0, dims)), depth)

    @F.pandas_udf("int")
    def cell_of(size: pd.Series, point: pd.Series) -> pd.Series:
        found = cells.of(np.stack(point.to_numpy())) if len(point) else np.zeros(0, "i8")
        return pd.Series(np.where(size == dim, found, 0).astype("i4"))

    rows = rows.withColumn("cell", cell_of("dim", "point"))
    edge = [f(F.get("point", F.lit(j))) for f in (F.min, F.max) for j in range(dims)]
    # at most MOST_CELLS rows of two numbers for each direction
    boxes = rows.filter(F.col("dim") == dim).groupBy("cell").agg(F.count("*"), *edge).collect()
    plan = Plan(
        dim, cells, [(r[0], r[1], np.array(r[2 : 2 + dims]), np.array(r[2 + dims :])) for r in boxes], rows.filter(F.col("dim") != dim).count(),
        shard_rows, chi_square_place(stop, dims),
    )
    shards = max(1, plan.total + plan.others)

    @F.pandas_udf("int")
    def put(size: pd.Series, cell: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(plan.put(size.to_numpy(), cell.to_numpy(), salt.to_numpy()))

    def visits(first: bool):
        def shards_of(size: pd.Series, cell: pd.Series, point: pd.Series, bound: pd.Series) -> pd.Series:
            return pd.Series([plan.visit(*row, first) for row in zip(size.tolist(), cell.tolist(), point, bound.tolist(), strict=True)], dtype=object)

        return F.explode(F.pandas_udf(shards_of, "array<int>")("dim", "cell", "point", "bound"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, shard = None, None
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        for b in batches:
            for this, part in b.groupby(["shard", "dim", "asking"], sort=True):
                if this[:2] != key:
                    key, shard, ids, data = this[:2], None, [], []
                matrix = np.stack(part["embedding"].to_numpy()).astype("f8")
                if not this[2]:
                    ids.append(part["vec_id"].to_numpy())
                    data.append(matrix)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(data), k, dims, stop, leaf, seed)
                    ids, data = [], []
                if shard is None:
                    continue
                out = []
                for q, v, point, bound in zip(part["vec_id"].tolist(), matrix, part["point"], part["bound"].tolist(), strict=True):
                    found, seen = shard.nearest(q, v, point, bound)
                    out += [(q, x, s, seen if i == 0 else 0) for i, (x, s) in enumerate(found)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])

    columns = ["shard", "asking", "dim", "vec_id", "embedding", "point", "bound"]
    asks = rows.filter("asks")
    indexed = rows.select(put("dim", "cell", "salt").alias("shard"), F.lit(0).alias("asking"), "dim", "vec_id", "embedding", F.lit(None).cast("array<double>").alias("point"), F.lit(None).cast("double").alias("bound"))

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        ask = asked.withColumn("shard", visits(first)).withColumn("asking", F.lit(1)).select(*columns)
        both = indexed.unionByName(ask).repartitionByRange(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "asking", "vec_id")
        return both.mapInPandas(run, FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialize(searched(asks.withColumn("bound", F.lit(None).cast("double")), True), "near")
    bound = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    found = near.unionByName(searched(asks.join(bound.hint("merge"), "vec_id", "left"), False))
    found = materialize(found, "found")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    effort = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return ranked.drop("verified").join(effort, "query_id").select("query_id", "rank", "vec_id", "score", "verified")
