"""Approximate nearest neighbours: stable projections under a kd-tree, with a chi-square stopping test."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.repeats import Scratch

#: Projected dimensions, probability that the stopping test keeps a true neighbour, points in a leaf.
DIMENSIONS, KEEP, LEAF = 32, 0.92, 64
#: Vectors in a cell, about; most cells; vectors of the sample for each cell that the cells are cut by.
CELL, CELLS, SAMPLE = 4096, 1 << 14, 32


def chi_square_bound(m: int, p: float) -> float:
    """The quantile of the chi-square distribution with an even number m of degrees of freedom."""

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projection(size: int, m: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, m))


class Tree:
    """A kd-tree: nodes are numbered from the root, 0, and split at the median of their widest axis down to `leaf`
    points, or to `depth` levels. `low` and `high` bound the space that a node stands for: the box of its points, or,
    for points that aren't there yet (`cells`), all that the cuts above it leave."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, depth: int = 64, cells: bool = False):
        n, m = points.shape
        self.order = np.arange(n)
        self.children: list[tuple[int, int] | None] = []
        self.cut: list[tuple[int, float]] = []
        self.range: list[tuple[int, int]] = []
        low, high = [], []

        def add(a, b, lo, hi):
            self.children.append(None)
            self.cut.append((0, 0.0))
            self.range.append((a, b))
            if not cells and b > a:
                own = points[self.order[a:b]]
                lo, hi = own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            return len(low) - 1

        level = [add(0, n, np.full(m, -np.inf), np.full(m, np.inf))]
        for _ in range(depth):
            below = []
            for node in level:
                a, b = self.range[node]
                if b - a <= leaf:
                    continue
                own = points[self.order[a:b]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                middle = (b - a) // 2
                part = np.argpartition(own[:, axis], middle)
                self.order[a:b] = self.order[a:b][part]
                at = float(own[part[middle], axis])
                left_high, right_low = high[node].copy(), low[node].copy()
                left_high[axis] = right_low[axis] = at
                self.cut[node] = axis, at
                self.children[node] = add(a, a + middle, low[node], left_high), add(a + middle, b, right_low, high[node])
                below += self.children[node]
            level = below
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from q to the nodes."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def leaves(self) -> np.ndarray:
        return np.array([i for i, c in enumerate(self.children) if c is None])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        live = [(0, np.arange(len(points)))]
        while live:
            node, own = live.pop()
            if (children := self.children[node]) is None or not len(own):
                out[own] = node
                continue
            axis, at = self.cut[node]
            right = points[own, axis] >= at
            live += [(children[0], own[~right]), (children[1], own[right])]
        return out


class Searcher:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = DIMENSIONS, keep: float = KEEP, seed: int = 5):
        self.projection = projection(vectors.shape[1], m, seed)
        self.tree = Tree(vectors @ self.projection)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]
        self.bound = chi_square_bound(m, keep)

    def nearest(self, query_id: int, q: np.ndarray, k: int, kth: float = math.inf):
        """Ids and squared distances of the k nearest found, nearest first, and how many vectors were verified. `kth`
        is the k-th best squared distance that is known already.

        Nodes and points come from one queue in the order of their projected distance, the nearest first. The squared
        distance of a projected point, over its squared distance, has a chi-square distribution: beyond `bound` times
        the k-th best square a point would be nearer with probability 1 - keep at most, and the search stops.
        """
        projected = q @ self.projection
        distance = self.tree.distances(projected)
        nodes = [(float(distance[0]), 0)]
        ready_at, ready = np.zeros(0, np.int64), np.zeros(0)  # points of opened leaves, by projected distance
        ids, squares, verified, step = np.zeros(0, np.int64), np.zeros(0), 0, k
        while True:
            opened = []
            while nodes and nodes[0][0] <= self.bound * kth and (not len(ready) or nodes[0][0] < ready[0]):
                _, node = heapq.heappop(nodes)
                if children := self.tree.children[node]:
                    for child in children:
                        heapq.heappush(nodes, (float(distance[child]), child))
                else:
                    opened.append(np.arange(*self.tree.range[node]))
            if opened:
                new = np.concatenate(opened)
                gap = self.tree.points[new] - projected
                ready_at, ready = np.concatenate([ready_at, new]), np.concatenate([ready, np.einsum("ij,ij->i", gap, gap)])
                order = np.argsort(ready, kind="stable")
                ready_at, ready = ready_at[order], ready[order]
                continue
            limit = min(self.bound * kth, nodes[0][0] if nodes else math.inf)
            n = min(step, int(np.searchsorted(ready, limit, "right")))
            if not n:
                best = np.lexsort((ids, squares))[:k]
                return ids[best], squares[best], verified
            at, ready_at, ready, step = ready_at[:n], ready_at[n:], ready[n:], min(2 * step, 256)
            verified += n
            at = at[self.ids[at] != query_id]
            gap = self.vectors[at] - q
            ids = np.concatenate([ids, self.ids[at]])
            squares = np.concatenate([squares, np.einsum("ij,ij->i", gap, gap)])
            if len(ids) >= k:
                best = np.lexsort((ids, squares))[:k]
                ids, squares = ids[best], squares[best]
                kth = min(kth, float(squares[-1]))


class Cells:
    """The upper levels of the tree, for vectors of each length: the cell of a vector, and the cells near one."""

    def __init__(self, samples: dict[int, np.ndarray], n_cells: dict[int, int]):
        self.trees = {}
        for size, sample in samples.items():
            depth = max(0, math.ceil(math.log2(n_cells[size])))
            self.trees[size] = Tree(sample @ projection(size), 1, depth, cells=True)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.trees[x.shape[1]].leaf_of(x @ projection(x.shape[1]))

    def near(self, q: np.ndarray, limit: float) -> np.ndarray:
        """The cells within that squared distance of the projected q."""
        tree = self.trees[len(q)]
        leaves = tree.leaves()
        return leaves[tree.distances(q @ projection(len(q)))[leaves] <= limit]


def stretches(batch: pa.RecordBatch, keys: list[str], column: str):
    """(key, first row, end, vectors) of each stretch of equal keys; keys[0] is the length of their vectors."""
    if not batch.num_rows:
        return
    values = [batch.column(k).to_numpy() for k in keys]
    flat = batch.column(column).flatten().to_numpy()
    at = np.concatenate([[0], np.cumsum(values[0])])
    new = np.flatnonzero(np.logical_or.reduce([np.diff(v, prepend=v[0] - 1) != 0 for v in values]))
    for a, b in zip(new.tolist(), np.append(new[1:], batch.num_rows).tolist()):
        yield tuple(int(v[a]) for v in values), a, b, flat[at[a] : at[b]].reshape(b - a, -1)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*values, np.zeros(0)]).astype(kind.to_pandas_dtype()), kind))


FOUND = "query_id long, q long, size int, cell long, embedding array<double>, ids array<long>, squares array<double>, verified long"


def searched(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND for each row of asked(query_id, q, size, cell, embedding, kth): what is found in its cell. The points of a
    cell are held, its queries stream by."""
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = points.select("size", "cell", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding", nothing("long").alias("q"), nothing("double").alias("kth"))
    rows = rows.unionByName(asked.select("size", "cell", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "embedding", "q", "kth"))
    rows = rows.repartition("size", "cell").sortWithinPartitions("size", "cell", "kind")

    def run(batches):
        key, held, searcher = None, [], None
        for batch in batches:
            for (size, cell, kind), a, b, x in stretches(batch, ["size", "cell", "kind"], "embedding"):
                if key != (size, cell):
                    key, held, searcher = (size, cell), [], None
                ids = batch.column("id").slice(a, b - a)
                if kind == 0:
                    held.append((ids.to_numpy(), x))
                    continue
                if searcher is None and held:
                    searcher = Searcher(*(np.concatenate(y) for y in zip(*held)))
                    held = [()]
                none = np.zeros(0, np.int64), np.zeros(0), 0
                known = batch.column("kth").slice(a, b - a).to_pylist()
                found = [
                    searcher.nearest(i, y, k, kth) if searcher else none for i, y, kth in zip(ids.to_pylist(), x, known)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, batch.column("q").slice(a, b - a), batch.column("size").slice(a, b - a),
                        batch.column("cell").slice(a, b - a), lists(list(x), pa.float64()),
                        lists([f[0] for f in found], pa.int64()), lists([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.int64()),
                    ],
                    ["query_id", "q", "size", "cell", "embedding", "ids", "squares", "verified"],
                )

    return rows.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Of vectors(vec_id, embedding): for each row whose vec_id is divisible by `every` its k nearest other rows by
    Euclidean distance: query_id, rank (from 1), vec_id, score, verified (how many vectors were measured for the
    query). Ties go to the smaller vec_id.

    Vectors are projected, and the upper levels of a kd-tree over the projections, cut by a bounded sample, deal all of
    them to cells of about CELL; each cell has a tree of its own. A query is searched in its own cell first, and then
    only in those that the stopping test can't rule out, given the k-th best distance so far. Repeated rows go first;
    of equal vectors the k + 1 with the least ids are kept, which is decided before the shuffle, so that no result is
    lost and no group of copies is gathered. At most CELLS cells are made; beyond that they grow.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without a vec_id;
    vectors of another length than the query's aren't candidates. A query with fewer candidates gets all of them.
    Rows that share a query's vec_id aren't its candidates; repeated rows count once, and different vectors that share
    a vec_id are queries and candidates of their own. An empty table gives an empty table; other columns are not read.
    """
    spark, scratch, x = vectors.sparkSession, Scratch(vectors.sparkSession), F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("size", F.size("embedding"))
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    n_cells = {size: min(CELLS, max(1, -(-n // CELL))) for size, n in counts.items()}
    samples = {}
    for size, n in counts.items():
        sample = rows.where(F.col("size") == size).select("embedding", F.xxhash64("vec_id", "embedding").alias("h"))
        sample = sample.orderBy("h").limit(SAMPLE * n_cells[size]) if n_cells[size] > 1 else sample.limit(1)
        samples[size] = np.array([r.embedding for r in sample.select("embedding").toLocalIterator()], float)
    shared = spark.sparkContext.broadcast(Cells(samples, n_cells))

    def deal(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for _, a, b, own in stretches(batch, ["size"], "embedding"):
                cell[a:b] = shared.value.of(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def route(batches):
        bound = chi_square_bound(DIMENSIONS, KEEP)
        for batch in batches:
            kth, own, out = batch.column("kth").to_pylist(), batch.column("cell").to_pylist(), []
            for _, a, b, x in stretches(batch, ["size"], "embedding"):
                for i in range(a, b):
                    near = shared.value.near(x[i - a], bound * kth[i])
                    out.append(near[near != own[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(out, pa.int64())], [*batch.schema.names, "cells"])

    distinct = rows.dropDuplicates(["vec_id", "embedding"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    points = distinct.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    points = points.mapInArrow(deal, "vec_id long, embedding array<double>, size int, cell long")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    queries = queries.mapInArrow(deal, "vec_id long, embedding array<double>, size int, cell long")
    queries = queries.select(
        F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q"), "size", "cell", "embedding", F.lit(float("inf")).alias("kth")
    )
    found = scratch.write(searched(points, queries, k))
    kth = F.when(F.size("squares") >= k, F.element_at("squares", -1)).otherwise(F.lit(float("inf")))
    further = found.select("query_id", "q", "size", "cell", "embedding", kth.alias("kth"))
    further = further.mapInArrow(route, "query_id long, q long, size int, cell long, embedding array<double>, kth double, cells array<long>")
    further = further.withColumn("cell", F.explode("cells")).drop("cells")
    if max(n_cells.values(), default=1) > 1:
        found = scratch.write(found.unionByName(searched(points, further, k)))
        scratch.clear(found)
    each = found.select("query_id", "q", F.explode(F.arrays_zip("ids", "squares")).alias("f"))
    best = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    each = each.select("query_id", "q", F.col("f.ids").alias("vec_id"), F.sqrt("f.squares").alias("score"))
    each = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    total = found.groupBy("query_id", "q").agg(F.sum("verified").alias("verified"))
    return each.join(total, ["query_id", "q"]).select("query_id", "rank", "vec_id", "score", "verified")
