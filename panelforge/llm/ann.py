"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes nearest Euclidean neighbour by one more coordinate,
``sqrt(R^2 - |x|^2)`` with R the largest norm (0 for a query).  Vectors are projected to DIMS coordinates
with a Gaussian (2-stable) matrix: for a vector at distance d, the squared projected distance over d^2
follows a chi-square law with DIMS degrees of freedom.

Index: the top of a kd-tree over the projected points, fitted on a bounded sample, deals every vector to
one cell; inside a cell a kd-tree has leaves of LEAF points.  Search: leaves are taken in order of
projected distance and their points verified with exact inner products in double precision, until the
next leaf is so far that a vector as near as the k-th one found would, by the chi-square law, be
projected closer with probability CONFIDENCE.  A query first searches its own cell, then, with the k-th
distance found there as start, only the cells that the test leaves open.

Equal vectors are one point with the K + 1 smallest ids (more can never be asked for), found in two
salted steps, so a very common vector is no hot key.

Defined results: vectors that are null, empty, of another length than most, zero, or hold null or non-finite
parts take no part; repeated ids count as separate rows; fewer candidates than K give all of them;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import staged, table

K = 20
DIMS = 8
LEAF = 32
CELL = 16_384  # points a cell aims at
SAMPLE = 32_768  # projected points on which the top of the tree is fitted
CONFIDENCE = 0.95
SEED = 20
QUERIES = 1024  # queries searched at a time


def chi2_cdf(x: np.ndarray, dof: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.asarray(x) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dof // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array(mid), dof) < p else (lo, mid)
    return hi


def projection(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def lift(x: np.ndarray, radius: float) -> np.ndarray:
    """One more coordinate, so that all points have the norm ``radius``."""
    rest = np.sqrt(np.maximum(radius * radius - (x * x).sum(1), 0))
    return np.concatenate((x, rest[:, None]), 1)


class Tree:
    """kd-tree by median cuts: leaves are (rows, box); cut on the widest side."""

    def __init__(self, y: np.ndarray, leaf: int):
        self.cuts: list[tuple] = []
        self.rows: list[np.ndarray] = []
        self.root = self._build(y, np.arange(len(y)), leaf)
        self.low = np.array([y[r].min(0) for r in self.rows]).reshape(len(self.rows), y.shape[1])
        self.high = np.array([y[r].max(0) for r in self.rows]).reshape(len(self.rows), y.shape[1])

    def _build(self, y, rows, leaf):
        side = int(np.ptp(y[rows], axis=0).argmax()) if len(rows) else 0
        if len(rows) <= leaf or np.ptp(y[rows, side]) <= 0:
            self.rows.append(rows)
            return -len(self.rows)
        v = y[rows, side]
        cut = float(np.median(v))
        left = v < cut
        if not left.any():
            left = v <= cut
        i = len(self.cuts)
        self.cuts.append(())
        self.cuts[i] = (side, cut if (v < cut).any() else np.nextafter(cut, np.inf), self._build(y, rows[left], leaf), self._build(y, rows[~left], leaf))
        return i

    def cell(self, y: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out = np.zeros(len(y), np.int64)
        todo = [(self.root, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            side, cut, a, b = self.cuts[node]
            left = y[rows, side] < cut
            todo += [(a, rows[left]), (b, rows[~left])]
        return out


def box_distance(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, one row a point."""
    out = np.zeros((len(y), len(low)))
    for j in range(y.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - y[:, j, None], y[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


def search(tree: Tree, x: np.ndarray, q: np.ndarray, yq: np.ndarray, bound: np.ndarray, radius: float, k: int, quantile: float):
    """For each query the rows of x found and their inner products; ``bound``: squared distance of the k-th found before."""
    gap = box_distance(yq, tree.low, tree.high)
    order = np.argsort(gap, 1, kind="stable")
    out = []
    for i in range(len(q)):
        norm = radius * radius + float(q[i] @ q[i])
        near, rows, scores, kth, n = bound[i], [], [], bound[i], 0
        step, at = 4, 0
        while at < order.shape[1] and gap[i, order[i, at]] <= quantile * kth:
            pick = order[i, at : at + step]
            pick = pick[gap[i, pick] <= quantile * kth]
            r = np.concatenate([tree.rows[p] for p in pick])
            s = x[r] @ q[i]
            rows.append(r)
            scores.append(s)
            n += len(r)
            at += step
            step = min(step * 2, 64)
            if n >= k:
                alls = np.concatenate(scores)
                kth = min(near, max(norm - 2 * float(np.partition(alls, len(alls) - k)[len(alls) - k]), 0.0))
        if rows:
            r, s = np.concatenate(rows), np.concatenate(scores)
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                r, s = r[keep], s[keep]
        else:
            r, s = np.zeros(0, np.int64), np.zeros(0)
        out.append((r, s))
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def nearest(vectors: DataFrame, is_query, k: int = K, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """vectors(vec_id, embedding, …) -> query_id, rank, vec_id, score: the k nearest found of every row with ``is_query``."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    v = v.where(F.forall("e", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).where(F.exists("e", lambda e: e != 0))
    norm = F.aggregate("e", F.lit(0.0), lambda a, e: a + e * e)
    sizes = v.groupBy(F.size("e").alias("n")).agg(F.count("*").alias("c"), F.max(norm).alias("r")).orderBy(F.desc("c"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, radius = sizes[0][0], float(np.sqrt(sizes[0][2])) * (1 + 1e-12)
    v = v.where(F.size("e") == dim)
    queries = v.where(is_query).select("vec_id", "e")

    # equal vectors: one point, its k + 1 smallest ids, picked in salted steps
    key = F.xxhash64("e"), F.hash("e")
    w1 = Window.partitionBy("h", "g", "s").orderBy("vec_id")
    part = v.select("vec_id", "e", key[0].alias("h"), key[1].alias("g"), F.pmod(F.hash("vec_id"), F.lit(64)).alias("s")).withColumn("rn", F.row_number().over(w1)).where(F.col("rn") <= k + 1)
    part = part.withColumn("s", F.col("s") % 8).withColumn("rn", F.row_number().over(w1)).where(F.col("rn") <= k + 1)
    points = staged(part.groupBy("h", "g").agg(F.first("e").alias("e"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")).select("e", "ids"))

    proj = projection(dim, DIMS, seed)
    count = points.count()
    cells = max(1, -(-count // CELL))
    sample = points.select("e").where(F.lit(count <= SAMPLE) | (F.pmod(F.xxhash64("e", F.lit(seed)), F.lit(1 << 20)) < int(SAMPLE / max(count, 1) * 0.9 * (1 << 20)))).limit(SAMPLE * 2)
    y = lift(np.array([r[0] for r in sample.collect()]).reshape(-1, dim), radius) @ proj
    top = Tree(y, max(1, -(-len(y) // cells)))
    quantile = chi2_quantile(confidence, DIMS)

    def deal(batches):
        for b in batches:
            e = matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.cell(lift(e, radius) @ proj).astype(np.int32))], [*b.schema.names, "cell"])

    placed = staged(points.mapInArrow(deal, "e array<double>, ids array<long>, cell int"))

    def deal_queries(batches):
        for b in batches:
            e = matrix(b.column(0))
            y = np.concatenate((e, np.zeros((len(e), 1))), 1) @ proj
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(box_distance(y, boxes[0], boxes[1]).argmin(1).astype(np.int32)), pa.array(np.full(len(e), np.inf))], [*b.schema.names, "cell", "bound"])

    # the boxes of the cells: one row a cell
    def extent(batches):
        for b in batches:
            y = lift(matrix(b.column(0)), radius) @ proj
            c = b.column(1).to_numpy()
            for j in np.unique(c):
                yield pa.RecordBatch.from_arrays([pa.array([int(j)], pa.int32()), *(pa.array([float(f(y[c == j, d]))]) for f in (np.min, np.max) for d in range(DIMS))], ["cell", *(f"{f}{d}" for f in ("lo", "hi") for d in range(DIMS))])

    names = [f"{f}{d}" for f in ("lo", "hi") for d in range(DIMS)]
    got = placed.select("e", "cell").mapInArrow(extent, "cell int, " + ", ".join(f"{n} double" for n in names)).groupBy("cell").agg(*((F.min if n[0] == "l" else F.max)(n).alias(n) for n in names)).collect()
    boxes = np.full((2, len(top.rows), DIMS), np.inf)
    for r in got:
        boxes[0, r[0]], boxes[1, r[0]] = r[1 : 1 + DIMS], r[1 + DIMS :]

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        """One cell: its points (left) and the queries that ask it (right)."""
        found = {"query_id": [], "vec_id": [], "score": []}
        kth = {"query_id": [], "q": [], "cell": [], "kth": []}
        if right.num_rows and left.num_rows:
            x, ids = matrix(left.column("e")), left.column("ids").to_pylist()
            tree = Tree(lift(x, radius) @ proj, LEAF)
            for a in range(0, right.num_rows, QUERIES):
                part = right.slice(a, QUERIES)
                q, own = matrix(part.column("e")), part.column("vec_id").to_pylist()
                yq = np.concatenate((q, np.zeros((len(q), 1))), 1) @ proj
                for i, (rows, scores) in enumerate(search(tree, x, q, yq, part.column("bound").to_numpy(), radius, k + 1, quantile)):
                    many = sorted((-s, v) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for v in ids[r] if v != own[i])[:k]
                    found["query_id"] += [own[i]] * len(many)
                    found["vec_id"] += [v for _, v in many]
                    found["score"] += [-s for s, _ in many]
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    result = "query_id long, vec_id long, score double"
    asked = staged(queries.select("e", "vec_id").mapInArrow(deal_queries, "e array<double>, vec_id long, cell int, bound double"))
    first = staged(placed.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(visit, result))
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))

    def open_cells(batches):
        for b in batches:
            e, home, n, worst = matrix(b.column(0)), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            y = np.concatenate((e, np.zeros((len(e), 1))), 1) @ proj
            bound = np.where(np.nan_to_num(n) >= k, np.maximum(radius * radius + (e * e).sum(1) - 2 * np.nan_to_num(worst), 0), np.inf)
            go = box_distance(y, boxes[0], boxes[1]) <= (quantile * bound)[:, None]
            go &= np.isfinite(boxes[0, :, 0])[None, :]
            go[np.arange(len(e)), home] = False
            i, c = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(c.astype(np.int32)), pa.array(bound[i])], ["e", "vec_id", "cell", "bound"])

    if len(top.rows) > 1:
        more = asked.select("e", "vec_id", "cell").join(reached, F.col("vec_id") == F.col("query_id"), "left").select("e", "vec_id", "cell", "n", "worst")
        more = more.mapInArrow(open_cells, "e array<double>, vec_id long, cell int, bound double")
        first = first.union(placed.groupBy("cell").cogroup(more.groupBy("cell")).applyInArrow(visit, result))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
