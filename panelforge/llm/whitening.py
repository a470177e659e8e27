"""Embedding whitening over a tiled covariance.

Vectors become integers, ``floor(256 c)``, and every distinct integer vector counts once (the fit list).  Its covariance is
built from tiles: the rows are cut into blocks, a block's columns into column blocks of TILE dimensions, which are shuffled by
row block; there every pair of column blocks (I <= J) is multiplied, a task adds its products of one tile before it sends them,
and the tiles are summed, assembled and decomposed.  Only sums of dims^2 numbers reach the driver.

Exactness: sums are integers; a column is centred before it is multiplied, by its rounded mean as an integer and then by the
rest of the mean, so a large mean costs no digits.  ``deviation`` is integer arithmetic.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, and neither do those of another
length than the most frequent one (the shorter of equally frequent ones stays).  Entries beyond the range of a long are its ends.
Repeated rows and ids are rows of their own.  ``deviation`` is null where it passes the range of a long.  Components whose
variance is zero (one distinct vector, equal columns) have ``whitened`` null and don't count for ``identity_error``; fewer
dimensions than ``components`` give fewer of them; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import discard, staged, table

TILE = 32  # dimensions of a column block
BLOCK = 1 << 18  # entries of a row block
HELD = 1 << 24  # entries of summed tiles that a task holds
COMPONENTS = 4
SCALE = 256

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    n: int
    sums: tuple[int, ...]
    centre: np.ndarray  # rounded means
    rest: np.ndarray  # means - centre
    axes: np.ndarray  # columns: unit eigenvectors by falling eigenvalue
    values: np.ndarray
    trace: float


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x array<long>: the valid vectors of the most frequent length."""
    v = vectors.select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("e")).where("e is not null and size(e) > 0")
    v = v.where(F.forall("e", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    lengths = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("e") == (lengths[0][0] if lengths else 0)).select("vec_id", F.transform("e", lambda e: F.floor(e * scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(batches):
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            wide = float(np.abs(x.astype(float)).max()) * len(x) >= 2.0**62
            s = (x.astype(object) if wide else x).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(s), dtype=np.int32)), pa.array([len(x), *(int(i) for i in s)], pa.decimal128(38, 0))], ["d", "s"])


def totals(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums by dimension."""
    got = {r[0]: int(r[1]) for r in fit.select("x").mapInArrow(_sums, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()}
    return got.get(-1, 0), tuple(got[d] for d in range(len(got) - 1))


def _centred(x: np.ndarray, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if np.abs(x.astype(float)).max(initial=0) < 2.0**61 and np.abs(centre.astype(float)).max(initial=0) < 2.0**61:
        return (x - centre.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - centre).astype(float) - rest


def covariance(fit: DataFrame, n: int, centre: np.ndarray, rest: np.ndarray, tile: int = TILE, block: int = BLOCK) -> np.ndarray:
    """Covariance (divisor n) of the vectors ``x`` about centre + rest, from tiles."""
    dims = len(centre)
    cuts = [(a, min(a + tile, dims)) for a in range(0, dims, tile)]
    height = max(1, block // dims)

    def cut(batches):
        turn, task = 0, TaskContext.get().partitionId()
        for b in batches:
            x = _matrix(b.column(0))
            for at in range(0, len(x), height):
                part = x[at : at + height]
                kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                cols = [part[:, a:z].astype(kind).tobytes() for a, z in cuts]
                many = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | turn] * many, pa.int64()), pa.array(range(many), pa.int32()), pa.array([np.dtype(kind).itemsize] * many, pa.int32()), pa.array(cols, pa.binary())],
                    ["row_block", "i", "width", "data"],
                )
                turn += 1

    def multiply(t: pa.Table) -> pa.Table:
        """One row block: products of all pairs of its column blocks."""
        kind = {2: np.int16, 4: np.int32, 8: np.int64}
        cols = {}
        for i, width, data in zip(t.column("i").to_pylist(), t.column("width").to_pylist(), t.column("data").to_pylist(), strict=True):
            a, z = cuts[i]
            cols[i] = _centred(np.frombuffer(data, kind[width]).reshape(-1, z - a).astype(np.int64), centre[a:z], rest[a:z])
        pairs = [(i, j) for i in sorted(cols) for j in sorted(cols) if i <= j]
        return pa.table({"i": pa.array([p[0] for p in pairs], pa.int32()), "j": pa.array([p[1] for p in pairs], pa.int32()), "tile": pa.array([(cols[i].T @ cols[j]).ravel() for i, j in pairs], pa.list_(pa.float64()))})

    def fold(batches):
        """Sums of a task by tile; sent when they fill the room."""
        held: dict[tuple[int, int], np.ndarray] = {}

        def send():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "j", "tile"])

        for b in batches:
            for i, j, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = values.values.to_numpy()
                held[i, j] = held[i, j] + v if (i, j) in held else v.copy()
            if len(held) * tile * tile > HELD:
                yield send()
                held.clear()
        if held:
            yield send()

    blocks = fit.select("x").mapInArrow(cut, "row_block long, i int, width int, data binary")
    products = blocks.groupBy("row_block").applyInArrow(multiply, "i int, j int, tile array<double>").mapInArrow(fold, "i int, j int, tile array<double>")
    entries = products.select("i", "j", F.posexplode("tile").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for i, j, cells in entries.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("cells")).toLocalIterator():
        (a, z), (b, y) = cuts[i], cuts[j]
        out[a:z, b:y] = np.array([c[1] for c in cells]).reshape(z - a, y - b)
        out[b:y, a:z] = out[a:z, b:y].T
    return out / n


def fit_model(fit: DataFrame, tile: int = TILE, block: int = BLOCK) -> Model | None:
    """fit(x): distinct integer vectors -> means, eigenvectors and eigenvalues; None without rows."""
    n, sums = totals(fit)
    if not n:
        return None
    centre = np.array([round(Fraction(s, n)) for s in sums], object)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre, strict=True)])
    v = covariance(fit, n, centre, rest, tile, block)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    values[values <= max(values[0], 0) * len(sums) * np.finfo(float).eps] = 0
    return Model(n, sums, centre, rest, axes, values, float(np.trace(v)))


def _project(x: np.ndarray, m: Model, many: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        w = _centred(x, m.centre, m.rest) @ m.axes[:, :many] / np.sqrt(m.values[:many])
    w[:, m.values[:many] <= 0] = np.nan
    return w


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    top = m.n * float(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in m.sums)
    if top * top * len(m.sums) < 2.0**62:
        return ((m.n * x - np.array(m.sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((m.n * x.astype(object) - np.array(m.sums, object)) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def identity_error(fit: DataFrame, m: Model, many: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    real = int((m.values[:many] > 0).sum())
    if not real:
        return None

    def moments(batches):
        for b in batches:
            if b.num_rows:
                w = _project(_matrix(b.column(0)), m, real)
                mean = w.mean(0)
                d = w - mean
                yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), pa.array([mean * len(w)], pa.list_(pa.float64())), pa.array([(d.T @ d + len(w) * np.outer(mean, mean)).ravel()], pa.list_(pa.float64()))], ["n", "s", "c"])

    got = fit.select("x").mapInArrow(moments, "n long, s array<double>, c array<double>")
    total = got.agg(F.sum("n"), *(F.sum(F.get("s", F.lit(k))) for k in range(real)), *(F.sum(F.get("c", F.lit(k))) for k in range(real * real))).first()
    mean = np.array(total[1 : 1 + real]) / total[0]
    cov = np.array(total[1 + real :]).reshape(real, real) / total[0] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(real)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> one row for each valid row and component; see the module's docstring."""
    rows = integers(vectors)
    fit = staged(rows.select("x").distinct())
    m = fit_model(fit, tile, block)
    if m is None:
        discard(fit)
        return vectors.sparkSession.createDataFrame([], _OUT)
    many = min(components, len(m.sums))
    off = identity_error(fit, m, many)
    discard(fit)
    explained = m.values[:many] / m.trace if m.trace > 0 else np.zeros(many)

    def out(batches):
        for b in batches:
            k = b.num_rows
            if k:
                x = _matrix(b.column(1))
                ids = b.column(0).take(pa.array(np.repeat(np.arange(k), many)))
                dev = pa.array(_deviation(x, m), pa.int64()).take(pa.array(np.repeat(np.arange(k), many)))
                comp = pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), k))
                size = k * many
                yield pa.RecordBatch.from_arrays(
                    [ids, comp, pa.array(np.full(size, m.n)), dev, pa.array(_project(x, m, many).ravel(), from_pandas=True), pa.array(np.tile(explained, k)), pa.array([off] * size, pa.float64())],
                    [c.split()[0] for c in _OUT.split(", ")],
                )

    return rows.mapInArrow(out, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
