"""Ranked boosted trees: LambdaRank over dates, histogram trees grown level by level, many models at once.

Rows are binned once (edges are quantile sketches of a model's features) and packed: one row a (model, date), since a ranking gradient
needs the date whole.  A level of all models' current trees is one job: each packed date computes its scores, gradients and
node of every row, tasks add up (model, node, feature, bin) sums, Spark sums them over tasks, and windows over the bins find each node's best
split; only the splits reach the driver.  Its memory is the forest, models * trees * nodes.

Gradients are those of LambdaRank: for two rows of a date with different grades, of which one is among the ``top`` by score, the pair's
logistic gradient times the change of the discounted gain that a swap would make, relative to the best possible gain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    rate: float = 0.05
    depth: int = 3  # so eight leaves at most
    least: int = 40  # rows of a leaf
    ridge: float = 2.0
    bins: int = 32
    top: int = 50
    group: int | None = None  # where given, rows of a date that a model learns from at most (a sample: the outer grades first); else all
    grades: int = 5
    accuracy: int = 10_000  # of the quantile sketch


@dataclass
class Forest:
    """Trees of one model: a node is (feature, bin) and its children 2i + 1 and 2i + 2; feature -1 is a leaf."""

    edges: list[list[float]]
    trees: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    leaves: list[dict[int, float]] = field(default_factory=list)


def place(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """Node of every row of a (partly grown) tree; a row goes left if its bin is at most the split's."""
    node = np.zeros(len(bins), np.int64)
    for i in sorted(splits):
        feature, cut = splits[i]
        at = node == i
        node[at] = 2 * i + 1 + (bins[at, feature] > cut)
    return node


def scores(bins: np.ndarray, forest: Forest) -> np.ndarray:
    out = np.zeros(len(bins))
    for splits, leaves in zip(forest.trees, forest.leaves, strict=True):
        nodes = place(bins, splits)
        for leaf, value in leaves.items():
            out[nodes == leaf] += value
    return out


def gradients(score: np.ndarray, grade: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the pairwise ranking loss of one date; equal scores keep the order of rows."""
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    order = np.argsort(-score, kind="stable")
    s, y = score[order], grade[order]
    gain, discount = 2.0**y - 1, 1 / np.log2(np.arange(2, n + 2))
    best = (np.sort(gain)[::-1][:top] * discount[:top]).sum()
    if best <= 0:
        return g, h
    head = min(top, n)
    flat = s[0] == s[-1]

    def pairs(i, j):
        """(pull, curve) of rows i with rows j after them but for the difference of discounts; a pull is negative where i has the higher grade."""
        above = np.where(y[i] > y[j], 1.0, -1.0)
        diff, change = above * (s[i] - s[j]), above * (gain[i] - gain[j]) / best
        if not flat:
            change = change / (0.01 + np.abs(diff))
        p = 1 / (1 + np.exp(np.clip(diff, -60, 60)))
        return -above * p * change, p * (1 - p) * change

    gs, hs = np.zeros(n), np.zeros(n)
    i, j = np.triu_indices(head, 1)
    pull, curve = (v * (discount[i] - discount[j]) for v in pairs(i, j))
    gs[:head] = np.bincount(i, pull, head) - np.bincount(j, pull, head)
    hs[:head] = np.bincount(i, curve, head) + np.bincount(j, curve, head)
    total = 2 * np.abs(pull).sum()
    if n > head:
        # below the head only score and grade count, but for the discount: equal rows are one class, so the work is head * classes, and its memory is bounded
        level = np.cumsum(np.append(False, s[head + 1 :] != s[head:-1]))
        low = y.min()
        _, first, kind = np.unique(level * (int(y.max() - low) + 1) + (y[head:] - low), return_index=True, return_inverse=True)
        below, many, sums = head + first, np.bincount(kind), np.bincount(kind, discount[head:])
        part, step = np.zeros((4, len(first))), max(1, 2**18 // len(first))
        for k in range(0, head, step):
            i = np.arange(k, min(k + step, head))
            pull, curve = pairs(i[:, None], below[None, :])
            apart = discount[i][:, None] * many - sums
            gs[i] += (pull * apart).sum(1)
            hs[i] += (curve * apart).sum(1)
            total += 2 * (np.abs(pull) * apart).sum()
            part += pull.sum(0), discount[i] @ pull, curve.sum(0), discount[i] @ curve
        p, pd, c, cd = part[:, kind]
        gs[head:] = p * discount[head:] - pd
        hs[head:] = cd - c * discount[head:]
    if total > 0:
        scale = np.log2(1 + total) / total
        gs, hs = gs * scale, hs * scale
    g[order], h[order] = gs, hs
    return g, h


def learn_rows(panel: DataFrame, features: list[str], label: str, s: Settings) -> DataFrame:
    """panel(model, t, symbol, features, label) -> (model, t, symbol, x, grade): whole rows, grades by rank of the label within (model, t)."""
    rows = panel.dropna(subset=[*features, label])
    day = Window.partitionBy("model", "t")
    rank = F.row_number().over(day.orderBy(label, "symbol")) - 1
    rows = rows.withColumn("n", F.count("*").over(day)).where("n >= 8").withColumn("grade", F.floor(rank * s.grades / F.col("n")).cast("int"))
    if s.group is not None:
        outer = F.when(F.col("grade").isin(0, s.grades - 1), 0).otherwise(1)
        rows = rows.withColumn("k", F.row_number().over(day.orderBy(outer, F.xxhash64("symbol", "t"), "symbol"))).where(F.col("k") <= s.group)
    return rows.select("model", "t", "symbol", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), "grade")


def edges(rows: DataFrame, width: int, s: Settings) -> dict[int, list[list[float]]]:
    """Upper edges of the bins of each model and feature, from quantile sketches: models * features * bins numbers."""
    cut = F.array(*(F.lit(k / s.bins) for k in range(1, s.bins)))
    got = rows.groupBy("model").agg(*(F.percentile_approx(F.get("x", F.lit(i)), cut, s.accuracy).alias(f"q{i}") for i in range(width))).collect()
    return {r[0]: [sorted(set(r[1 + i])) for i in range(width)] for r in got}


def pack(rows: DataFrame, cuts: dict[int, list[list[float]]]) -> DataFrame:
    """One row a (model, t): the bins of its rows in the order of symbols, row by row, and their grades."""

    def binned(batches):
        for b in batches:
            models, x = np.asarray(b.column(0)), np.asarray(b.column(3).flatten()).reshape(b.num_rows, -1)
            bins = np.zeros(x.shape, np.uint8)
            for m in np.unique(models):
                at = models == m
                for f, e in enumerate(cuts[m]):
                    bins[at, f] = np.searchsorted(e, x[at, f])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([bytes(row) for row in bins], pa.binary()), b.column(4)], ["model", "t", "symbol", "bins", "grade"])

    kinds = dict(rows.dtypes)
    small = rows.mapInArrow(binned, f"model {kinds['model']}, t {kinds['t']}, symbol {kinds['symbol']}, bins binary, grade int")
    whole = small.groupBy("model", "t").agg(F.array_sort(F.collect_list(F.struct("symbol", "bins", "grade"))).alias("r"))
    return whole.select("model", "t", F.col("r.bins").alias("bins"), F.col("r.grade").alias("grade"))


def _packed(batch: pa.RecordBatch):
    for k, model in enumerate(batch.column(0).to_pylist()):
        bins, grade = batch.column(2).slice(k, 1).flatten(), np.asarray(batch.column(3).slice(k, 1).flatten())
        ends = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + len(bins) + 1]
        yield model, np.frombuffer(bins.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(grade), -1), grade


def histograms(packed: DataFrame, forests: dict[int, Forest], growing: dict[int, dict[int, tuple[int, int]]], open_nodes: dict[int, list[int]], s: Settings) -> DataFrame:
    """(model, node, feature, bin, g, h, n) of the open nodes of all models, summed by Spark; a task sends one row a bin."""

    def local(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for model, bins, grade in _packed(b):
                todo = open_nodes.get(model)
                if not todo:
                    continue
                g, h = gradients(scores(bins, forests[model]), grade, s.top)
                node = place(bins, growing[model])
                for i in todo:
                    at = node == i
                    if at.any():
                        sums = held.setdefault((model, i), np.zeros((bins.shape[1], s.bins, 3)))
                        for f in range(bins.shape[1]):
                            for k, w in enumerate((g[at], h[at], None)):
                                sums[f, :, k] += np.bincount(bins[at, f], w, s.bins)
        for (model, i), sums in held.items():
            f, b = np.nonzero(sums[:, :, 2])
            cols = [np.full(len(f), model), np.full(len(f), i), f, b]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols), *(pa.array(sums[f, b, k]) for k in range(3))], ["model", "node", "feature", "bin", "g", "h", "n"])

    parts = packed.mapInArrow(local, "model int, node int, feature int, bin int, g double, h double, n double")
    return parts.groupBy("model", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))


def best_splits(hist: DataFrame, s: Settings) -> dict[tuple[int, int], tuple]:
    """(model, node) -> (g, h, split), split = (feature, bin, left g, left h) with the largest gain, None where no split leaves ``least`` rows on both sides and gains."""
    w = Window.partitionBy("model", "node", "feature")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = hist.select("model", "node", "feature", "bin", *(F.sum(x).over(up).alias(f"l{x}") for x in "ghn"), *(F.sum(x).over(w).alias(x) for x in "ghn"))
    value = lambda g, h: g * g / (h + s.ridge)
    left, right, whole = (F.col("lg"), F.col("lh")), (F.col("g") - F.col("lg"), F.col("h") - F.col("lh")), (F.col("g"), F.col("h"))
    gain = F.round(value(*left) + value(*right) - value(*whole), 12)
    ok = (F.col("ln") >= s.least) & (F.col("n") - F.col("ln") >= s.least) & (gain > 0)
    pick = F.max(F.when(ok, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "lh")))
    out = c.groupBy("model", "node").agg(F.max_by("g", -F.col("feature")).alias("g"), F.max_by("h", -F.col("feature")).alias("h"), pick.alias("p"))
    return {(r[0], r[1]): (r[2], r[3], r[4] and (-r[4][1], -r[4][2], r[4][3], r[4][4])) for r in out.collect()}


def fit(packed: DataFrame, cuts: dict[int, list[list[float]]], s: Settings = Settings()) -> dict[int, Forest]:
    """Forests of all models, tree by tree, level by level; ``packed`` should be a stored table."""
    forests = {m: Forest(e) for m, e in cuts.items()}
    for _ in range(s.trees):
        growing: dict[int, dict[int, tuple[int, int]]] = {m: {} for m in forests}
        totals: dict[int, dict[int, tuple[float, float]]] = {m: {} for m in forests}
        open_nodes = {m: [0] for m in forests}
        for _ in range(s.depth):
            found = best_splits(histograms(packed, forests, growing, open_nodes, s), s)
            open_nodes = {m: [] for m in forests}
            for (m, i), (g, h, split) in found.items():
                totals[m].setdefault(i, (g, h))
                if split:
                    growing[m][i] = split[:2]
                    totals[m][2 * i + 1], totals[m][2 * i + 2] = split[2:], (g - split[2], h - split[3])
                    open_nodes[m] += [2 * i + 1, 2 * i + 2]
            if not any(open_nodes.values()):
                break
        for m, forest in forests.items():
            forest.trees.append(growing[m])
            forest.leaves.append({i: -s.rate * g / (h + s.ridge) for i, (g, h) in totals[m].items() if i not in growing[m]})
    return forests


def predict(panel: DataFrame, features: list[str], forests: dict[int, Forest]) -> DataFrame:
    """``panel`` (with ``model``) and ``tree``, the score of its model; null where a feature or the model is missing."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    schema = StructType([*panel.schema.fields, StructField("tree", DoubleType())])
    many = len(panel.columns)

    def apply(batches):
        for b in batches:
            models, rows = b.column(b.schema.get_field_index("model")).to_pylist(), b.column(many).to_pylist()
            out: list[float | None] = [None] * len(models)
            for m in set(models) & forests.keys():
                at = [i for i, (k, r) in enumerate(zip(models, rows, strict=True)) if k == m and None not in r]
                if at:
                    v = np.array([rows[i] for i in at])
                    bins = np.column_stack([np.searchsorted(e, v[:, f]) for f, e in enumerate(forests[m].edges)])
                    for i, p in zip(at, scores(bins, forests[m]), strict=True):
                        out[i] = float(p)
            yield pa.RecordBatch.from_arrays([*b.columns[:many], pa.array(out, pa.float64())], schema.names)

    return panel.withColumn("_x", x).mapInArrow(apply, schema)
