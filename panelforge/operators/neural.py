"""Shallow neural regressor trained data-parallel: every step is one Spark job that sums the gradients of all rows of all models.

Rows are packed once, one row a (model, date); a task adds up the gradients of its packed rows, Spark sums the tasks' gradients element by
element, and the driver makes one Adam step on models * weights numbers.  Steps use all rows, so the weights don't depend on the
partitions but for rounding.  Weights start from a generator seeded by (seed, model).

Factors are chosen by their mean rank correlation with realised returns alone; its sign is the factor's sign.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.ranker import Rolling, finished, plan, prepared, zscore
from panelforge.sources.stage import discard, staged


@dataclass(frozen=True)
class Network:
    hidden: tuple[int, ...] = (32, 16)
    steps: int = 80
    rate: float = 0.01
    decay: float = 1e-3  # of squared weights, per row
    seed: int = 42
    select: int = 8  # factors; 0 takes all with their given signs
    least_ic: int = 30  # rows of a date's rank correlation
    clip: float = 2.5  # deviations at which a label is cut


def shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def start(width: int, net: Network, model: int) -> np.ndarray:
    """Uniform weights of the usual bound, biases too, as one vector: each layer's matrix, then its bias."""
    rng = np.random.default_rng([net.seed, model])
    return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) * np.sqrt(6 / (a + b)) for a, b in shapes(width, net.hidden)])


def layers(w: np.ndarray, width: int, hidden: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(width, hidden):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(x: np.ndarray, w: np.ndarray, hidden: tuple[int, ...]) -> list[np.ndarray]:
    """Activations of every layer; rectified but for the last."""
    acts = [x]
    net = layers(w, x.shape[1], hidden)
    for k, (m, b) in enumerate(net):
        z = acts[-1] @ m + b
        acts.append(z if k == len(net) - 1 else np.maximum(z, 0))
    return acts


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """Summed gradient and loss (half squared error) of the rows."""
    acts = forward(x, w, hidden)
    d = acts[-1] - y[:, None]
    loss, parts = float((d * d).sum() / 2), []
    for k, (m, _) in reversed(list(enumerate(layers(w, x.shape[1], hidden)))):
        parts.append(np.concatenate([(acts[k].T @ d).ravel(), d.sum(0)]))
        d = (d @ m.T) * (acts[k] > 0)
    return np.concatenate(parts[::-1]), loss


def rank_correlations(rows: DataFrame, factors: list[str], least: int) -> DataFrame:
    """(t, factor, ic): rank correlation of each factor with y over the rows that have both; null below ``least`` of them."""
    long = rows.select("t", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors))).alias("p"), "y").select("t", "p.factor", "p.x", "y").dropna()
    rank = lambda c: (F.rank().over(Window.partitionBy("t", "factor").orderBy(c)) + F.count("*").over(Window.partitionBy("t", "factor").orderBy(c).rangeBetween(Window.unboundedPreceding, 0))) / 2
    return long.select("t", "factor", rank("x").alias("x"), rank("y").alias("y")).groupBy("t", "factor").agg(F.when(F.count("*") >= least, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("ic"))


def choose(ics: dict[tuple[int, str], float | None], t: int, r: Rolling, net: Network, factors: dict[str, int]) -> list[tuple[int, int]]:
    """[(place of a factor, sign)] for a fit on ``t``: the largest absolute mean correlations of the dates realised by then."""
    if net.select <= 0:
        return list(enumerate(factors.values()))
    means = []
    for k, f in enumerate(factors):
        seen = [v for d in range(t - r.horizon - r.lookback + 1, t - r.horizon + 1) if (v := ics.get((d, f))) is not None]
        if seen and abs(float(np.mean(seen))) >= 1e-8:
            means.append((-abs(float(np.mean(seen))), k, 1 if np.mean(seen) > 0 else -1))
    return [(k, sign) for _, k, sign in sorted(means)[: net.select]]


def train(packed: DataFrame, chosen: dict[int, list[tuple[int, int]]], net: Network) -> dict[int, np.ndarray]:
    """packed(model, width, x, y), x row by row -> weights of each model, all trained together."""
    w = {m: start(len(c), net, m) for m, c in chosen.items()}
    first, second = ({m: np.zeros_like(v) for m, v in w.items()} for _ in range(2))
    index = {m: ([k for k, _ in c], np.array([s for _, s in c], float)) for m, c in chosen.items()}
    for step in range(1, net.steps + 1):

        def local(batches, w=w):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for model, width, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    cols, signs = index[model]
                    x, y = np.array(x, float).reshape(-1, width)[:, cols] * signs, np.array(y, float)
                    g, _ = gradient(x, y, w[model], net.hidden)
                    g = np.append(g, len(y))
                    held[model] = held[model] + g if model in held else g
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["model", "g"])

        sums = packed.mapInArrow(local, "model int, g array<double>").select("model", F.posexplode("g").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
        got = sums.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("g")).collect()
        for m, cells in got:
            g = np.array([c[1] for c in cells])
            g = (g[:-1] + net.decay * w[m]) / g[-1]
            first[m] = 0.9 * first[m] + 0.1 * g
            second[m] = 0.999 * second[m] + 0.001 * g * g
            w = w | {m: w[m] - net.rate * (first[m] / (1 - 0.9**step)) / (np.sqrt(second[m] / (1 - 0.999**step)) + 1e-8)}
    return w


def predict(rows: DataFrame, factors: list[str], chosen: dict[int, list[tuple[int, int]]], weights: dict[int, np.ndarray], net: Network) -> DataFrame:
    """rows(t, symbol, model, equal, factors) -> (t, symbol, model, equal, raw): the network where all chosen factors are there; ``equal`` of the chosen ones where a model is."""

    def apply(batches):
        for b in batches:
            models, equal, x = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            raw: list[float | None] = [None] * len(models)
            for i, m in enumerate(models):
                if m in chosen:
                    have = [s * x[i][k] for k, s in chosen[m] if x[i][k] is not None]
                    equal[i] = sum(have) / len(have) if have else None
            for m in set(models) & weights.keys():
                at = [i for i, k in enumerate(models) if k == m and all(x[i][c] is not None for c, _ in chosen[m])]
                if at:
                    v = np.array([[s * x[i][c] for c, s in chosen[m]] for i in at])
                    for i, p in zip(at, forward(v, weights[m], net.hidden)[-1][:, 0], strict=True):
                        raw[i] = float(p)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(equal, pa.float64()), pa.array(raw, pa.float64())], ["t", "symbol", "model", "equal", "raw"])

    x = F.array(*(F.col(f).cast("double") for f in factors))
    return rows.select("t", "symbol", "model", "equal", x.alias("x")).mapInArrow(apply, "t int, symbol long, model int, equal double, raw double")


def rolling_scores(panel: DataFrame, factors: dict[str, int], dates: list[int], r: Rolling, net: Network = Network(), mask: str = "in_universe", group: int = 256) -> DataFrame:
    """Like ``ranker.rolling_scores`` with a network on the z-score of the realised return; a model learns from at most ``group`` rows a date (documented sample, by hash)."""
    spark, names = panel.sparkSession, list(factors)
    plain = staged(prepared(panel, {f: 1 for f in factors}, r.horizon, mask))
    signed = [F.col(f) * s for f, s in factors.items()]
    some = [F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in names]
    base = plain.withColumn("equal", F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in signed[1:]), F.coalesce(signed[0], F.lit(0.0))), sum(some[1:], some[0])))
    ics = {(t, f): v for t, f, v in rank_correlations(base.where("inside"), names, net.least_ic).collect()}
    whole = base.where("inside").dropna(subset=[*names, "y"]).withColumn("y", zscore(F.col("y")))
    counts = dict(whole.groupBy("t").count().collect())
    models, used = plan(counts, sorted(dates), net.select or len(names), r)
    chosen = {m: c for m in models if (c := choose(ics, m, r, net, factors))}
    on = spark.createDataFrame([(t, used.get(t)) for t in dates], "t int, model int")
    today = base.join(F.broadcast(on), "t")
    rows = today.where("inside").select("t", "symbol", "model", "equal", *names)
    if not chosen:
        return finished(today.select("t", "symbol"), predict(rows, names, {}, {}, net), r.blend, r.smooth)
    learn = F.broadcast(spark.createDataFrame([(m, t) for m in chosen for t in models[m]], "model int, t int"))
    k = F.row_number().over(Window.partitionBy("model", "t").orderBy(F.xxhash64("symbol", "t"), "symbol"))
    cut = F.least(F.greatest(F.col("y"), F.lit(-net.clip)), F.lit(net.clip))
    part = whole.join(learn, "t").withColumn("k", k).where(F.col("k") <= group).select("model", "t", "symbol", F.array(*(F.col(f).cast("double") for f in names)).alias("x"), cut.alias("y"))
    packed = part.groupBy("model", "t").agg(F.array_sort(F.collect_list(F.struct("symbol", "x", "y"))).alias("r"))
    packed = staged(packed.select("model", F.lit(len(names)).alias("width"), F.flatten("r.x").alias("x"), F.col("r.y").alias("y")))
    weights = train(packed, chosen, net)
    discard(packed)
    return finished(today.select("t", "symbol"), predict(rows, names, chosen, weights, net), r.blend, r.smooth)


def icir_scores(panel: DataFrame, factors: dict[str, int], dates: list[int], lookback: int = 252, horizon: int = 20, least: int = 30, least_days: int = 10, mask: str = "in_universe") -> tuple[DataFrame, DataFrame]:
    """((t, symbol, score), (t, factor, weight)) on the rebalance ``dates`` of a dense panel: factors weighted by the ratio of mean and deviation of their realised rank correlations.

    ``factors``: name -> sign.  Negative ratios weigh nothing, a constant positive correlation weighs 1e6; where no weight is positive, or
    the history is shorter than lookback + horizon, weights are equal.  A symbol's score is the weighted mean over the factors it has.
    """
    spark, names = panel.sparkSession, list(factors)
    base = staged(prepared(panel, factors, horizon, mask))
    ics = rank_correlations(base.where("inside"), names, least)
    calendar = base.select("t").distinct().select("t", F.explode(F.array(*map(F.lit, names))).alias("factor"))
    back = Window.partitionBy("factor").orderBy("t").rangeBetween(1 - horizon - lookback, -horizon)
    w = calendar.join(ics, ["t", "factor"], "left").select("t", "factor", F.count("ic").over(back).alias("n"), F.avg("ic").over(back).alias("mu"), F.stddev_samp("ic").over(back).alias("sd"))
    ratio = F.when(F.col("sd") < 1e-12, F.when(F.col("mu") > 1e-12, 1e6).otherwise(0.0)).otherwise(F.greatest(F.col("mu") / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)))
    w = w.withColumn("raw", F.when((F.col("n") >= max(2, least_days)) & (F.col("t") >= lookback + horizon - 1), ratio).otherwise(0.0))
    total = F.sum("raw").over(Window.partitionBy("t"))
    w = w.select("t", "factor", F.when(total > 0, F.col("raw") / total).otherwise(1 / len(names)).alias("weight"))
    w = w.join(F.broadcast(spark.createDataFrame([(t,) for t in dates], "t int")), "t")  # one row a rebalance date
    z = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("z")) for f in names))).alias("p")
    rows = base.where("inside").select("t", "symbol", z).select("t", "symbol", "p.factor", "p.z").where("z is not null").join(w, ["t", "factor"])
    score = F.try_divide(F.sum(F.col("weight") * F.col("z")), F.sum("weight"))
    return rows.groupBy("t", "symbol").agg(score.alias("score")), w
