"""Quality classifier by Bradley-Terry pairwise ranking.

Each text gets a fixed vector of counts and rates (letter case, marks, repetition, line shape).  From
labelled rows preference pairs (good, bad) are formed; the weights maximise the Bradley-Terry
likelihood, i.e. the logistic loss on the pair's feature difference.  A document's strength is the
dot product; the score is the logistic of strength minus the threshold, a quantile of the training
strengths (the share of bad rows).

Fitted on every labelled row that may be learned from, whole texts: rows are dealt into buckets by hash, each row meets
``PAIRS`` opponents of its bucket, and every Newton step adds the buckets' sums over a tree, so no task or driver
holds all rows.  The threshold is an exact order statistic.  Labels, language, source and id are never features.

Defined results: null text is empty and scored as such; rows with null label are not learned from;
with no row of one of the labels every score is 0.5; repeated rows of documents are scored alike, of
labels count once (largest quality); no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import discard, staged, table
from ._text import LOWER, SPACE, pieces, prefix_hash, span_hash, word_spans

BUCKET = 4000  # rows among which pairs are formed; more, where fewer than RARE of a label would be among them
RARE = 64
BROADCAST = 1_000_000  # labels up to so many are sent to the texts, more are joined by shuffle
CHUNK = 16_384  # pairs worked on at once
NEAR = 50_000  # strengths around the quantile that are looked at one by one
PAIRS = 8  # opponents drawn for each labelled row
STEPS = 60
RIDGE = 1e-3
MARKS = [33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 93, 95, 123, 124, 125]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a text."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)

    def rate(mask):
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[off[1:]] - c[off[:-1]]) / size

    low = LOWER[data]
    upper, digit, high, blank = low != data, (data >= 48) & (data <= 57), data >= 128, SPACE[data]
    letter = (low >= 97) & (low <= 122)
    cols = [rate(upper), rate(digit), rate(high), rate(blank), rate(letter), rate(data == 10)]
    cols += [rate(data == m) for m in MARKS]
    start, end, first = word_spans(low, off, SPACE)
    h = span_hash(prefix_hash(low), start, end)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    run = np.concatenate(([0], np.cumsum(length)))
    run2 = np.concatenate(([0], np.cumsum(length * length)))
    mean = (run[first[1:]] - run[first[:-1]]) / some
    spread = np.sqrt(np.maximum((run2[first[1:]] - run2[first[:-1]]) / some - mean * mean, 0))
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], h[1:] == h[:-1]))))) if len(h) else np.zeros(1)
    again = np.where(words > 1, same[np.maximum(first[1:], 1)] - same[np.minimum(first[:-1] + 1, len(same) - 1)], 0) / some
    distinct, top = np.zeros(n), np.zeros(n)
    line_first = np.concatenate(([0], np.flatnonzero(data == 10) + 1, off[1:-1])) if len(data) else np.zeros(1, np.int64)
    line_first = np.unique(line_first[line_first < max(len(data), 1)])
    line_last = np.concatenate((line_first[1:], [len(data)]))
    lh = span_hash(prefix_hash(low), line_first, line_last) if len(data) else np.zeros(0, np.uint64)
    at = np.searchsorted(line_first, off)
    lines = np.zeros(n)
    for d in range(n):
        if words[d]:
            u, c = np.unique(h[first[d] : first[d + 1]], return_counts=True)
            distinct[d], top[d] = len(u) / words[d], c.max() / words[d]
        if at[d + 1] > at[d]:
            lines[d] = len(np.unique(lh[at[d] : at[d + 1]])) / (at[d + 1] - at[d])
    cols += [mean, spread, again, distinct, top, lines, distinct * np.log1p(words), np.log1p(size), np.log1p(words), (words == 0).astype(float)]
    return np.stack(cols, 1)


class Ranker:
    """Bradley-Terry weights, centring, and the strength at which the score is one half."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std, self.cut = mean, std, 0.0
        self.w = np.zeros(2 * len(mean))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate((z, np.abs(z)), 1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut, -40, 40)))


def slopes(model: Ranker, x: np.ndarray, y: np.ndarray, seed: int) -> tuple:
    """(pairs, gradient, curvature) of the logistic loss over the pairs of one bucket, the same pairs in every step."""
    good, bad, size = np.flatnonzero(y == 1), np.flatnonzero(y == 0), len(model.w)
    n, g, h = 0, np.zeros(size), np.zeros((size, size))
    if not len(good) or not len(bad):
        return n, g, h
    rng = np.random.default_rng((7, seed))
    a = np.concatenate((np.repeat(good, PAIRS), rng.choice(good, PAIRS * len(bad))))
    b = np.concatenate((rng.choice(bad, PAIRS * len(good)), np.repeat(bad, PAIRS)))
    z = model.expand(x)
    for i in range(0, len(a), CHUNK):
        d = z[a[i : i + CHUNK]] - z[b[i : i + CHUNK]]
        p = 1 / (1 + np.exp(np.clip(d @ model.w, -40, 40)))
        n, g, h = n + len(d), g + d.T @ p, h + (d * (p * (1 - p))[:, None]).T @ d
    return n, g, h


def total(rows, f, add=lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))):
    """``f(x, y, bucket)`` of every bucket, added within partitions and then over a tree."""

    def part(items):
        out = None
        for r in items:
            y = np.frombuffer(r.y, np.int32)
            one = f(np.frombuffer(r.x).reshape(len(y), -1), y, r.bucket)
            out = one if out is None else add(out, one)
        return [] if out is None else [out]

    return rows.mapPartitions(part).treeReduce(add)


def ordered(rows, model: Ranker, k: int) -> float:
    """The strength with ``k`` others before it, exactly: counts in ever finer bins, the last few one by one."""
    low, high = total(rows, lambda x, y, b: (model.strength(x).min(), model.strength(x).max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))
    while True:
        edges = np.linspace(low, high, 1025)

        def count(x, y, b, edges=edges):
            s = model.strength(x)
            return (s < edges[0]).sum(), np.histogram(s, edges)[0]

        before, bins = total(rows, count)
        if bins.sum() <= NEAR or edges[1] <= edges[0]:
            if edges[1] <= edges[0]:
                return float(low)  # equal to the last digit

            def near(x, y, b, low=low, high=high):
                s = model.strength(x)
                return ([s[(s >= low) & (s <= high)]],)

            found = np.sort(np.concatenate(total(rows, near)[0]))
            return float(found[k - before])
        j = int(np.searchsorted(np.cumsum(bins), k - before, "right"))
        low, high = edges[j], edges[j + 1]


def fit(docs: DataFrame, labels: DataFrame, learn) -> Ranker | None:
    """Ranker from every labelled row that ``learn`` (a condition on doc_id) allows."""
    lab = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = {r[0]: r[1] for r in lab.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    buckets = max(1, min(sum(share.values()) // BUCKET, min(share.values()) // RARE))

    def describe(batches):
        for batch in batches:
            for part, data, off in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(features(data, off)), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    def pack(key, pdf):
        pdf = pdf.sort_values("doc_id")
        return pd.DataFrame({"bucket": [key[0]], "x": [np.stack(pdf["x"]).astype(float).tobytes()], "y": [pdf["quality"].to_numpy(np.int32).tobytes()]})

    some = F.broadcast(lab) if sum(share.values()) <= BROADCAST else lab
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "text", "quality").mapInArrow(describe, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "r.*")
    table_ = staged(rows.groupBy("bucket").applyInPandas(pack, "bucket long, x binary, y binary"))
    try:
        if table_.isEmpty():
            return None
        return learned(table_.rdd)
    finally:
        discard(table_)


def learned(rows) -> Ranker | None:
    """Ranker from buckets (bucket, x, y)."""
    n, bad, mean = total(rows, lambda x, y, b: (len(y), int((y == 0).sum()), x.sum(0)))
    if bad in (0, n):
        return None
    mean = mean / n
    model = Ranker(mean, np.sqrt(total(rows, lambda x, y, b: (((x - mean) ** 2).sum(0),))[0] / n) + 1e-9)
    for _ in range(STEPS):  # Newton steps on the mean logistic loss
        pairs, g, h = total(rows, lambda x, y, b: slopes(model, x, y, b))
        if not pairs:
            return None
        step = np.linalg.solve(h / pairs + RIDGE * np.eye(len(g)), g / pairs - RIDGE * model.w)
        model.w = model.w + step
        if np.abs(step).max() < 1e-6:
            break
    # the quantile of the strengths that leaves the share of bad rows below
    i = min(bad - 1, n - 2)
    model.cut = (ordered(rows, model, i) + ordered(rows, model, i + 1)) / 2
    return model


def rank(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """docs(doc_id, text, …), labels(doc_id, quality, …) -> doc_id, score, predicted."""
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, F.lit(True) if learn is None else learn))

    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch):
                s = model.value.score(features(data, off)) if model.value else np.full(len(off) - 1, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
