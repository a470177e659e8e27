"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

A document leaks an item when a local alignment of its words with the item's words (match 2,
mismatch and gap -1; the best one of some end) pairs at least SIMILARITY of the item's words with equal words.

Seeds are single words: an insertion between any two words of a copy breaks every longer run without costing it
a paired word, so no bound over longer runs is exact.  Their number in the corpus orders an item's words, rarest first.
A leak leaves at most ``words - need`` of them unpaired, so by the pigeonhole principle it meets at least HITS of
the rarest ``words - need + HITS``, and the frequent ones need not be looked up.  The cost of an
alignment is below twice its pairs, so its insertions move it by less than two item lengths from the diagonal of
a hit: that far a window reaches, and hits that near are in one window.  A window with too few hits or too
few of the item's words is left out (upper bounds, so exact); the rest are aligned.

Items are handled in blocks of BLOCK, so what is shipped to the executors has a fixed bound.

Defined results: null or wordless items and documents match nothing; items of fewer than N words
are their own seed and must occur whole; repeated rows of documents give one pair; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import table
from ._text import ALNUM, LOWER, mix, pieces, prefix_hash, span_hash, word_spans

N = 3
SIMILARITY = 0.7
BLOCK = 20_000
HITS = 3  # rare words of an item that a window must hold
_K = np.int64(1 << 20)
_C = mix(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)


def words(data: np.ndarray, off: np.ndarray):
    low = LOWER[data]
    start, end, first = word_spans(low, off, ~ALNUM)
    return span_hash(prefix_hash(low), start, end), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _C[j] if len(out) else out
    return mix(out + np.uint64(n))


def align(item: np.ndarray, window: np.ndarray, need: int = 0) -> tuple[int, int, int]:
    """(score, pairs of equal words, end in the window) of the best local alignment with ``need`` pairs; of equal scores the one with more pairs, then the first."""
    h = np.zeros(len(window) + 1, np.int64)
    ramp = np.arange(len(window) + 1, dtype=np.int64) * _K
    best = np.zeros(len(window) + 1, np.int64)
    for w in item:
        step = np.where(window == w, 2 * _K + 1, -_K)
        new = np.zeros_like(h)
        new[1:] = np.maximum(h[:-1] + step, h[1:] - _K)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + ramp) - ramp
        h[h < _K] = 0
        np.maximum(best, np.where(h % _K >= need, h, 0) if need else h, out=best)
    at = int(best.argmax())
    return int(best[at] // _K), int(best[at] % _K), at


class Items:
    """A block of benchmark items with its seeds."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float):
        self.ids, self.words, self.similarity = [], [], similarity
        for i, t in zip(ids, texts, strict=True):
            data = np.frombuffer((t or "").encode(), np.uint8)
            h, _ = words(data, np.array([0, len(data)]))
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.sets = [np.unique(h, return_counts=True) for h in self.words]
        self.need = [int(np.ceil(similarity * len(h) - 1e-9)) for h in self.words]
        self.hits = [min(HITS, n) if len(h) >= N else 1 for n, h in zip(self.need, self.words, strict=True)]
        self.seeds = {}
        for n in range(1, N):
            own = [(k, grams(h, n)) for k, h in enumerate(self.words) if (len(h) if len(h) < N else 1) == n]
            self.seeds[n] = [(k, g) for k, g in own]
        self.all = {n: np.unique(np.concatenate([g for _, g in s])) if s else np.zeros(0, np.uint64) for n, s in self.seeds.items()}

    def count(self, h: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for n, a in self.all.items():
            if len(a):
                g = grams(h, n)
                at = np.minimum(np.searchsorted(a, g), len(a) - 1)
                out[n] = np.bincount(at[a[at] == g], minlength=len(a))
        return out

    def choose(self, freq: dict[tuple[int, int], int]) -> None:
        """Keeps each item's rarest seeds."""
        self.index = {}
        for n, s in self.seeds.items():
            rows = []
            for k, g in s:
                most = len(g) if len(self.words[k]) < N else len(g) - self.need[k] + self.hits[k]
                pos = sorted(range(len(g)), key=lambda p: (freq.get((n, int(g[p].view(np.int64))), 0), int(g[p]), p))[:most]
                rows += [(int(g[p]), k, int(p)) for p in pos]
            rows.sort()
            self.index[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def find(self, h: np.ndarray, first: np.ndarray):
        """(document, item, score, pairs, similarity, start of the window in words) of leaks, the best window of each."""
        best: dict[tuple[int, int], tuple] = {}
        for n, (key, item, pos) in self.index.items():
            if not len(key):
                continue
            g = grams(h, n)
            lo, hi = np.searchsorted(key, g, "left"), np.searchsorted(key, g, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            reps = hi[hit] - lo[hit]
            at = np.repeat(hit, reps)
            row = np.repeat(lo[hit], reps) + np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
            doc = np.searchsorted(first, at, "right") - 1
            fits = at + n <= first[doc + 1]
            doc, k, p, diag = doc[fits], item[row[fits]], pos[row[fits]], at[fits] - pos[row[fits]]
            if not len(doc):
                continue
            o = np.lexsort((diag, k, doc))
            doc, k, p, diag = doc[o], k[o], p[o], diag[o]
            size, least = np.array([len(w) for w in self.words]), np.array(self.hits)
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (diag[1:] - diag[:-1] > 4 * size[k[1:]] + 1)))
            begin = np.flatnonzero(new)
            end = np.concatenate((begin[1:], [len(doc)])) - 1
            places = np.unique((np.cumsum(new) - 1) * np.int64(size.max()) + p) // size.max()  # a row a hit place of the item
            alive = np.bincount(places, minlength=len(begin)) >= least[k[begin]]
            for a, b in zip(begin[alive], end[alive], strict=True):
                d, i = int(doc[a]), int(k[a])
                length, need = int(size[i]), self.need[i]
                s = 2 * length
                left, right = max(int(diag[a]) - s, int(first[d])), min(int(diag[b]) + length + s, int(first[d + 1]))
                step = 4 * length  # a long row of hits is cut into overlapping windows
                for x in range(left, max(right - length - 2 * s, left) + 1, step):
                    window = h[x : min(x + step + length + 2 * s, right)]
                    own, times = self.sets[i]
                    at_own = np.minimum(np.searchsorted(own, window), len(own) - 1)
                    if int(np.minimum(np.bincount(at_own[own[at_own] == window], minlength=len(own)), times).sum()) < need:
                        continue
                    score, pairs, e = align(self.words[i], window, need)
                    if pairs >= need and (score, pairs) > best.get((d, i), (0, 0))[:2]:
                        slack = int((1 - self.similarity) * length + 1e-9)
                        best[d, i] = (score, pairs, pairs / length, max(x + e - length - slack, int(first[d])) - int(first[d]))
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, score long, pairs long, similarity double, window_start long"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, …), benchmark(item_id, text, …) -> one row a leaking pair: doc_id, item_id, score, pairs, similarity, window_start."""
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    blocks = -(-items.count() // BLOCK)
    out = None
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).sort("item_id", "text").collect()  # about BLOCK rows
        block = Items([r[0] for r in rows], [r[1] for r in rows], similarity)
        if not block.ids:
            continue

        def count(batches, block=block):
            total = {}
            for batch in batches:
                for _, data, off in pieces(batch):
                    for n, c in block.count(*words(data, off)).items():
                        total[n] = total.get(n, 0) + c
            for n, c in total.items():
                s = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n, np.int32)), pa.array(block.all[n][s].view(np.int64)), pa.array(c[s])], ["n", "g", "c"])

        freq = docs.select("text").mapInArrow(count, "n int, g long, c long").groupBy("n", "g").agg(F.sum("c").alias("c"))
        block.choose({(r[0], r[1]): r[2] for r in freq.collect()})  # a row a seed of the block at most
        held = spark.sparkContext.broadcast(block)

        def find(batches, held=held):
            for batch in batches:
                for part, data, off in pieces(batch):
                    got = held.value.find(*words(data, off))
                    ids = part.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([g[0] for g in got], pa.int64())), pa.array([held.value.ids[g[1]] for g in got], pa.int64()),
                            *(pa.array([g[j] for g in got], t) for j, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.int64()))),
                        ],
                        ["doc_id", "item_id", "score", "pairs", "similarity", "window_start"],
                    )

        one = docs.mapInArrow(find, SCHEMA)
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    rest = ["score", "pairs", "similarity", F.negative("window_start").alias("w")]
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("b")).select("doc_id", "item_id", "b.score", "b.pairs", "b.similarity", F.negative("b.w").alias("window_start"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that leak no item, with their columns."""
    bad = leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
