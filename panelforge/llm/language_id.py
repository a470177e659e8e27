"""Language identification by prediction by partial matching (PPM-C).

For each language a variable-order byte context tree is counted on a bounded sample of labelled
texts and then frozen.  The probability of a byte in its context is the escape chain from the
longest known context down to the uniform order, with exclusion of the symbols already offered,
so the negative log is an exact code length over bytes (letters A-Z as a-z).  Exclusion shares the parent's probabilities out
among the symbols not yet offered, without a recount.  Contexts seen fewer than LEAST times are no nodes: their bytes are
coded in the next shorter context.  A text gets the language with the shortest code.

Frozen trees are laid out as one dense table ``cost[node, symbol, language]``; scoring is a table
look-up per byte in Arrow batches.

Defined results: null text or text without a letter -> ``und`` with score 0; no labelled rows ->
``und`` everywhere; ties -> alphabetically first language; repeated rows are scored alike; rows with
null language are scored but not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import table
from ._text import LOWER, pieces

ORDER = 3
SAMPLE = 400  # labelled texts a language, whole texts, smallest hash of doc_id first
BROADCAST = 1 << 20  # sampled rows whose keys are broadcast
LEAST = 3  # occurrences, in any language, that make a context a node


class Model:
    """Frozen PPM trees of all languages."""

    def __init__(self, langs: list[str], fold: np.ndarray, node: np.ndarray, cost: np.ndarray):
        self.langs, self.fold, self.node, self.cost, self.size = langs, fold, node, cost, cost.shape[1]

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        langs = sorted(samples)
        streams = {k: [LOWER[np.frombuffer(t.encode(), np.uint8)] for t in samples[k]] for k in langs}
        freq = sum((np.bincount(a, minlength=256) for k in langs for a in streams[k]), np.zeros(256, np.int64))
        top = np.flatnonzero(freq)  # every byte that occurs is a symbol; one more stands for bytes never seen, the last for the start of a text
        size = len(top) + 2
        fold = np.full(256, len(top), np.uint16)
        fold[top] = np.arange(len(top))
        fold = fold[LOWER]
        pad = size - 1
        grams = {k: [] for k in langs}
        for k in langs:
            for a in streams[k]:
                s = np.concatenate((np.full(ORDER, pad), fold[a])).astype(np.int64)
                grams[k].append(sum(s[i : len(s) - ORDER + i] * size ** (ORDER - i) for i in range(ORDER + 1)))
            grams[k] = np.unique(np.concatenate(grams[k]) if grams[k] else np.zeros(0, np.int64), return_counts=True)
        # nodes: the contexts of each order with enough occurrences in any language
        total = {}
        known: list[np.ndarray] = []
        for order in range(ORDER + 1):
            counts = []
            for k in langs:
                g, c = grams[k]
                u, i = np.unique(g % size ** (order + 1), return_inverse=True)
                counts.append((u // size, u % size, np.bincount(i, c, len(u))))
            total[order] = counts
            if order:
                ctx = np.concatenate([x[0] for x in counts])
                u, i = np.unique(ctx, return_inverse=True)
                known.append(u[np.bincount(i, np.concatenate([x[2] for x in counts]), len(u)) >= LEAST])
            else:
                known.append(np.zeros(1, np.int64))
        prob = []
        base = []
        for j in range(len(langs)):
            parent = None
            rows = []
            for order in range(ORDER + 1):
                ctx, sym, cnt = total[order][j]
                m = np.zeros((len(known[order]), size))
                ok = np.isin(ctx, known[order])  # none at all in a very small sample
                at = np.searchsorted(known[order], ctx)
                m[at[ok], sym[ok].astype(np.int64)] = cnt[ok]
                if order == 0:
                    up = np.full((1, size), 1.0 / 256)
                else:
                    up = parent[cls._down(known, order, size)]
                n, d = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
                rest = np.where(m > 0, 0, up).sum(1, keepdims=True)
                seen_all = rest <= 0
                p = np.where(m > 0, m / np.maximum(n + np.where(seen_all, 0, d), 1), d / np.maximum(n + d, 1) * up / np.where(seen_all, 1, rest))
                rows.append(np.where(n > 0, p, up))
                parent = np.concatenate(rows)
            prob.append(parent)
        starts = np.cumsum([0] + [len(x) for x in known])
        base = np.zeros(size**ORDER, np.int32)
        full = np.arange(size**ORDER)
        for order in range(1, ORDER + 1):
            ctx = full % size**order
            at = np.minimum(np.searchsorted(known[order], ctx), max(len(known[order]) - 1, 0))
            hit = known[order][at] == ctx if len(known[order]) else np.zeros(len(ctx), bool)
            base = np.where(hit, starts[order] + at, base).astype(np.int32)
        cost = (-np.log(np.maximum(np.stack(prob, 2), 1e-30))).astype(np.float32)
        return cls(langs, fold, base, np.ascontiguousarray(cost))

    @staticmethod
    def _down(known: list[np.ndarray], order: int, size: int) -> np.ndarray:
        """Row of each context's longest known proper suffix."""
        starts = np.cumsum([0] + [len(x) for x in known])
        out = np.zeros(len(known[order]), np.int64)
        for low in range(1, order):
            ctx = known[order] % size**low
            at = np.minimum(np.searchsorted(known[low], ctx), max(len(known[low]) - 1, 0))
            hit = known[low][at] == ctx if len(known[low]) else np.zeros(len(ctx), bool)
            out = np.where(hit, starts[low] + at, out)
        return out

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in nats of each text under each language."""
        n, size, pad = len(off) - 1, self.size, self.size - 1
        out = np.zeros((n, len(self.langs)))
        if not len(data):
            return out
        s = self.fold[data].astype(np.int32)
        ctx = np.zeros(len(s), np.int32)
        for back in range(ORDER, 0, -1):
            prev = np.full(len(s), pad, np.int32)
            prev[back:] = s[:-back] if back < len(s) else s[:0]
            for x in range(back):  # contexts never reach into the text before
                at = off[:-1] + x
                prev[at[at < off[1:]]] = pad
            ctx = ctx * size + prev
        # the cost rows are added a slice at a time; a text's sum is the difference of running sums
        flat, rows = self.cost.reshape(-1, len(self.langs)), self.node[ctx].astype(np.int64) * size + s
        some = np.flatnonzero(off[1:] > off[:-1])
        out[some] = np.add.reduceat(flat[rows], off[some], axis=0, dtype=np.float64)
        return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    count = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    found = count[off[1:]] > count[off[:-1]]
    for d in np.flatnonzero(~found & (off[1:] > off[:-1])):
        found[d] = any(c.isalpha() for c in bytes(data[off[d] : off[d + 1]]).decode("utf-8", "replace"))
    return found


def train(docs: DataFrame, learn) -> Model | None:
    """Frozen model from at most SAMPLE different whole texts of each label; ``learn`` says which rows may be read."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r[0] for r in rows.select("lang").distinct().collect()]  # one row a label
    if not langs:
        return None
    key = ["lang", "doc_id", "_h"]
    rows = rows.select("lang", "doc_id", "text", F.xxhash64("text").alias("_h"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_h")
    ids = rows.select(*key).distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE).select(*key)
    text: dict[str, list[str]] = {k: [] for k in langs}
    ids = F.broadcast(ids) if len(langs) * SAMPLE <= BROADCAST else ids  # three small columns, SAMPLE rows a label
    for r in rows.join(ids, key, "left_semi").dropDuplicates(key).select("lang", "text").sort("doc_id", "_h").collect():  # SAMPLE rows a label at most
        text[r[0]].append(r[1])
    return Model.fit({k: v for k, v in text.items() if v})


def identify(docs: DataFrame, learn=None) -> DataFrame:
    """docs(doc_id, text, lang, …) -> doc_id, lang_pred, score: posterior of the winning language under equal priors."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs, F.lit(True) if learn is None else learn)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = held.value
        for batch in batches:
            for part, data, off in pieces(batch, limit=1 << 20):
                ok = has_letter(data, off) & ~np.asarray(part.column(1).is_null())
                if m is None:
                    pred, conf = np.full(len(off) - 1, "und", object), np.zeros(len(off) - 1)
                else:
                    c = m.lengths(data, off)
                    best = c.argmin(1)
                    with np.errstate(under="ignore"):
                        conf = np.where(ok, 1 / np.exp(np.clip(c[np.arange(len(c)), best][:, None] - c, -700, 0)).sum(1), 0.0)
                    pred = np.where(ok, np.array(m.langs, object)[best], "und")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(conf)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, learn=None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is identified with a posterior of at least ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, F.lit(True) if learn is None else learn))
    column = docs.columns.index("text")

    def run(batches):
        m = model.value
        for batch in batches:
            for part, data, off in pieces(batch, limit=1 << 20):
                ok = has_letter(data, off) & ~np.asarray(part.column(column).is_null())
                if m is None:
                    ok[:] = False
                else:
                    c = m.lengths(data, off)
                    with np.errstate(under="ignore"):
                        ok &= 1 / np.exp(np.clip(c.min(1)[:, None] - c, -700, 0)).sum(1) >= least
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
