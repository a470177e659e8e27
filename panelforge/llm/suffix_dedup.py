"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts in an earlier document.

Texts are UTF-8 bytes; matches never cross documents; "earlier" is a smaller doc_id; strings are judged on the input.

The suffix order is built by a distributed merge sort that knows common prefixes:

1. Sample suffixes: of each LENGTH-byte window the minimizer (the K-gram with the least hash) is an anchor.  Equal windows
   have equal anchors at equal places, so comparing the suffixes at anchors finds every repeated window.
2. Duplicate detection: fingerprints of the anchors' K-grams are counted exactly (``_shared``); an anchor met in one text
   only cannot repeat and its suffix is not exchanged.
3. Each task sorts the suffixes of its remaining anchors (by fingerprint, then bytes, as far as their windows reach), folds equal
   ones to the earliest document, and sends front-coded runs (common prefix with the one before, then the rest) to ranges, which
   are cut so that each gets about as many anchors.
4. A range deals its strings into blocks by fingerprint, leaves out blocks of one document, and merges the runs of a block with
   a loser tree that keeps for each run the common prefix with the last winner and compares bytes only past it (strings that are
   all equal are in order).  In suffix order, strings that agree after the anchor are neighbours; with the bytes before it each window
   is told, and belongs to its first document.  A block has at most one entry of each distinct suffix from a run, however many documents hold it.
5. The windows that start in an earlier document are united to spans, cut out and hashed.

Texts equal to an earlier one are removed whole (if long enough) without being indexed.

Defined results: null text is empty; texts shorter than LENGTH keep all; rows with equal doc_id never remove from each other; a row
with null doc_id is kept whole and removes nothing; long texts are read in overlapping segments; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared
from ._stage import shuffles, staged, table
from ._text import PIECE, mix, pieces, powers, prefix_hash

LENGTH = 50
K = 32
RANGE = 4 << 20  # bytes of text to a range at most, so that a range's suffixes fit a worker
RUN = 8 << 20  # bytes of suffixes that a task sorts at once


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the K-gram at each place."""
    n = len(data) - K + 1
    p = prefix_hash(data)
    return mix((p[K:] - p[:n]) * powers(len(data) + 1)[1][:n])


def anchors(data: np.ndarray, off: np.ndarray, length: int):
    """(gram hashes, place, first window, last window, document) of the anchors of a piece of texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, none
    h = grams(data)
    a = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h)).astype(np.uint64)
    w, span = length - K + 1, 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    if span < w:
        a = np.minimum(a[: len(a) - (w - span)], a[w - span :])
    place = (a & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
    valid = np.arange(len(place)) + length <= off[doc + 1]
    first = valid & np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    last = valid & np.concatenate((first[1:] | ~valid[1:], [True]))
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return h, place[lo], lo, hi, doc[lo]


def segments(data: np.ndarray, off: np.ndarray, length: int):
    """(start, data, offsets) of a piece; a text longer than PIECE comes in segments that overlap by length - 1."""
    if len(off) == 2 and len(data) > PIECE:
        for s in range(0, len(data) - length + 1, PIECE):
            part = data[s : s + PIECE + length - 1]
            yield s, part, np.array([0, len(part)])
    else:
        yield 0, data, off


def identity(text):
    """Two hashes and the size of a text, computed alike by Spark and in the kernel."""
    t = F.coalesce(text, F.lit(""))
    m = F.md5(t)
    return F.conv(F.substring(m, 1, 15), 16, 10).cast("long"), F.conv(F.substring(m, 16, 15), 16, 10).cast("long"), F.octet_length(t).cast("long")


def _identity(text: bytes) -> tuple[int, int, int]:
    m = hashlib.md5(text).hexdigest()
    return int(m[:15], 16), int(m[15:30], 16), len(text)


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """Loser tree over sorted runs (strings, common prefix with the string before): yields (run, index, common prefix with the last yield).

    The prefix that a run's string shares with the last winner is known, so strings are compared only past it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    at, known = [0] * k, [0] * k
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)"""
        a, b = text[x], text[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        p, q = known[x], known[y]
        if p != q:  # the one that shares more with the last winner is smaller; what the other shares with it is known
            return (x, y) if p > q else (y, x)
        n = min(len(a), len(b))
        u, v = a[p:n], b[p:n]
        if u == v:
            same = n
            less = len(a) < len(b) or (len(a) == len(b) and x < y)
        else:
            same = n - ((int.from_bytes(u) ^ int.from_bytes(v)).bit_length() + 7) // 8
            less = u < v
        if less:
            known[y] = same
            return x, y
        known[x] = same
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser[node] = play(build(2 * node), build(2 * node + 1))
        return w

    best = build(1) if k > 1 else 0
    while text[best] is not None:
        strings, lcp = runs[best]
        i = at[best]
        yield best, i, known[best]
        i += 1
        at[best] = i
        if i < len(strings):
            text[best], known[best] = strings[i], lcp[i]
        else:
            text[best] = None
        node = (best + k) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


_META = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("lo", "<i8"), ("left", "u1"), ("windows", "u1"), ("lcp", "<u2"), ("size", "<u2")])
_RUN = "r int, doc_id long, tie long, lo long, hi long, meta binary, tails binary"
_SPAN = "doc_id long, tie long, lo long, hi long"


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    u, v = a[:n], b[:n]
    return n if u == v else n - ((int.from_bytes(u) ^ int.from_bytes(v)).bit_length() + 7) // 8


def entries(data: np.ndarray, fp: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, tie: np.ndarray, shift: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, meta) of anchors: fingerprint and suffix, then the bytes before the anchor, each with zeros past its end."""
    meta = np.zeros(len(fp), _META)
    meta["doc"], meta["tie"], meta["lo"] = doc, tie, lo + shift
    meta["left"], meta["windows"], meta["size"] = place - lo, hi - lo + 1, 6 + hi + length - place
    wide = _width(length)
    out = np.zeros((len(fp), wide + length - K), np.uint8)
    out[:, :6] = fp.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    to = np.arange(length)
    out[:, 6 : 6 + length] = np.where(to < meta["size"][:, None] - 6, data[np.minimum(place[:, None] + to, len(data) - 1)], 0)
    to = np.arange(length - K)
    out[:, wide:] = np.where(to < meta["left"][:, None], data[lo[:, None] + to], 0)
    return out, meta


def _width(length: int) -> int:
    return (6 + length + 7) // 8 * 8


def bounds(ranges: int, length: int) -> np.ndarray:
    """Fingerprints that begin the ranges after the first, so that all get about as many anchors.

    An anchor has the least hash of a window, so small fingerprints are far more frequent: a place of hash u is one with
    probability (1 - u)^m (1 + m u) for m + 1 K-grams to a window.  Made once, so that all tasks cut alike.
    """
    m = length - K
    u = np.linspace(0, 1, (1 << 16) + 1)
    share = (1 - (1 - u) ** (m + 1) - m / (m + 2) * (1 - (1 - u) ** (m + 2))) * (m + 2) / 2
    return (np.interp(np.arange(1, ranges) / ranges, share, u) * (1 << 48)).astype(np.int64)


def front_coded(held: list[tuple[np.ndarray, np.ndarray]], cuts: np.ndarray, length: int) -> pa.RecordBatch:
    """A sorted run: equal entries folded to the earliest document (the others' spans are done), the rest front-coded by range."""
    rows, meta = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    wide = _width(length)
    fp = rows[:, :6].astype(np.int64) @ (1 << np.arange(40, -1, -8, dtype=np.int64))
    order = np.argsort(fp, kind="stable")
    twice = np.diff(fp[order], prepend=-1) == 0
    twice[:-1] |= twice[1:]
    some = order[twice]  # only entries that share a fingerprint are compared further
    left = np.zeros((len(some), (length - K + 7) // 8 * 8), np.uint8)
    left[:, : length - K] = rows[some, wide:]
    words = np.concatenate([rows[some, :wide].view(">u8"), meta["size"][some, None], meta["left"][some, None], left.view(">u8")], axis=1).astype(np.uint64)
    order[twice] = some[np.lexsort((meta["doc"][some], *words.T[::-1]))]
    rows, meta = rows[order], meta[order]
    same = (rows[1:] == rows[:-1]).all(axis=1) & (meta["size"][1:] == meta["size"][:-1]) & (meta["left"][1:] == meta["left"][:-1])
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(rows)), 0))
    done = meta["doc"] != meta["doc"][head]  # all their windows start in the run's earlier document
    late, rows, meta = meta[done], rows[~done], meta[~done]
    r = np.searchsorted(cuts, fp[order][~done], "right")
    edge = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)]))
    differ = rows[1:, :wide] != rows[:-1, :wide]
    size = meta["size"].astype(np.int64)
    meta["lcp"][1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), wide), np.minimum(size[1:], size[:-1]))
    meta["lcp"][edge[:-1]] = 0
    to = np.arange(rows.shape[1])
    sent = ((to >= meta["lcp"][:, None]) & (to < size[:, None])) | ((to >= wide) & (to < wide + meta["left"][:, None].astype(np.int64)))
    tails = rows[sent]
    at = np.concatenate(([0], np.cumsum(size - meta["lcp"] + meta["left"])))[edge]
    runs = [(int(r[a]), meta[a:b].tobytes(), tails[x:y].tobytes()) for a, b, x, y in zip(edge[:-1], edge[1:], at[:-1], at[1:], strict=True)]
    n, none = len(runs), len(late)
    spans = [late["doc"], late["tie"], late["lo"], late["lo"] + late["windows"] - 1 + length]
    # spans that are done pass through the ranges, dealt evenly, so that the runs need not be written besides their exchange
    columns = [pa.array([x[0] for x in runs] + (np.arange(none) % (len(cuts) + 1)).tolist(), pa.int32())]
    columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in spans]
    columns += [pa.array([x[j] for x in runs] + [None] * none, pa.binary()) for j in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RUN.split(", ")])


def _decode(meta: np.ndarray, tails: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Front-coded strings as rows of bytes, zeros past their ends; ``start``: where each one's tail begins."""
    out = np.zeros((len(meta), width), np.uint8)
    lcp, size, row = meta["lcp"].astype(np.int64), meta["size"], np.arange(len(meta))
    for c in range(width):
        # a byte inside the common prefix is that of the last string whose tail reaches this column
        src = np.maximum.accumulate(np.where(lcp <= c, row, 0))
        out[:, c] = np.where(c < size, tails[np.minimum(start[src] + c - lcp[src], len(tails) - 1)], 0)
    return out


def _lefts(meta: np.ndarray, tails: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The bytes before the anchors, nearest first, as numbers: equal in the first a bytes means equal classes in column a."""
    left = meta["left"].astype(np.int64)
    back = np.arange(width)
    rows = np.where(back < left[:, None], tails[np.clip((start + left)[:, None] - 1 - back, 0, len(tails) - 1)], 0).astype(np.uint8)
    out = np.zeros((len(meta), width + 1), np.int32)
    for a in range(width):
        _, out[:, a + 1] = np.unique(out[:, a].astype(np.int64) << 8 | rows[:, a], return_inverse=True)
    return out


def _order(blocks: np.ndarray, strings: np.ndarray, size: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the runs of each block (bounds in ``blocks``): (order, common prefix with the string before; 0 where a block begins)."""
    n = len(strings)
    order, common = np.arange(n), np.zeros(n, np.int64)
    head = np.repeat(blocks[:-1], np.diff(blocks))
    same = (strings == strings[head]).all(axis=1) & (size == size[head])
    common[:] = size
    common[blocks[:-1]] = 0
    for x in np.flatnonzero(~np.logical_and.reduceat(same, blocks[:-1])).tolist():
        a, b = int(blocks[x]), int(blocks[x + 1])
        raw = [strings[i, : size[i]].tobytes() for i in range(a, b)]
        edge = [0, *(np.flatnonzero(np.diff(run[a:b])) + 1).tolist(), b - a]
        runs = [(raw[i:j], [0, *map(_lcp, raw[i : j - 1], raw[i + 1 : j])]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        for at, (r, i, c) in enumerate(merge(runs), a):
            order[at], common[at] = a + edge[r] + i, c
    return order, common


def merged_spans(t: pa.Table, length: int) -> pa.Table:
    """The runs of a range -> spans [lo, hi) of the windows that an earlier document holds.

    Strings are dealt into blocks by the fingerprint they begin with; blocks of one document are left out, and a block is merged
    unless its strings are all equal.  A window takes ``a`` bytes before the anchor's K-gram and the rest after it; in suffix order
    the strings that agree in the rest are neighbours, so a window is told by their class there and the class of the ``a`` bytes.
    """
    w = length - K + 1
    done = t.filter(pc.is_null(t.column("meta"))).select(["doc_id", "tie", "lo", "hi"])
    t = t.filter(pc.is_valid(t.column("meta")))
    if not t.num_rows:
        return done
    meta = np.concatenate([np.frombuffer(x.as_py(), _META) for x in t.column("meta")])
    tails = np.frombuffer(b"".join(x.as_py() for x in t.column("tails")), np.uint8)
    run = np.repeat(np.arange(t.num_rows), [len(x.as_py()) // _META.itemsize for x in t.column("meta")])
    fresh = meta["size"].astype(np.int64) - meta["lcp"]
    start = np.concatenate(([0], np.cumsum(fresh + meta["left"])))[:-1]
    strings = _decode(meta, tails, start, int(meta["size"].max()))
    fp = strings[:, :6].astype(np.int64) @ (1 << np.arange(40, -1, -8, dtype=np.int64))

    def blocks_of(x):
        return np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1, [len(x)]))

    keep = np.argsort(fp, kind="stable")
    edge = blocks_of(fp[keep])
    doc = meta["doc"][keep]
    many = np.minimum.reduceat(doc, edge[:-1]) < np.maximum.reduceat(doc, edge[:-1])
    keep = keep[np.repeat(many, np.diff(edge))]
    if not len(keep):
        return done
    meta, strings = meta[keep], strings[keep]
    order, common = _order(blocks_of(fp[keep]), strings, meta["size"].astype(np.int64), run[keep])
    meta, at = meta[order], keep[order]
    before = _lefts(meta, tails, start[at] + fresh[at], w - 1)
    left, right, doc = meta["left"].astype(np.int64), meta["size"].astype(np.int64) - K - 6, meta["doc"]
    gone = np.zeros((len(meta), w + 1), bool)
    for a in range(w):
        some = np.flatnonzero((left >= a) & (right >= w - 1 - a))
        if len(some):
            key = np.cumsum(common < K + 6 + w - 1 - a)[some] << 32 | before[some, a]
            by = np.argsort(key, kind="stable")
            edge = blocks_of(key[by])
            least = np.empty(len(some), np.int64)
            least[by] = np.repeat(np.minimum.reduceat(doc[some[by]], edge[:-1]), np.diff(edge))
            gone[some, left[some] - a] = least < doc[some]
    step = np.diff(gone.astype(np.int8), axis=1, prepend=0)
    i, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)  # the last column is never set, so every run of windows ends
    return pa.concat_tables([done, pa.table({"doc_id": doc[i], "tie": meta["tie"][i], "lo": meta["lo"][i] + lo, "hi": meta["lo"][i] + hi - 1 + length})])


def spans(texts: DataFrame, length: int) -> DataFrame:
    """texts(doc_id, tie, text, tokens, n_bytes) -> removed spans [lo, hi) by (doc_id, tie), staged; ``tokens``: fingerprints worth comparing."""
    ranges = max(shuffles(texts.sparkSession), (texts.agg(F.sum("n_bytes")).first()[0] or 0) // RANGE)
    cuts = bounds(ranges, length)

    def sort_runs(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part, data, off in pieces(batch, "text"):
                ids, ties, toks = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "tie", "tokens"))
                ids, ties = ids.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
                want = [np.frombuffer(x.as_py(), np.uint64) for x in toks]
                for s, d, o in segments(data, off, length):
                    h, place, lo, hi, doc = anchors(d, o, length)
                    fp = h[place] >> np.uint64(16)
                    keep = np.zeros(len(fp), bool)
                    edge = np.searchsorted(doc, np.arange(len(o)))
                    for x in range(len(o) - 1):
                        a = slice(edge[x], edge[x + 1])
                        w = want[x]
                        if a.stop > a.start and len(w):
                            keep[a] = w[np.minimum(np.searchsorted(w, fp[a]), len(w) - 1)] == fp[a]
                    if keep.any():
                        held.append(entries(d, fp[keep], place[keep], lo[keep], hi[keep], ids[doc[keep]], ties[doc[keep]], s - o[doc[keep]], length))
                        size += held[-1][0].nbytes
                    if size >= RUN:
                        yield front_coded(held, cuts, length)
                        held, size = [], 0
        if held:
            yield front_coded(held, cuts, length)

    def combine(t: pa.Table) -> pa.Table:
        return merged_spans(t, length)

    return staged(texts.mapInArrow(sort_runs, _RUN).groupBy("r").applyInArrow(combine, _SPAN))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, …) -> doc_id, n_bytes, n_removed, n_spans, kept (binary): the bytes left."""
    if length < K + 8 or length > 255:
        raise ValueError(f"length must be from {K + 8} to 255")
    i1, i2, n = identity(F.col("text"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = d.where(F.octet_length("text") >= length).select("doc_id", i1.alias("i1"), i2.alias("i2"), n.alias("n")).groupBy("i1", "i2", "n").agg(F.min("doc_id").alias("first"))

    def kernel(data, off):
        for s, part, o in segments(data, off, length):
            h, place, _, _, doc = anchors(part, o, length)
            fp = h[place]
            edge = np.searchsorted(doc, np.arange(len(o)))
            for x in range(len(o) - 1):
                if edge[x + 1] > edge[x]:
                    key = _identity(part[o[x] : o[x + 1]].tobytes()) if len(o) > 2 or len(data) <= PIECE else (*_identity(data.tobytes())[:2], len(data))
                    # a long text's segments are items of their own, told apart by the negative start
                    yield (key if not s else (key[0], key[1], -s - (key[2] << 32) if key[2] < 1 << 30 else -s)), np.unique(fp[edge[x] : edge[x + 1]])

    def finish(keys, own, tok, df):
        at = np.searchsorted(own, np.arange(len(keys[0]) + 1))
        some = [x for x in range(len(keys[0])) if at[x + 1] > at[x]]
        return pa.table({**{c: pa.array(k[some], pa.int64()) for c, k in zip(("i1", "i2", "n"), keys, strict=True)}, "tokens": pa.array([tok[at[x] : at[x + 1]].tobytes() for x in some], pa.binary())})

    def unite(t: pa.Table) -> pa.Table:
        a = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]))
        return pa.table({"i1": t.column("i1")[:1], "i2": t.column("i2")[:1], "tokens": pa.array([a.tobytes()], pa.binary())})

    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = shared(d, kernel, finish, "i1 long, i2 long, n long, tokens binary", 2 * size // (length - K + 1), spread=4)
    # a text's tokens from all runs that hold a copy or a segment of it; staged, so that its exchanges are gone before texts are exchanged
    tokens = staged(tokens.groupBy("i1", "i2").applyInArrow(unite, "i1 long, i2 long, tokens binary"))
    known = first.join(tokens, ["i1", "i2"], "left").select(F.col("i1").alias("k1"), F.col("i2").alias("k2"), F.col("n").alias("kn"), "first", "tokens")
    d = d.select("doc_id", "text", i1.alias("i1"), i2.alias("i2"), n.alias("n"))
    d = d.join(known, (F.col("i1") == F.col("k1")) & (F.col("i2") == F.col("k2")) & (F.col("n") == F.col("kn")), "left")
    copy, open_ = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)), F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()
    # of copies no text, of the rest with something to compare the text and the tokens
    d = staged(d.select("doc_id", F.col("i1").alias("tie"), F.col("n").alias("n_bytes"), copy.alias("copy"), F.when(~copy, F.col("text")).alias("text"), F.when(~copy & open_, F.col("tokens")).alias("tokens")), done=(tokens,))
    cut = spans(d.where("tokens is not null").select("doc_id", "tie", "text", "tokens", "n_bytes"), length)
    cut = cut.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cut"))
    # merged spans: (lo, hi) pairs, ascending, apart
    fold = F.aggregate(
        "cut", F.expr("struct(array_repeat(struct(0L as lo, 0L as hi), 0) as done, -1L as lo, -1L as hi)"),
        lambda a, x: F.when(x["lo"] <= a["hi"], F.struct(a["done"].alias("done"), a["lo"].alias("lo"), F.greatest(a["hi"], x["hi"]).alias("hi")))
        .otherwise(F.struct(F.when(a["lo"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))).alias("done"), x["lo"].alias("lo"), x["hi"].alias("hi"))),
        lambda a: F.concat(a["done"], F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))),
    )
    cut = cut.select(F.col("doc_id").alias("c_doc"), F.col("tie").alias("c_tie"), fold.alias("cut"))
    some = d.where("tokens is not null").join(cut, (F.col("doc_id") == F.col("c_doc")) & (F.col("tie") == F.col("c_tie")), "left")
    raw = F.encode("text", "UTF-8")
    marks = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))), "cut", F.array(F.struct(F.col("n_bytes").alias("lo"), F.col("n_bytes").alias("hi"))))
    bits = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.substring(F.col("raw"), (F.element_at("m", i)["hi"] + 1).cast("int"), (F.element_at("m", i + 1)["lo"] - F.element_at("m", i)["hi"]).cast("int")))
    some = some.select("doc_id", "n_bytes", "cut", raw.alias("raw"), F.when(F.col("cut").isNotNull(), marks).alias("m"))
    gone = F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]), F.lit(0).cast("long"))
    some = some.select("doc_id", "n_bytes", gone.alias("n_removed"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_spans"), F.when(F.col("cut").isNull(), F.col("raw")).otherwise(F.unhex(F.array_join(F.transform(bits, F.hex), ""))).alias("kept"))
    rest = d.where("tokens is null").select(
        "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.col("copy").cast("long").alias("n_spans"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"),
    )
    return rest.union(some)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
