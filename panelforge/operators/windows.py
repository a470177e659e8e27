"""Window operators of a plan's level over Arrow batches of whole symbols or whole dates.

Spark deals the rows by symbol (in order of ``t``) or by date; a batch of many symbols is computed column by column, one step of the window
after the other, oldest row first.  Sums, means and moments are updated as Spark's own aggregates do it, so their digits are the same; a Spark window
builds every frame anew, row by row and aggregate by aggregate.  A column is a pair (values, present); NaN is a value, greater than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH = 10_000


def _new(keys) -> np.ndarray:
    """True where a key differs from the one before it."""
    a, b = keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    differs = pc.and_not(pc.fill_null(pc.not_equal(a, b), True), both)
    return np.concatenate([[True], np.asarray(differs)])[: len(keys)]


def whole(batches, key: str):
    """Tables of whole keys from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        starts = _new(k)
        starts[0] = bool(held) and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0].as_py()
        cuts = np.flatnonzero(starts)
        if len(cuts):
            held.append(b.slice(0, cuts[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [b.slice(cuts[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Chunk:
    """A table of whole keys; its numbers lie row by row in the list column ``_v``."""

    def __init__(self, table: pa.Table, key: str, numbers: list[str]):
        self.table, self.n = table, table.num_rows
        flat = table.column("_v").combine_chunks().flatten()
        shape = (self.n, len(numbers))
        self.place = {c: j for j, c in enumerate(numbers)}
        self.values = np.ascontiguousarray(np.asarray(pc.fill_null(flat, 0.0)).reshape(shape).T)
        self.known = np.ascontiguousarray(np.asarray(pc.is_valid(flat)).reshape(shape).T)
        self.starts = np.flatnonzero(_new(self.column(key)))

    def column(self, name: str) -> pa.Array:
        return self.table.column(name).combine_chunks()

    def pair(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return self.values[self.place[name]], self.known[self.place[name]]


def kernel(key: str, nodes: list[tuple], plain: list[str], numbers: list[str], passed: int):
    """Function for ``mapInArrow``: columns ``plain`` and, as ``_v``, the first ``passed`` numbers and one a node (op, window, arguments)."""
    compute = _along if key == "symbol" else _across

    def run(batches):
        for table in whole(batches, key):
            chunk = _Chunk(table, key, numbers)
            with np.errstate(all="ignore"):
                made = list(compute(chunk, nodes))
            width = passed + len(made)
            v, ok = np.empty((chunk.n, width)), np.empty((chunk.n, width), bool)
            v[:, :passed], ok[:, :passed] = chunk.values[:passed].T, chunk.known[:passed].T
            for j, (x, here) in enumerate(made, passed):
                v[:, j], ok[:, j] = x, here
            for i in range(0, chunk.n, BATCH):
                part = pa.array(v[i : i + BATCH].ravel(), mask=~ok[i : i + BATCH].ravel())
                rows = len(part) // width
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), part)
                yield pa.RecordBatch.from_arrays([*(chunk.column(c).slice(i, rows) for c in plain), lists], names=[*plain, "_v"])

    return run


# ---- over the rows of a symbol ----


class _Rows:
    """Rows of some symbols, one after the other: ``pos`` is a row's place in its symbol."""

    def __init__(self, starts: np.ndarray, n: int):
        self.n, self.starts = n, starts
        self.lengths = np.diff(np.append(starts, n))
        self.pos = np.arange(n) - np.repeat(starts, self.lengths)
        self.longest = int(self.lengths.max())

    def frames(self, w: int):
        """(rows, the row k before each, whether it is in the frame), the oldest first."""
        for k in range(min(w, self.longest) - 1, -1, -1):
            yield slice(k, self.n), slice(0, self.n - k), self.pos[k:] >= k

    def shifted(self, x, ok, k: int):
        """``x`` of k rows before (after, where negative)."""
        v, here = np.zeros(self.n), np.zeros(self.n, bool)
        if abs(k) < self.longest and k >= 0:
            v[k:], here[k:] = x[: self.n - k], ok[: self.n - k] & (self.pos[k:] >= k)
        elif abs(k) < self.longest:
            left = np.repeat(self.lengths, self.lengths) - self.pos  # rows from here to the end
            v[:k], here[:k] = x[-k:], ok[-k:] & (left[:k] > -k)
        return v, here

    def full(self, ok: np.ndarray, w: int) -> np.ndarray:
        """Whether the frame of w rows is there and without a missing value."""
        seen = np.concatenate([[0], np.cumsum(ok)])
        out = self.pos >= w - 1
        out[w - 1 :] &= (seen[w:] - seen[: max(self.n - w + 1, 0)]) == w
        return out

    def steps(self):
        """Indices of the first rows of all symbols, of the second rows, ..."""
        for p in range(self.longest):
            alive = self.lengths > p
            yield alive, self.starts[alive] + p


class _Full:
    """Steps over the frames of w rows that end at rows w - 1, w, ...; a result is for frames without a missing value only."""

    def __init__(self, rows: _Rows, w: int):
        self.rows, self.w, self.m = rows, w, max(rows.n - w + 1, 0)

    def parts(self, x: np.ndarray):
        return (x[j : j + self.m] for j in range(self.w))

    def total(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.m)
        for v in self.parts(x):
            out += v
        return out

    def moments(self, x: np.ndarray, order: int = 2) -> list[np.ndarray]:
        mean, m2, m3, m4 = (np.zeros(self.m) for _ in range(4))
        for j, v in enumerate(self.parts(x)):
            delta = v - mean
            part = delta / (j + 1.0)
            mean = mean + part
            m2 = m2 + delta * (delta - part)
            if order >= 3:
                square, part2 = delta * delta, part * part
                m3 = m3 - 3.0 * part * m2 + delta * (square - part2)
                if order >= 4:
                    m4 = m4 - 4.0 * part * m3 - 6.0 * part2 * m2 + delta * (delta * square - part * part2)
        return [m2, m3, m4]

    def comoment(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mx, my, c = (np.zeros(self.m) for _ in range(3))
        for j, (a, b) in enumerate(zip(self.parts(x), self.parts(y), strict=True)):
            dx = a - mx
            mx = mx + dx / (j + 1.0)
            my = my + (b - my) / (j + 1.0)
            c = c + dx * (b - my)
        return c

    def place(self, v: np.ndarray) -> np.ndarray:
        """Back on the rows; the first w - 1 have no frame."""
        return np.concatenate([np.zeros(min(self.w - 1, self.rows.n)), v])


def _less(a, b):
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _same(a, b):
    return (a == b) | (np.isnan(a) & np.isnan(b))


def _extreme(rows: _Rows, x, ok, t, w: int, newest: bool):
    """(t of the greatest value of the frame, whether there is one); of equal ones the oldest or the newest."""
    best, at, any_ = np.zeros(rows.n), np.zeros(rows.n), np.zeros(rows.n, bool)
    for to, src, inside in rows.frames(w):
        v = x[src]
        better = ~_less(v, best[to]) if newest else _less(best[to], v)
        take = inside & ok[src] & (~any_[to] | better)
        best[to], at[to] = np.where(take, v, best[to]), np.where(take, t[src], at[to])
        any_[to] |= take
    return at, any_


def _masked_moments(rows: _Rows, x, ok, w: int):
    n, mean, m2 = (np.zeros(rows.n) for _ in range(3))
    for to, src, inside in rows.frames(w):
        use = inside & ok[src]
        delta = x[src] - mean[to]
        part = delta / (n[to] + 1.0)
        mean[to], m2[to] = np.where(use, mean[to] + part, mean[to]), np.where(use, m2[to] + delta * (delta - part), m2[to])
        n[to] += use
    return n, m2


def _total(rows: _Rows, x, ok, w: int):
    out, n = np.zeros(rows.n), np.zeros(rows.n)
    for to, src, inside in rows.frames(w):
        use = inside & ok[src]
        out[to] += np.where(use, x[src], 0.0)
        n[to] += use
    return out, n


def _fold(rows: _Rows, x, ok, w: int, start: float, step):
    out, any_ = np.full(rows.n, start), np.zeros(rows.n, bool)
    for to, src, inside in rows.frames(w):
        use = inside & ok[src]
        out[to] = np.where(use, step(out[to], x[src]), out[to])
        any_[to] |= use
    return out, any_


def _recursion(rows: _Rows, op: str, w: int, x, ok, a=None):
    """Smoothing by a weight of the window (missing rows age what was there), or by one a row (``dma``)."""
    ok = ok & ~np.isnan(x)
    out, have = np.zeros(rows.n), np.zeros(rows.n, bool)
    many = len(rows.starts)
    state, began, seen, age = np.zeros(many), np.zeros(many, bool), np.zeros(many), np.ones(many)
    if op != "dma":
        alpha = 2 / (w + 1) if op == "ema" else 1 / w
        alpha = 1 / (1 + (1 - alpha) / alpha)
    for alive, i in rows.steps():
        v, here, s = x[i], ok[i], state[alive]
        if op == "dma":
            weight = np.clip(a[0][i], 0, 1)
            here = here & a[1][i] & np.isfinite(v) & np.isfinite(weight)
            new = weight * v + (1 - weight) * s
        else:
            aged = age[alive] * (1 - alpha)
            new = np.where(s != v, (aged * s + alpha * v) / (aged + alpha), s)
            age[alive] = np.where(here, 1.0, np.where(began[alive], aged, 1.0))
        state[alive] = np.where(here, np.where(began[alive], new, v), s)
        began[alive] |= here
        seen[alive] += here
        out[i], have[i] = state[alive], began[alive] & (seen[alive] >= (1 if op == "dma" else w))
    return out, have & ~np.isnan(out)


def _along(chunk: _Chunk, nodes: list[tuple]):
    rows = _Rows(chunk.starts, chunk.n)
    t = np.asarray(chunk.column("t").cast(pa.float64()))
    for op, w, args in nodes:
        yield _node(rows, op, w, t, [chunk.pair(a) for a in args])


def _node(rows: _Rows, op: str, w, t: np.ndarray, args: list):
    x, ok = args[0]
    if op in ("ema", "wilder", "dma"):
        return _recursion(rows, op, w, x, ok, args[1] if len(args) > 1 else None)
    if op in ("lag", "lead"):
        return rows.shifted(x, ok, w if op == "lag" else -w)
    if op == "cumsum":
        out, run = np.zeros(rows.n), np.zeros(len(starts := rows.starts))
        for alive, i in rows.steps():
            run[alive] += np.where(ok[i], x[i], 0.0)
            out[i] = run[alive]
        return out, np.ones(rows.n, bool) if len(starts) else ok
    if op == "ffill":
        last = np.maximum.accumulate(np.where(ok, np.arange(rows.n), -1))
        have = last >= np.arange(rows.n) - rows.pos
        return np.where(have, x[last], 0.0), have
    if op in ("sum", "avg"):
        s, n = _total(rows, x, ok, w)
        return (s if op == "sum" else s / n), n > 0
    if op == "sd":
        n, m2 = _masked_moments(rows, x, ok, w)
        return np.sqrt(m2 / (n - 1.0)), n > 1
    if op == "ts_min":
        return _fold(rows, x, ok, w, np.nan, np.fmin)
    if op == "ts_max":
        return _fold(rows, x, ok, w, -np.inf, np.maximum)
    if op == "product":
        v, any_ = _fold(rows, x, ok, w, 1.0, np.multiply)
        return v, any_ & (t >= w - 1)
    if op == "ts_rank":
        less, same = np.zeros(rows.n), np.zeros(rows.n)
        for to, src, inside in rows.frames(w):
            use = inside & ok[src]
            less[to] += use & _less(x[src], x[to])
            same[to] += use & _same(x[src], x[to])
        return less + (same + 1) / 2, ok
    if op in ("ts_argmax", "ts_argmin"):
        at, any_ = _extreme(rows, -x if op == "ts_argmin" else x, ok, t, w, False)
        return w + at - t, any_ & (t >= w - 1)
    return _full_node(rows, op, w, t, args)


def _full_node(rows: _Rows, op: str, w: int, t: np.ndarray, args: list):
    """Operators that need every value of the frame."""
    (x, ok), f = args[0], _Full(rows, w)
    if len(args) > 1:
        ok = ok & args[1][1]
    have = rows.full(ok, w)
    if op in ("age_max", "age_min"):
        at, _ = _extreme(rows, -x if op == "age_min" else x, ok, t, w, True)
        return t - at, have
    if not have.any():
        return np.zeros(rows.n), have
    good = np.ones(f.m, bool)
    if op in ("corr", "rcorr", "cov"):
        y = args[1][0]
        v = f.comoment(x, y) / (w - 1.0)
        if op != "cov":
            den = np.sqrt(f.moments(x)[0] / (w - 1.0)) * np.sqrt(f.moments(y)[0] / (w - 1.0))
            floor = 1e-12 * np.maximum(np.abs((f.total(x) / w) * (f.total(y) / w)), 1e-12)
            v, good = v / den, _less(floor, den)
        good &= w > 1
    elif op == "decay":
        v = np.zeros(f.m)
        for j, part in enumerate(f.parts(x)):
            v += part * float(j + 1)
        v /= w * (w + 1) / 2
    elif op == "mad":
        mean, v = f.total(x) / w, np.zeros(f.m)
        for part in f.parts(x):
            v += np.abs(part - mean)
        v /= w
    elif op == "mdd":
        peak, v = np.zeros(f.m), np.zeros(f.m)
        for part in f.parts(x):
            peak = np.maximum(peak, part)
            v = np.maximum(v, 1 - part / peak)
    elif op == "slope":
        m2 = f.moments(t)[0]
        v, good = f.comoment(t, x) / m2, m2 != 0
    elif op in ("rskew", "rkurt"):
        m2, m3, m4 = f.moments(x, 3 if op == "rskew" else 4)
        n, good = float(w), m2 != 0
        if op == "rskew":
            v = np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2) * np.sqrt(n * (n - 1)) / (n - 2)
        else:
            v = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3.0) + 6)
    elif op == "rmedian":
        at = np.sort(np.stack(list(f.parts(x))), axis=0)
        lo, hi = at[(w - 1) // 2], at[w // 2]
        v = lo if w % 2 else 0.5 * lo + 0.5 * hi
    elif op in ("rmax", "rmin"):
        v = np.full(f.m, -np.inf if op == "rmax" else np.nan)
        for part in f.parts(x):
            v = np.maximum(v, part) if op == "rmax" else np.fmin(v, part)
    elif op in ("psd", "pvar"):
        v = f.moments(x)[0] / w
        v = np.sqrt(v) if op == "psd" else v
    else:
        v = f.total(x)
        v = v if op == "rsum" else v / w  # rmean, ma
    have[w - 1 :] &= good
    return f.place(v), have


# ---- over the symbols of a date ----


def _across(chunk: _Chunk, nodes: list[tuple]):
    n, starts = chunk.n, chunk.starts
    ends = np.append(starts, n)
    day = np.repeat(np.arange(len(starts)), np.diff(ends))
    for op, w, args in nodes:
        x, ok = chunk.pair(args[0])
        if op in ("rank", "rank_desc"):
            out = np.zeros(n)
            for a, b in zip(ends, ends[1:], strict=False):
                here = ok[a:b]
                v = x[a:b][here]
                order = np.sort(v)
                below, upto = np.searchsorted(order, v, "left"), np.searchsorted(order, v, "right")
                out[a:b][here] = (1 + below + upto) / 2 / len(v) if op == "rank" else 1 - (1 + len(v) - upto) / len(v)
            yield out, ok
            continue
        part, many = day, len(starts)
        if op == "indneu":
            g = pc.dictionary_encode(chunk.column(args[1]), null_encoding="encode")
            known = np.asarray(pc.is_valid(chunk.column(args[1])))
            part, many = day * len(g.dictionary) + np.asarray(g.indices), many * len(g.dictionary)
        v = np.where(ok, np.abs(x) if op == "scale" else x, 0.0)
        total, count = np.bincount(part, v, many)[part], np.bincount(part, ok, many)[part]
        if op == "scale":
            yield w * x / total, ok & (total != 0)
        elif op == "indneu":
            yield x - total / count, ok & known
        else:
            yield (total / count if op == "xmean" else total), count > 0
