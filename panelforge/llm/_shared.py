"""Which tokens do two or more items of a corpus hold?  Exact counts through compact exchanges.

Items are gathered in runs.  A run sends its sorted 48-bit tokens, delta-coded, once to hash ranges; the ranges
count over all runs and answer each run with its tokens held twice or more.  A token that is frequent inside a
run is sent as one count, not as a list, so no range gathers a hot token.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._stage import shuffles
from ._text import pieces

RUN = 500_000  # tokens of a run
RANGE = 4_000_000  # tokens that a range counts at a time
HOT = 256  # items of a run that make a token frequent there

_SENT = "r int, run long, kind int, n int, a binary, b binary, c binary"
_NAMES = ["r", "run", "kind", "n", "a", "b", "c"]
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


_WIDE = np.uint64((1 << 32) - 1)


def pack(t: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as differences of 4 bytes; wide ones are marked and follow in 8 bytes."""
    d = np.diff(t)
    return t[:1].tobytes() + np.minimum(d, _WIDE).astype(np.uint32).tobytes() + d[d >= _WIDE].tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if n:
        out[0] = np.frombuffer(b, np.uint64, 1)[0]
        out[1:] = np.frombuffer(b, np.uint32, n - 1, 8)
        wide = np.frombuffer(b, np.uint64, offset=8 + 4 * (n - 1)) if len(b) > 8 + 4 * (n - 1) else None
        if wide is not None:
            out[1:][out[1:] == _WIDE] = wide
        np.cumsum(out, out=out)
    return out


def _small(a: np.ndarray) -> bytes:
    return (a.astype(np.uint16) if not len(a) or a.max() < 1 << 16 else a.astype(np.uint32)).tobytes()


def _large(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_KINDS)], _NAMES)


def shared(docs: DataFrame, kernel: Callable, finish: Callable, schema: str, tokens: int = 0, spread: int = 1) -> DataFrame:
    """``kernel(data, off)`` yields for each text (key of three integers, sorted distinct 64-bit tokens); equal keys of a run are one item.

    ``finish(keys, item, token, count)`` gets the items of a run (three arrays) and, sorted by item, count, token, what
    they hold that two or more items of the corpus hold; it returns an Arrow table.  ``tokens``: about how many there are; a
    range gets no more than RANGE of them.  ``spread``: hash ranges a shuffle partition at least.
    """
    ranges = max(spread * shuffles(docs.sparkSession), tokens // RANGE)

    def send(batches):
        seen: dict[tuple, int] = {}
        held = np.empty(RUN * 5 // 4, np.uint64)  # one block, so that small arrays don't pin freed memory between large ones
        sizes: list[int] = []
        size = turn = 0
        task = TaskContext.get().partitionId()

        def flush():
            nonlocal seen, sizes, size, turn
            run = (task << 32) | turn
            tok = held[:size]
            own = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            o = np.argsort(tok, kind="stable")
            tok, own = tok[o], own[o]
            edge = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True])))
            count = np.diff(edge)
            hot = np.repeat(count >= HOT, count)
            keys = np.array(list(seen), np.int64)
            pass_by = ranges + run % ranges
            rows = [(pass_by, run, 0, len(keys), *(keys[:, j].tobytes() for j in range(3)))]
            if hot.any():
                rows.append((pass_by, run, 1, int(hot.sum()), tok[hot].tobytes(), own[hot].astype(np.uint32).tobytes(), None))
            width = np.uint64((1 << 48) // ranges + 1)
            heads, hn = tok[edge[:-1]][count >= HOT], count[count >= HOT]
            tok, own = tok[~hot], own[~hot]
            cuts = np.arange(ranges + 1).astype(np.uint64)
            at, hat = np.searchsorted(tok // width, cuts), np.searchsorted(heads // width, cuts)
            for r in range(ranges):
                t, h = slice(at[r], at[r + 1]), slice(hat[r], hat[r + 1])
                if t.stop > t.start:
                    rows.append((r, run, 2, int(t.stop - t.start), pack(tok[t]), _small(own[t]), None))
                if h.stop > h.start:
                    rows.append((r, run, 3, int(h.stop - h.start), heads[h].tobytes(), hn[h].astype(np.int64).tobytes(), None))
            seen, sizes, size, turn = {}, [], 0, turn + 1
            return _batch(rows)

        for batch in batches:
            for _, data, off in pieces(batch):
                for key, s in kernel(data, off):
                    if len(s) and key not in seen:
                        seen[key] = len(sizes)
                        if size + len(s) > len(held):
                            held = np.concatenate((held[:size], np.empty(len(s) + RUN // 4, np.uint64)))
                        np.right_shift(s, np.uint64(16), out=held[size : size + len(s)])
                        sizes.append(len(s))
                        size += len(s)
                        if size >= RUN:
                            yield flush()
        if sizes:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [tuple(r[c] for c in _NAMES) for r in rows if r["kind"] < 2]
        lists = [(r["run"], unpack(r["a"], r["n"]), _large(r["b"], r["n"])) for r in rows if r["kind"] == 2]
        heads = [(r["run"], np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.int64)) for r in rows if r["kind"] == 3]
        if lists or heads:
            tok = np.concatenate([x[1] for x in lists] + [x[1] for x in heads])
            num = np.concatenate([np.ones(len(x[1]), np.int64) for x in lists] + [x[2] for x in heads])
            o = np.argsort(tok, kind="stable")
            s = tok[o]
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            df = np.empty(len(tok), np.int64)
            df[o] = np.repeat(np.add.reduceat(num[o], edge), np.diff(np.append(edge, len(s))))
            at = 0
            for run, a, own in lists:
                d = df[at : at + len(a)]
                at += len(a)
                if (d > 1).any():
                    out.append((0, run, 2, int((d > 1).sum()), a[d > 1].tobytes(), own[d > 1].astype(np.uint32).tobytes(), d[d > 1].tobytes()))
            for run, a, _ in heads:
                out.append((0, run, 3, len(a), a.tobytes(), df[at : at + len(a)].tobytes(), None))
                at += len(a)
        return pa.Table.from_batches([_batch(out)])

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [np.frombuffer(next(r[c] for r in rows if r["kind"] == 0), np.int64) for c in "abc"]
        heads = sorted((int(x), int(y)) for r in rows if r["kind"] == 3 for x, y in zip(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.int64), strict=True))
        hk, hv = np.array([h[0] for h in heads], np.uint64), np.array([h[1] for h in heads], np.int64)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        parts += [(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32).astype(np.int64), np.frombuffer(r["c"], np.int64)) for r in rows if r["kind"] == 2]
        for r in rows:
            if r["kind"] == 1:
                a = np.frombuffer(r["a"], np.uint64)
                parts.append((a, np.frombuffer(r["b"], np.uint32).astype(np.int64), hv[np.searchsorted(hk, a)]))
        tok, own, df = (np.concatenate([p[j] for p in parts]) for j in range(3))
        o = np.lexsort((tok, df, own))
        return finish(keys, own[o], tok[o], df[o])

    sent = docs.select("text").mapInArrow(send, _SENT)
    return sent.groupBy("r").applyInArrow(count, _SENT).groupBy("run").applyInArrow(answer, schema)
