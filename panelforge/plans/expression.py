"""Factor expressions: parsed once, planned in window stages, compiled to DataFrames or to SQL.

A formula is a Python expression over panel fields and the operators below.  Equal sub-expressions of all
formulas of a plan are computed once.  Window operators are levelled: symbol windows and recursions (EMA and the like; partition symbol,
order t) and date and group windows take turns, and a turn computes all that nests without the other kind in between.  So the
number of shuffles follows how often the two alternate, not the number of factors nor their depth.

Missing values are null: arithmetic passes them on, comparisons with them are false, division by zero
and logarithms of non-positive numbers give null.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import windows

FIELDS = {"O": "open", "H": "high", "L": "low", "C": "close", "V": "vol", "A": "amount", "R": "ret", "vwap": "vwap", "cap": "mv", "t": "t", "L1": "l1", "L2": "l2", "L3": "l3"}


class Node:
    """Hash-consed expression node."""

    def __init__(self, op: str, args: tuple = (), value=None):
        self.op, self.args, self.value = op, args, value
        self.kind = KINDS.get(op, "p")
        inner = max((a.depth for a in args), default=0)
        self.depth = inner + (self.kind != "p")
        # turn: even ones are of symbol windows, odd ones of date windows; -1 before any
        self.turn = max((a.turn for a in args), default=-1)
        if self.kind != "p":
            across = int(self.kind in "xg")
            self.turn = max(self.turn, across) + (max(self.turn, across) % 2 != across)
        self.name = ""

    def key(self):
        return (self.op, self.value, tuple(id(a) for a in self.args))


# s: window over symbol, x: over date, g: over (date, group), r: recursion over symbol
KINDS = {k: "s" for k in "sum avg sd ts_min ts_max corr cov ts_rank ts_argmax ts_argmin decay product lag lead ma psd pvar rsum rmean rmax rmin rcorr rskew rkurt mad age_max age_min mdd cumsum slope ffill rmedian".split()}
KINDS |= {"rank": "x", "scale": "x", "xmean": "x", "xsum": "x", "rank_desc": "x", "indneu": "g", "ema": "r", "wilder": "r", "dma": "r"}


class Plan:
    """Formulas by name, compiled together."""

    def __init__(self, formulas: dict[str, str], defs: dict[str, str] | None = None):
        self.defs = defs or {}
        self.pool: dict[tuple, Node] = {}
        self.roots = {k: self.parse(v) for k, v in formulas.items()}
        self.levels: dict[int, list[Node]] = {}
        seen: set[int] = set()

        def visit(n: Node):
            if id(n) in seen:
                return
            seen.add(id(n))
            for a in n.args:
                visit(a)
            if n.kind != "p":
                n.name = f"n{sum(map(len, self.levels.values()))}"
                self.levels.setdefault(n.depth, []).append(n)

        for r in self.roots.values():
            visit(r)

    def make(self, op: str, *args: Node, value=None) -> Node:
        n = Node(op, args, value)
        return self.pool.setdefault(n.key(), n)

    def parse(self, text: str) -> Node:
        return self._node(ast.parse(text.replace("^", "**"), mode="eval").body)

    def _number(self, e) -> float:
        return float(ast.literal_eval(e))

    def _node(self, e) -> Node:
        if isinstance(e, ast.Constant):
            return self.make("const", value=None if e.value is None else float(e.value))
        if isinstance(e, ast.Name):
            if e.id == "null":
                return self.make("const", value=None)
            if e.id in self.defs:
                return self.parse(self.defs[e.id])
            return self.make("field", value=FIELDS.get(e.id, e.id))  # other names are columns of the frame
        if isinstance(e, ast.UnaryOp):
            return self.make("not" if isinstance(e.op, (ast.Not, ast.Invert)) else "neg", self._node(e.operand))
        if isinstance(e, ast.BinOp):
            op = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "pow"}[type(e.op)]
            return self.make(op, self._node(e.left), self._node(e.right))
        if isinstance(e, ast.BoolOp):
            out = self._node(e.values[0])
            for v in e.values[1:]:
                out = self.make("and" if isinstance(e.op, ast.And) else "or", out, self._node(v))
            return out
        if isinstance(e, ast.Compare):
            op = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}[type(e.ops[0])]
            return self.make(op, self._node(e.left), self._node(e.comparators[0]))
        f, a = e.func.id, e.args
        if f == "d":
            x = self._node(a[0])
            return self.make("-", x, self.make("lag", x, value=self._window(a[1]) if len(a) > 1 else 1))
        if f == "adv":
            return self.make("avg", self.make("field", value="vol"), value=self._window(a[0]))
        if f in ("emax", "emin"):
            x, y = self._node(a[0]), self._node(a[1])
            return self.make("iff", self.make(">=" if f == "emax" else "<=", x, y), x, y)
        if f == "repl":
            x = self._node(a[0])
            return self.make("iff", self.make("=", x, self._node(a[1])), self._node(a[2]), x)
        if f == "fin":
            return self._node(a[0])
        if f in ("corr", "cov", "rcorr", "dma"):
            return self.make(f, self._node(a[0]), self._node(a[1]), value=self._window(a[2]) if len(a) > 2 else None)
        if f == "indneu":
            return self.make(f, self._node(a[0]), self._node(a[1]))
        if KINDS.get(f) in ("s", "r"):
            return self.make(f, self._node(a[0]), value=self._window(a[1]) if len(a) > 1 else None)
        if f == "scale":
            return self.make(f, self._node(a[0]), value=self._number(a[1]) if len(a) > 1 else 1.0)
        return self.make(f, *(self._node(x) for x in a))

    def _window(self, e) -> int:
        return max(1, round(self._number(e)))

    # ---- DataFrame ----

    def columns(self, panel: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The panel (or ``keep`` of its columns) with one column a formula.

        A step computes the nodes of one depth in a turn by one Arrow kernel (``operators/windows.py``); a turn is one exchange, as its rows
        lie by symbol, or by date, already.  Between steps go only the columns that a later one reads; a formula is computed as soon as its parts are there.
        """
        keep = panel.columns if keep is None else keep
        found: dict[tuple[int, int], list[Node]] = {}
        for depth in sorted(self.levels):
            for n in self.levels[depth]:
                found.setdefault((n.turn, depth), []).append(n)
        steps = [("trade_date" if turn % 2 else "symbol", found[turn, depth]) for turn, depth in sorted(found)]
        reads = [{"symbol", "trade_date", "t"}.union(*(_refs(a) for n in nodes for a in n.args)) for _, nodes in steps]
        waiting = {f"_root{i}": r for i, r in enumerate(self.roots.values())}
        df, done = panel, []
        for i, (key, nodes) in enumerate(steps):
            later = set(keep).union(*reads[i + 1 :], *(_refs(r) for r in waiting.values()))
            kept = [c for c in df.columns if c in later or c in ("symbol", "trade_date", "t") or c in done]
            args = {f"{n.name}_{j}": F.col(_ref(n, j, a)) if a.op == "field" or a.name else _num(a) for n in nodes for j, a in enumerate(n.args)}
            groups = [f"{n.name}_1" for n in nodes if n.op == "indneu"]
            # the numbers travel as one array: Spark measures an Arrow batch column by column with every row it adds
            kinds = dict(df.dtypes)
            plain, doubles = [c for c in kept if kinds[c] != "double"], [c for c in kept if kinds[c] == "double"]
            numbers = {c: F.col(c) for c in doubles} | {k: c.cast("double") for k, c in args.items() if k not in groups}
            df = df.select(*plain, *(args[g].alias(g) for g in groups), F.array(*numbers.values()).alias("_v"))
            spec = [(n.op, n.value, [f"{n.name}_{j}" for j in range(len(n.args))]) for n in nodes]
            made = doubles + [n.name for n in nodes]
            schema = T.StructType([*(df.schema[c] for c in plain), T.StructField("_v", T.ArrayType(T.DoubleType()))])
            if not i or steps[i - 1][0] != key:
                df = df.repartition(key).sortWithinPartitions(*(("symbol", "t") if key == "symbol" else (key,)))
            df = df.mapInArrow(windows.kernel(key, spec, plain, list(numbers), len(doubles)), schema)
            df = df.select(*plain, *(F.get("_v", F.lit(j)).alias(c) for j, c in enumerate(made)))
            # 10 digits: constant windows and exact +-1 must not depend on the order of summation
            rounded = {n.name: F.round(n.name, 10) for n in nodes if n.op in ("corr", "rcorr", "cov")}
            df = df.withColumns(rounded) if rounded else df
            ready = {k: r for k, r in waiting.items() if r.depth and _refs(r) <= set(df.columns)}
            df = df.withColumns({k: _num(r) for k, r in ready.items()}) if ready else df
            waiting = {k: r for k, r in waiting.items() if k not in ready}
            done += ready
        return df.select(*keep, *((F.col(k) if k in done else _num(r)).alias(name) for k, (name, r) in zip((f"_root{i}" for i in range(len(self.roots))), self.roots.items(), strict=True)))

    def long(self, panel: DataFrame, digits: int = 6) -> DataFrame:
        """symbol, trade_date, factor, value (rounded), where the close and the value are present."""
        wide = self.columns(panel, ["symbol", "trade_date", "close"]).where("close is not null")
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.col(k).alias("value")) for k in self.roots))).alias("p")
        out = wide.select("symbol", "trade_date", pairs).select("symbol", "trade_date", "p.factor", clean(F.col("p.value"), digits).alias("value"))
        return out.where("value is not null")

    # ---- SQL ----

    def sql(self, source: str = "panel") -> list[str]:
        """Chain of CTEs from ``source`` to ``factors`` (panel columns and one column a formula)."""
        ctes, last = [], source
        i = 0
        for depth in sorted(self.levels):
            for kind in "srxg":
                nodes = [n for n in self.levels[depth] if n.kind == kind]
                if not nodes:
                    continue
                ready = [f"{_sql_num(a)} AS {n.name}_{j}" for n in nodes for j, a in enumerate(n.args) if a.op != "field" and not a.name]
                ctes.append(f"a{i} AS (SELECT *{''.join(', ' + r for r in ready)} FROM {last})")
                ctes.append(f"b{i} AS (SELECT *, " + ", ".join(f"{_sql_window(n, [_ref(n, j, a) for j, a in enumerate(n.args)])} AS {n.name}" for n in nodes) + f" FROM a{i})")
                last = f"b{i}"
                i += 1
        ctes.append("factors AS (SELECT symbol, trade_date, t, close, " + ", ".join(f"{_sql_num(r)} AS {k}" for k, r in self.roots.items()) + f" FROM {last})")
        return ctes

    def long_sql(self, panel_sql: str, digits: int = 6, source: str = "panel") -> str:
        parts = " UNION ALL ".join(f"SELECT symbol, trade_date, '{k}' AS factor, {sql_clean(k, digits)} AS value FROM factors WHERE close IS NOT NULL" for k in self.roots)
        return f"WITH {panel_sql}, {', '.join(self.sql(source))} SELECT * FROM ({parts}) WHERE value IS NOT NULL"


def clean(c: Column, digits: int = 6) -> Column:
    """Values rounded for comparison: ``digits`` decimals, whole numbers (cut at .63, off the ties of means of cents) beyond 1e5; null from 1e15 on, where nothing but overflow is left."""
    r = lambda d: F.floor(c * 10**d + 0.5) / 10**d + 0.0
    return F.when(F.abs(c) < 1e5, r(digits)).when(F.abs(c) < 1e9, F.floor(c + 0.37)).when(F.abs(c) < 1e15, F.floor(c / 1e4 + 0.5) * 1e4)


def sql_clean(c: str, digits: int = 6) -> str:
    r = lambda d: f"floor({c} * {10**d} + 0.5) / {10**d} + 0.0"
    return f"CASE WHEN abs({c}) < 1e5 THEN {r(digits)} WHEN abs({c}) < 1e9 THEN floor({c} + 0.37) WHEN abs({c}) < 1e15 THEN floor({c} / 1e4 + 0.5) * 1e4 END"


def _refs(n: Node) -> set[str]:
    """Columns that a node is computed from, once its windows are there."""
    if n.name or n.op == "field":
        return {n.name or n.value}
    return set().union(*(_refs(a) for a in n.args))


def _ref(n: Node, j: int, a: Node) -> str:
    return a.value if a.op == "field" else a.name or f"{n.name}_{j}"


_BOOL = {"<", "<=", ">", ">=", "=", "<>", "and", "or", "not", "isnull", "notnull"}


def _num(n: Node) -> Column:
    c = _col(n)
    return c.cast("double") if n.op in _BOOL else c


def _flag(n: Node) -> Column:
    return _col(n) if n.op in _BOOL else F.coalesce(_col(n) != 0, F.lit(False))


def _col(n: Node) -> Column:
    if n.name:
        return F.col(n.name)
    if n.op == "field":
        return F.col(n.value)
    if n.op == "const":
        return F.lit(n.value).cast("double")
    if n.op == "and":
        return _flag(n.args[0]) & _flag(n.args[1])
    if n.op == "or":
        return _flag(n.args[0]) | _flag(n.args[1])
    if n.op == "not":
        return ~_flag(n.args[0])
    if n.op == "iff":
        return F.when(_flag(n.args[0]), _num(n.args[1])).otherwise(_num(n.args[2]))
    a = [_num(x) for x in n.args]
    if n.op in ("isnull", "notnull"):
        return a[0].isNull() if n.op == "isnull" else a[0].isNotNull()
    if n.op in _BOOL:
        x, y = a
        c = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "<>": x != y}[n.op]
        return F.coalesce(c, F.lit(False))
    if n.op == "pow":
        x, y = a
        return F.when(((x < 0) & (y != F.floor(y))) | ((x == 0) & (y < 0)), None).otherwise(F.pow(x, y))
    return {
        "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "neg": lambda x: -x,
        "abs": F.abs, "sign": F.signum, "log": lambda x: F.when(x > 0, F.ln(x)), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "exp": F.exp, "sinh": F.sinh,
        "max2": lambda x, y: F.greatest(x, y), "min2": lambda x, y: F.least(x, y), "coalesce": lambda x, y: F.coalesce(x, y),
        "greatest3": lambda x, y, z: F.greatest(x, y, z),
    }[n.op](*a)


def _sql_num(n: Node) -> str:
    s = _sql(n)
    return f"CAST({s} AS DOUBLE)" if n.op in _BOOL and not n.name else s


def _sql_flag(n: Node) -> str:
    return _sql(n) if n.op in _BOOL else f"coalesce({_sql(n)} <> 0, false)"


def _sql(n: Node) -> str:
    if n.name:
        return n.name
    if n.op == "field":
        return n.value
    if n.op == "const":
        return "CAST(NULL AS DOUBLE)" if n.value is None else f"CAST({n.value!r} AS DOUBLE)"
    if n.op in ("and", "or"):
        return f"({_sql_flag(n.args[0])} {n.op} {_sql_flag(n.args[1])})"
    if n.op == "not":
        return f"(NOT {_sql_flag(n.args[0])})"
    if n.op == "iff":
        return f"(CASE WHEN {_sql_flag(n.args[0])} THEN {_sql_num(n.args[1])} ELSE {_sql_num(n.args[2])} END)"
    a = [_sql_num(x) for x in n.args]
    if n.op in ("isnull", "notnull"):
        return f"({a[0]} IS {'NOT ' if n.op == 'notnull' else ''}NULL)"
    if n.op in _BOOL:
        return f"coalesce({a[0]} {n.op} {a[1]}, false)"
    if n.op == "pow":
        x, y = a
        return f"(CASE WHEN ({x} < 0 AND {y} <> floor({y})) OR ({x} = 0 AND {y} < 0) THEN NULL ELSE pow({x}, {y}) END)"
    if n.op in "+-*":
        return f"({a[0]} {n.op} {a[1]})"
    return {
        "/": "({0} / nullif({1}, 0))", "neg": "(-{0})", "abs": "abs({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "log": "(CASE WHEN {0} > 0 THEN ln({0}) END)",
        "sqrt": "(CASE WHEN {0} >= 0 THEN sqrt({0}) END)", "exp": "exp({0})", "sinh": "sinh({0})", "max2": "greatest({0}, {1})", "min2": "least({0}, {1})",
        "coalesce": "coalesce({0}, {1})", "greatest3": "greatest({0}, {1}, {2})",
    }[n.op].format(*a)


def _sql_window(n: Node, a: list[str]) -> str:
    w, x = n.value, a[0]
    by = "PARTITION BY symbol ORDER BY t"
    o = f"OVER ({by} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" if isinstance(w, int) else ""
    day = "PARTITION BY trade_date"
    full = lambda c, v=x: f"CASE WHEN count({v}) {o} = {w} THEN {c} END"
    if n.op in ("corr", "rcorr", "cov"):
        y = a[1]
        x, y = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
        if n.op == "cov":
            return full(f"round(covar_samp({x}, {y}) {o}, 10)", x)
        den = f"(stddev_samp({x}) {o} * stddev_samp({y}) {o})"
        return full(f"CASE WHEN {den} > 1e-12 * greatest(abs(avg({x}) {o} * avg({y}) {o}), 1e-12) THEN round(covar_samp({x}, {y}) {o} / {den}, 10) END", x)
    if n.op in ("ts_argmax", "ts_argmin"):
        v = f"-{x}" if n.op == "ts_argmin" else x
        return f"CASE WHEN t >= {w - 1} THEN CAST({w} - (max(CASE WHEN {x} IS NOT NULL THEN {{'v': {v}, 'i': -t}} END) {o}).i - t AS DOUBLE) END"
    if n.op in ("age_max", "age_min"):
        v = f"-{x}" if n.op == "age_min" else x
        return full(f"CAST(t - (max(CASE WHEN {x} IS NOT NULL THEN {{'v': {v}, 'i': t}} END) {o}).i AS DOUBLE)")
    if n.op == "ts_rank":
        l = f"list({x}) {o}"
        return f"CASE WHEN {x} IS NOT NULL THEN len(list_filter({l}, lambda v: v < {x})) + (len(list_filter({l}, lambda v: v = {x})) + 1) / 2 END"
    if n.op == "decay":
        l = f"list_filter(list({x}) {o}, lambda v: v IS NOT NULL)"
        return f"CASE WHEN count({x}) {o} = {w} THEN list_sum(list_transform({l}, lambda v, i: v * i)) / {w * (w + 1) / 2} END"
    if n.op == "mad":
        return full(f"list_sum(list_transform(list({x}) {o}, lambda v: abs(v - avg({x}) {o}))) / {w}").replace(f"abs(v - avg({x}) {o})", f"abs(v - (list_sum(list({x}) {o}) / {w}))")
    if n.op == "mdd":
        l = f"list({x}) {o}"
        return full(f"list_max(list_transform({l}, lambda v, i: 1 - v / list_max(({l})[1:i])))")
    if n.op == "slope":
        return full(f"regr_slope({x}, CASE WHEN {x} IS NOT NULL THEN CAST(t AS DOUBLE) END) {o}")
    if n.op == "rskew":
        return full(f"skewness({x}) {o}")
    if n.op == "rkurt":
        return full(f"kurtosis({x}) {o}")
    if n.op == "product":
        return f"CASE WHEN t >= {w - 1} THEN product({x}) {o} END"
    if n.op == "lag":
        return f"lag({x}, {w}) OVER ({by})"
    if n.op == "lead":
        return f"lead({x}, {w}) OVER ({by})"
    if n.op == "cumsum":
        return f"sum(coalesce({x}, 0)) OVER ({by} ROWS UNBOUNDED PRECEDING)"
    if n.op == "ffill":
        return f"last_value({x} IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING)"
    if n.op == "rank":
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({day} ORDER BY {x} NULLS LAST) + count({x}) OVER ({day} ORDER BY {x} NULLS LAST RANGE UNBOUNDED PRECEDING)) / 2 / count({x}) OVER ({day}) END"
    if n.op == "rank_desc":
        return f"CASE WHEN {x} IS NOT NULL THEN 1 - rank() OVER ({day} ORDER BY {x} DESC NULLS LAST) / count({x}) OVER ({day}) END"
    if n.op == "scale":
        return f"{w!r} * {x} / nullif(sum(abs({x})) OVER ({day}), 0)"
    if n.op in ("xmean", "xsum"):
        return f"{'avg' if n.op == 'xmean' else 'sum'}({x}) OVER ({day})"
    if n.op == "indneu":
        return f"CASE WHEN {a[1]} IS NOT NULL THEN {x} - avg({x}) OVER (PARTITION BY trade_date, {a[1]}) END"
    if n.kind == "r":
        alpha = {"ema": f"{2 / ((w or 1) + 1)!r}", "wilder": f"{1 / (w or 1)!r}"}.get(n.op)
        rows = f"OVER ({by} ROWS UNBOUNDED PRECEDING)"
        if n.op == "dma":
            item = f"{{'x': CASE WHEN {a[1]} IS NOT NULL THEN {x} END, 'a': least(greatest({a[1]}, 0), 1)}}"
            l = f"list_filter(list({item}) {rows}, lambda s: s.x IS NOT NULL)"
            return f"list_reduce(list_transform({l}, lambda s: {{'x': s.x, 'a': s.a}}), lambda p, s: {{'x': s.a * s.x + (1 - s.a) * p.x, 'a': s.a}}).x"
        item = f"CASE WHEN {x} IS NOT NULL THEN {{'x': {x}, 't': t}} END"
        l = f"list_filter(list({item}) {rows}, lambda s: s IS NOT NULL)"
        fold = f"list_reduce({l}, lambda p, s: {{'x': (pow(1 - {alpha}, s.t - p.t) * p.x + {alpha} * s.x) / (pow(1 - {alpha}, s.t - p.t) + {alpha}), 't': s.t}}).x"
        return f"CASE WHEN count({x}) {rows} >= {w} THEN {fold} END"
    f = {"sum": "sum", "avg": "avg", "sd": "stddev_samp", "ts_min": "min", "ts_max": "max"}.get(n.op)
    if f:
        return f"{f}({x}) {o}"
    f = {"rsum": "sum", "rmean": "avg", "ma": "avg", "psd": "stddev_pop", "pvar": "var_pop", "rmax": "max", "rmin": "min", "rmedian": "median"}[n.op]
    return full(f"{f}({x}) {o}")
