"""Queries of the factor catalogue: long (symbol, trade_date, factor, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.functions import alpha101, price
from panelforge.plans.expression import Plan
from panelforge.sources.panel import PANEL_SQL, dense
from panelforge.sources.stage import staged

QUERIES: dict = {}
ORACLES: dict = {}


def values(spark: SparkSession, sf_dir: str, formulas: dict[str, str], defs: dict[str, str] | None = None) -> DataFrame:
    """The panel is written once; formulas that compare no symbols don't go through the exchanges by date of those that do."""
    panel = staged(dense(spark, sf_dir))
    across = {k for k, r in Plan(formulas, defs).roots.items() if r.turn > 0}
    parts = [{k: f for k, f in formulas.items() if (k in across) == side} for side in (False, True)]
    first, *rest = (Plan(part, defs).long(panel) for part in parts if part)
    return first.union(rest[0]) if rest else first


def add(name: str, formulas: dict[str, str], defs: dict[str, str] | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: values(spark, sf_dir, formulas, defs)
    ORACLES[name] = Plan(formulas, defs).long_sql(PANEL_SQL)


_names = sorted(alpha101.ALPHAS)
for _i in range(0, len(_names), 10):
    _part = _names[_i : _i + 10] if _i < 90 else _names[_i:]
    if _i < 100:
        add(f"alpha101_{_part[0][-3:]}_{_part[-1][-3:]}", {k: alpha101.ALPHAS[k] for k in _part})
for _family, _formulas in price.FAMILIES.items():
    add(f"factors_{_family}", _formulas, price.DEFS)
