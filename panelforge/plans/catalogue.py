"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import attribution, dimensions, evaluation, exposure, factor_queries, holding, incremental, kernels, learned, market, panel_queries, ratios, rotation, universe

MODULES = (factor_queries, evaluation, market, panel_queries, kernels, rotation, exposure, learned, holding, dimensions, attribution, incremental, universe, ratios)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
