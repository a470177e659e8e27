"""Every query that has a SQL twin against DuckDB at the smallest scale (a spread of them here; all in the driver)."""

import duckdb
import pandas as pd
import pytest

from panelforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "alpha101_001_010", "alpha101_061_070", "factors_short", "factors_technical", "metric_rank_ic_summary", "metric_ic_decay", "metric_quantile", "metric_quantile_turnover",
    "metric_autocorr", "metric_tail_pair_accuracy", "metric_quality", "metric_factor_stats", "xs_winsor_z", "xs_nlsize", "reg_residual", "store_upsert_coalesce", "clean_sanitize",
    "pit_announcement_asof", "pit_index_members", "universe_mask", "universe_registry", "attr_brinson_fachler", "attr_carino", "crowd_valuation_z", "crowd_pairwise_corr", "crowd_relative_volatility", "pit_ttm_ytd", "style_statement", "strategy_icir", "attr_benchmark_weights", "attr_wealth_link", "kernel_style_returns", "kernel_exposures", "kernel_pure_ic", "kernel_ew_beta", "kernel_alarms", "kernel_log_momentum", "rotation_adaptive_momentum", "rotation_targets", "rotation_unlike", "kernel_ols_residual", "kernel_nonlinear_ic", "stream_event_bars",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or "datetime" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else v)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got, want = canon(catalogue.queries()[name](spark, SF).toPandas()), canon(duck.execute(catalogue.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", ["attr_carino_year", "attr_wealth_link_year"])
def test_linking_covers_every_year(spark, duck, name):
    test_matches_sql(spark, duck, name)
    got = catalogue.queries()[name](spark, SF).toPandas()
    sides = catalogue.queries()["attr_bhb"](spark, SF).toPandas()
    assert set(got["y"]) == {d.year for d in sides["trade_date"]}


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_temperature_reads_the_groups_once(spark, duck):
    test_matches_sql(spark, duck, "crowd_temperature")
    reads = {q: catalogue.queries()[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") for q in ("crowd_temperature", "crowd_dispersion")}
    assert reads["crowd_temperature"] == reads["crowd_dispersion"]


def test_formulas_of_a_symbol_alone_pass_no_exchange_by_date(spark):
    from panelforge.functions import price
    from panelforge.plans.expression import Plan
    from panelforge.sources.panel import dense

    got = catalogue.queries()["factors_extra"](spark, SF)
    pd.testing.assert_frame_equal(canon(got.toPandas()), canon(Plan(price.EXTRA, price.DEFS).long(dense(spark, SF)).toPandas()))
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("l_extendedprice" in line for line in lines)  # the panel is written once
    by_date = [i for i, line in enumerate(lines) if "RepartitionByExpression [trade_date" in line]
    assert len(by_date) == 1 and lines[by_date[0] + 1].count("#") <= 8, lines[by_date[0] + 1]  # before: all of the more than sixty formulas
