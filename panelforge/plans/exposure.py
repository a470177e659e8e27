"""Queries of the exposure engine.  Their SQL is written apart: joined aggregates for the standardisation and successive projection in place of Gram matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import exposure, rotation
from panelforge.plans.evaluation import R, frame, frame_sql
from panelforge.plans.rotation import _POINTS
from panelforge.sources.panel import dense
from panelforge.sources.stage import discard, staged

STYLES = {"size": "s_size", "momentum": "s_mom", "volatility": "s_vol"}
COLUMNS = [*STYLES, "nlsize"]
INDUSTRY = "l1"


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation frame with standardised styles, written once; the universe is every symbol with a value that day."""
    ev = staged(frame(spark, sf_dir).select("symbol", "trade_date", "t", "l1", "mv", *STYLES.values(), "factor", "f", "r"))
    day = ev.where("factor = 'mom_5'").select("symbol", "trade_date", "mv", *STYLES.values())  # the styles are the same beside every factor
    z = exposure.standardise(day, STYLES, "size", F.col("mv").isNotNull())
    out = staged(ev.drop(*STYLES.values()).join(z.select("symbol", "trade_date", *COLUMNS, "cap"), ["symbol", "trade_date"]))
    discard(ev)
    return out


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.expr(R(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def one_factor(ev: DataFrame) -> DataFrame:
    return ev.where("factor = 'mom_5'")


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = one_factor(standardised(spark, sf_dir)).select("symbol", "trade_date", *COLUMNS)
    return rounded(z.where("size is not null"), *COLUMNS)


def betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = standardised(spark, sf_dir)
    fit = exposure.Regression(ev, "f", COLUMNS, ["trade_date", "factor"], INDUSTRY, exposure.industries(one_factor(ev), INDUSTRY), scaled=True)
    return rounded(fit.coefficients(), "beta")


def pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = standardised(spark, sf_dir)
    fit = exposure.Regression(ev, "f", COLUMNS, ["trade_date", "factor"], INDUSTRY, exposure.industries(one_factor(ev), INDUSTRY), scaled=True)
    return rounded(fit.residuals(), "resid")


def _returns(spark: SparkSession, sf_dir: str) -> exposure.Regression:
    ev = one_factor(standardised(spark, sf_dir))
    return exposure.Regression(ev, "r", COLUMNS, ["trade_date"], INDUSTRY, exposure.industries(ev, INDUSTRY), weight="cap")


def style_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_returns(spark, sf_dir).coefficients(), "beta")


def specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_returns(spark, sf_dir).residuals(), "resid")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = standardised(spark, sf_dir)
    daily = exposure.attribution(ev, "f", "r", COLUMNS, INDUSTRY, exposure.industries(one_factor(ev), INDUSTRY))
    return rounded(exposure.attribution_over_time(daily, 12), "f_k", "beta", "attr", "cum_attr", "cum_f", "ma_f")


def attribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = standardised(spark, sf_dir)
    daily = exposure.attribution(ev, "f", "r", COLUMNS, INDUSTRY, exposure.industries(one_factor(ev), INDUSTRY))
    return rounded(exposure.attribution_summary(daily), "mean_attr", "cum_attr", "mean_f", "residual_share")


def neutral_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = standardised(spark, sf_dir).withColumn("in_universe", F.col("mv").isNotNull() & F.col("l1").isNotNull())
    out = exposure.neutralised(ev.select("trade_date", "factor", "symbol", "in_universe", "f", *COLUMNS), "f", COLUMNS, ["trade_date", "factor"])
    return rounded(out.where("f is not null").select("trade_date", "factor", "symbol", "f"), "f")


def momentum_resid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted log momentum of 25 sessions, its part outside the styles."""
    p = dense(spark, sf_dir).select("symbol", "t", "trade_date", "close")
    score = rotation.log_momentum(p, year=12).select("symbol", "t", F.col("score").alias("f"))
    z = one_factor(standardised(spark, sf_dir)).select("symbol", "t", "trade_date", *COLUMNS)
    fit = exposure.Regression(z.join(score, ["symbol", "t"]), "f", COLUMNS, ["trade_date"], scaled=True, least=max(exposure.LEAST, len(COLUMNS) + 8))
    return rounded(fit.residuals(), "resid")


def _moments(cols: list[str], weighted: bool) -> str:
    mean = lambda c: f"sum(cap * {c}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN cap END), 0)" if weighted else f"avg({c})"
    return ", ".join(f"{mean(c)} AS a_{c}, stddev_pop({c}) AS d_{c}, count({c}) AS n_{c}" for c in cols)


def _standard_sql() -> str:
    names = list(STYLES)
    good = lambda c: f"n_{c} >= {exposure.LEAST} AND d_{c} > 1e-12"
    z = lambda c: f"CASE WHEN {good(c)} THEN ({c} - a_{c}) / d_{c} END AS {c}"
    cut = lambda c: f"CASE WHEN {c} IS NOT NULL AND {good(c)} THEN least(greatest({c}, a_{c} - {exposure.SIGMA}e0 * d_{c}), a_{c} + {exposure.SIGMA}e0 * d_{c}) ELSE {c} END AS {c}"
    return f"""z0 AS (SELECT symbol, trade_date, {", ".join(f"CASE WHEN mv IS NOT NULL THEN {c} END AS {s}" for s, c in STYLES.items())} FROM ev WHERE factor = 'mom_5'),
  z1 AS (SELECT trade_date, {_moments(names, False)} FROM z0 GROUP BY trade_date),
  z2 AS (SELECT symbol, trade_date, CASE WHEN size IS NOT NULL THEN exp(greatest(least(size, 40e0), -40e0)) END AS cap, {", ".join(cut(c) for c in names)} FROM z0 JOIN z1 USING (trade_date)),
  z3 AS (SELECT trade_date, {_moments(names, True)} FROM z2 GROUP BY trade_date),
  z4 AS (SELECT symbol, trade_date, cap, {", ".join(z(c) for c in names)} FROM z2 JOIN z3 USING (trade_date)),
  z5 AS (SELECT trade_date, sum(cap * size) / sum(cap) AS mx, sum(cap * pow(size, 3)) / sum(cap) AS my FROM z4 WHERE size IS NOT NULL GROUP BY trade_date),
  z6 AS (SELECT trade_date, any_value(mx) AS mx, any_value(my) AS my, sum(cap * (size - mx) * (pow(size, 3) - my)) / nullif(sum(cap * (size - mx) * (size - mx)), 0) AS b FROM z4 JOIN z5 USING (trade_date) WHERE size IS NOT NULL GROUP BY trade_date),
  z7 AS (SELECT z4.*, pow(size, 3) - my - b * (size - mx) AS nlsize FROM z4 LEFT JOIN z6 USING (trade_date)),
  z8 AS (SELECT trade_date, {_moments(["nlsize"], True)} FROM z7 GROUP BY trade_date),
  z9 AS (SELECT symbol, trade_date, cap, {", ".join(names)}, {z("nlsize")} FROM z7 JOIN z8 USING (trade_date)),
  es AS (SELECT ev.*, {", ".join(f"z9.{c}" for c in COLUMNS)}, z9.cap FROM ev JOIN z9 ON z9.symbol = ev.symbol AND z9.trade_date = ev.trade_date),
  od AS (SELECT {INDUSTRY} AS g, row_number() OVER (ORDER BY count(*) DESC, {INDUSTRY}) AS o FROM ev WHERE factor = 'mom_5' AND {INDUSTRY} IS NOT NULL GROUP BY {INDUSTRY})"""


def _project_sql(p: str, src: str, y: str, keys: str, group: str = "0", weight: str = "1e0", scaled: bool = False, least: int = exposure.LEAST) -> str:
    """Tables ``p`` + digits; the last, ``p``, has the residual e, coefficients b0.. and block means of every row: one column after the other is projected out."""
    k = len(COLUMNS)
    x = [f"x{i}" for i in range(k)]
    missing = " AND ".join(f"{c} IS NOT NULL" for c in (y, group, weight, *COLUMNS))
    out = [f"{p}0 AS (SELECT {keys}, symbol, {group} AS g, {weight} AS w, {y} AS y, {', '.join(f'{c} AS {n}' for c, n in zip(COLUMNS, x, strict=True))} FROM {src} WHERE {missing})"]
    out.append(f"{p}1 AS (SELECT *, count(*) OVER v AS n, avg(y) OVER v AS ay, stddev_pop(y) OVER v AS sy FROM {p}0 WINDOW v AS (PARTITION BY {keys}))")
    new = f"(y - ay) / sy AS y FROM {p}1 WHERE n >= {least} AND sy > 1e-12" if scaled else f"y FROM {p}1 WHERE n >= {least}"
    out.append(f"{p}2 AS (SELECT {keys}, symbol, g, w, {', '.join(x)}, {new})")
    out.append(f"{p}3 AS (SELECT {keys}, g, {', '.join(f'sum(w * {c}) / sum(w) AS m{c}' for c in ('y', *x))} FROM {p}2 GROUP BY {keys}, g)")
    out.append(f"{p}4 AS (SELECT {keys}, symbol, g, w, my, {', '.join(f'm{c}' for c in x)}, {', '.join(f'{c} - m{c} AS {c}' for c in ('y', *x))} FROM {p}2 JOIN {p}3 USING ({keys}, g))")
    last = f"{p}4"
    for j in range(k):
        later = ["y", *x[j + 1 :]]
        rate = ", ".join(f"sum(w * {c} * x{j}) OVER v / nullif(sum(w * x{j} * x{j}) OVER v, 0) AS r{j}{c}" for c in later)
        out.append(f"{p}r{j} AS (SELECT *, {rate} FROM {last} WINDOW v AS (PARTITION BY {keys}))")
        out.append(f"{p}s{j} AS (SELECT * REPLACE ({', '.join(f'{c} - r{j}{c} * x{j} AS {c}' for c in later)}) FROM {p}r{j})")
        last = f"{p}s{j}"
    for j in reversed(range(k)):
        rest = "".join(f" - r{j}x{i} * b{i}" for i in range(j + 1, k))
        out.append(f"{p}b{j} AS (SELECT *, r{j}y{rest} AS b{j} FROM {last})")
        last = f"{p}b{j}"
    level = "my" + "".join(f" - b{i} * mx{i}" for i in range(k))
    out.append(f"{p} AS (SELECT *, y AS e, {level} AS a FROM {last})")
    return ",\n  ".join(out)


def _coefficients_sql(p: str, keys: str) -> str:
    """Table ``p``c (keys, name, beta) from ``p``."""
    styles_ = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS name, any_value(b{i}) AS beta FROM {p} GROUP BY {keys}" for i, c in enumerate(COLUMNS))
    on = " AND ".join(f"l.{c.strip()} = h.{c.strip()}" for c in keys.split(","))
    return f"""{p}l AS (SELECT {keys}, g, any_value(a) AS a, any_value(o) AS o FROM {p} JOIN od USING (g) GROUP BY {keys}, g),
  {p}h AS (SELECT {keys}, arg_min(a, o) AS a0, arg_min(g, o) AS g0 FROM {p}l GROUP BY {keys}),
  {p}c AS ({styles_} UNION ALL SELECT {keys}, 'intercept', a0 FROM {p}h
    UNION ALL SELECT {", ".join(f"h.{c.strip()}" for c in keys.split(","))}, 'ind_' || od.g, coalesce(l.a - h.a0, 0) FROM {p}h h JOIN od ON od.g <> h.g0 LEFT JOIN {p}l l ON {on} AND l.g = od.g)"""


_DF = "trade_date, factor"
_ES = f"WITH {frame_sql()}, {_standard_sql()}"
_BETA = f"{_ES}, {_project_sql('p', 'es', 'f', _DF, INDUSTRY, scaled=True)}"
_RET = f"{_ES}, eo AS (SELECT * FROM es WHERE factor = 'mom_5'), {_project_sql('q', 'eo', 'r', 'trade_date', INDUSTRY, 'cap')}"
_ATTR = f"""{_BETA}, {_coefficients_sql('p', _DF)}, eo AS (SELECT * FROM es WHERE factor = 'mom_5'), {_project_sql('q', 'eo', 'r', 'trade_date', INDUSTRY)}, {_coefficients_sql('q', 'trade_date')},
  sl AS (SELECT {_DF}, covar_pop(f, r) / stddev_pop(f) AS lam FROM es WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY {_DF} HAVING count(*) >= {exposure.LEAST} AND stddev_pop(f) > 1e-12),
  lg AS (SELECT pc.trade_date, pc.factor, name, qc.beta AS f_k, pc.beta, pc.beta * qc.beta AS attr FROM pc JOIN qc USING (trade_date, name) WHERE name <> 'intercept'),
  tt AS (SELECT {_DF}, sum(attr) AS explained, sum(attr) FILTER (name LIKE 'ind\\_%' ESCAPE '\\') AS ind FROM lg GROUP BY {_DF}),
  dl AS (SELECT * FROM lg UNION ALL SELECT {_DF}, 'factor_return', NULL, NULL, lam FROM sl
    UNION ALL SELECT {_DF}, 'explained', NULL, NULL, explained FROM sl JOIN tt USING ({_DF}) UNION ALL SELECT {_DF}, 'attr_industry', NULL, NULL, ind FROM sl JOIN tt USING ({_DF})
    UNION ALL SELECT {_DF}, 'residual', NULL, NULL, lam - explained FROM sl JOIN tt USING ({_DF}))"""
QUERIES = {
    "exposure_styles": styles, "exposure_betas": betas, "exposure_pure": pure, "exposure_style_returns": style_returns, "exposure_specific": specific,
    "metric_attribution": attribution, "metric_attribution_summary": attribution_summary, "strategy_neutral_score": neutral_score, "factor_momentum_resid": momentum_resid,
}
ORACLES = {
    "exposure_styles": f"{_ES} SELECT symbol, trade_date, {', '.join(f'{R(c)} AS {c}' for c in COLUMNS)} FROM z9 WHERE size IS NOT NULL",
    "exposure_betas": f"{_BETA}, {_coefficients_sql('p', _DF)} SELECT {_DF}, name, {R('beta')} AS beta FROM pc",
    "exposure_pure": f"{_BETA} SELECT {_DF}, symbol, {R('e')} AS resid FROM p",
    "exposure_style_returns": f"{_RET}, {_coefficients_sql('q', 'trade_date')} SELECT trade_date, name, {R('beta')} AS beta FROM qc",
    "exposure_specific": f"{_RET} SELECT trade_date, symbol, {R('e')} AS resid FROM q",
    "metric_attribution": f"""{_ATTR} SELECT {_DF}, name, {R('f_k')} AS f_k, {R('beta')} AS beta, {R('attr')} AS attr, {R('sum(attr) OVER w')} AS cum_attr, {R('sum(f_k) OVER w')} AS cum_f,
      CASE WHEN count(f_k) OVER s >= 12 THEN {R('avg(f_k) OVER s')} END AS ma_f FROM dl WINDOW w AS (PARTITION BY factor, name ORDER BY trade_date), s AS (PARTITION BY factor, name ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "metric_attribution_summary": f"""{_ATTR}, bs AS (SELECT factor, sum(lam) AS base FROM sl GROUP BY factor)
      SELECT factor, name, count(attr) AS n_days, {R('avg(attr)')} AS mean_attr, {R('sum(attr)')} AS cum_attr, {R('avg(f_k)')} AS mean_f, CASE WHEN name = 'residual' AND abs(any_value(base)) > 1e-12 THEN {R('sum(attr) / any_value(base)')} END AS residual_share
      FROM dl LEFT JOIN bs USING (factor) GROUP BY factor, name""",
    "strategy_neutral_score": f"""{_ES}, un AS (SELECT * FROM es WHERE mv IS NOT NULL AND l1 IS NOT NULL), {_project_sql('p', 'un', 'f', _DF, least=40)},
      fin AS (SELECT es.trade_date, es.factor, es.symbol, CASE WHEN es.mv IS NULL OR es.l1 IS NULL THEN f WHEN {" AND ".join(f"es.{c} IS NOT NULL" for c in COLUMNS)} THEN coalesce(e, f) END AS f FROM es LEFT JOIN p ON p.trade_date = es.trade_date AND p.factor = es.factor AND p.symbol = es.symbol)
      SELECT {_DF}, symbol, {R('f')} AS f FROM fin WHERE f IS NOT NULL""",
    "factor_momentum_resid": f"""{_ES}, {_POINTS}, mo AS (SELECT fit.symbol, fit.t, annual * r2 AS f FROM fit), em AS (SELECT es.* EXCLUDE (f), mo.f FROM es JOIN mo ON mo.symbol = es.symbol AND mo.t = es.t WHERE es.factor = 'mom_5'),
      {_project_sql('p', 'em', 'f', 'trade_date', scaled=True)} SELECT trade_date, symbol, {R('e')} AS resid FROM p""",
}
