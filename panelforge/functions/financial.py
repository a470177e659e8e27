"""Statement factors as expressions over the dense panel joined, as of each session, with the last announced indicators.

Names in lower case that are not panel fields are indicators (columns of the joined frame).
"""

from __future__ import annotations

# Names of announced indicators.
INDICATORS = (
    "bps", "eps", "revenue_ps", "total_revenue_ps", "ocfps", "cfps", "capital_rese_ps", "retainedps", "debt_to_assets", "working_capital", "networking_capital", "fcff", "fcfe",
    "saleexp_to_gr", "adminexp_of_gr", "finaexp_of_gr", "impai_ttm", "extra_item", "ebitda", "ebit", "ebit_of_gr", "ebt_yoy", "assets_yoy", "ocf_yoy", "netprofit_yoy", "dt_netprofit_yoy",
    "ocf_to_or", "salescash_to_or", "netdebt", "n_op_profit_of_ebt", "fixed_assets", "longdeb_to_debt", "currentdebt_to_debt", "op_yoy", "tbassets_to_totalassets", "ca_turn", "fa_turn",
    "assets_turn", "opincome_of_ebt", "investincome_of_ebt", "cogs_of_sales", "grossprofit_margin", "op_of_gr", "roa", "arturn_days", "invturn_days", "profit_dedt", "non_op_profit",
    "valuechange_income", "interestdebt", "current_exint",
)

# Shared terms; shares outstanding are market value over close.
DEFS = {
    "shares": "cap/C",
    "bookeq": "bps*shares",
    "assets": "bookeq/iff(1-debt_to_assets>0,1-debt_to_assets,null)",
    "liab": "assets*debt_to_assets",
    "rev": "revenue_ps*shares",
    "total_rev": "coalesce(total_revenue_ps*shares,rev)",
    "ocf": "ocfps*shares",
    "costs": "cogs_of_sales+saleexp_to_gr+adminexp_of_gr+finaexp_of_gr",
}

# Factors that are an announced indicator itself.
PLAIN = {
    "basics_net_working_capital": "working_capital", "basics_working_capital": "networking_capital", "basics_fcff": "fcff", "basics_fcfe": "fcfe",
    "basics_non_operating_net_profit_ttm": "non_op_profit", "basics_value_change_profit_ttm": "valuechange_income", "basics_non_recurring_gain_loss": "extra_item",
    "growth_total_profit_growth_rate": "ebt_yoy", "growth_total_asset_growth_rate": "assets_yoy", "growth_net_operate_cashflow_growth_rate": "ocf_yoy", "growth_adjusted_net_profit_yoy": "dt_netprofit_yoy",
    "pershare_net_asset_per_share": "bps", "pershare_net_operate_cash_flow_per_share": "ocfps", "pershare_cashflow_per_share_ttm": "cfps",
    "pershare_capital_reserve_fund_per_share": "capital_rese_ps", "pershare_retained_earnings_per_share": "retainedps",
    "quality_financial_expense_rate": "finaexp_of_gr", "quality_sale_expense_to_operating_revenue": "saleexp_to_gr", "quality_cash_rate_of_sales": "ocf_to_or",
    "quality_goods_service_cash_to_operating_revenue_ttm": "salescash_to_or", "quality_net_non_operating_income_to_total_profit": "n_op_profit_of_ebt",
    "quality_operating_profit_growth_rate": "op_yoy", "quality_current_asset_turnover_rate": "ca_turn", "quality_operating_profit_to_total_profit": "opincome_of_ebt",
    "quality_fixed_assets_turnover_rate": "fa_turn", "quality_invest_income_associates_to_total_profit": "investincome_of_ebt",
    "quality_operating_cost_to_operating_revenue_ratio": "cogs_of_sales", "quality_asset_turnover_ttm": "assets_turn",
}
# Factors computed from indicators and the market.
COMPUTED = {
    "basics_market_cap": "cap",
    "basics_cash_flow_to_price_ratio": "iff(cap>0,ocf/cap,null)",
    "basics_sale_expense_ttm": "saleexp_to_gr*total_rev",
    "basics_financial_expense_ttm": "finaexp_of_gr*total_rev",
    "basics_administration_expense_ttm": "adminexp_of_gr*total_rev",
    "basics_asset_impairment_loss_ttm": "impai_ttm*total_rev",
    "basics_ev_to_ebitda": "iff(ebitda>0,(cap+liab)/ebitda,null)",
    "basics_pb_ratio_1": "iff(bookeq>0,cap/bookeq,null)",
    "growth_PEG": "iff(eps>0 and netprofit_yoy>0,C/eps/(netprofit_yoy*100),null)",
    "quality_cfo_to_ev": "iff(cap+netdebt!=0,ocf/(cap+netdebt),null)",
    "quality_fixed_asset_ratio": "iff(assets>0,fixed_assets/assets,null)",
    "quality_net_operating_cash_flow_coverage": "iff(eps!=0,ocfps/eps,null)",
    "quality_MLEV": "iff(liab*longdeb_to_debt+cap>0,liab*longdeb_to_debt/(liab*longdeb_to_debt+cap),null)",
    "quality_debt_to_tangible_equity_ratio": "iff(tbassets_to_totalassets-debt_to_assets>0,debt_to_assets/(tbassets_to_totalassets-debt_to_assets),null)",
    "quality_equity_to_fixed_asset_ratio": "iff(fixed_assets>0,bookeq/fixed_assets,null)",
    "quality_ACCA": "iff(assets>0,ocf/assets,null)-roa",
    "quality_total_profit_to_cost_ratio": "iff(costs>0,ebit_of_gr/costs,null)",
    "quality_time_interest_earned": "iff(abs(finaexp_of_gr*rev)>0,ebit/abs(finaexp_of_gr*rev),null)",
    "quality_adjusted_roe": "iff(bookeq>0,profit_dedt/bookeq,null)",
    "operating_cycle": "invturn_days+arturn_days",
    "equity_to_asset": "1-debt_to_assets",
    "book_equity": "bookeq",
    "total_assets": "assets",
    "total_liability": "liab",
    "revenue": "rev",
    "total_revenue": "total_rev",
    "operating_cash_flow": "ocf",
    "net_profit_to_total_operate_revenue_ttm": "iff(total_revenue_ps!=0,eps/total_revenue_ps,null)",
    "intangible_asset_ratio": "1-tbassets_to_totalassets",
    "net_operate_cash_flow_to_asset": "iff(assets>0,ocf/assets,null)",
    "long_debt_to_asset_ratio": "longdeb_to_debt*debt_to_assets",
    "ROAEBITTTM": "iff(assets>0,ebit/assets,null)",
    "equity_turnover_rate": "iff(bps!=0,revenue_ps/bps,null)",
    "rnoa_ttm": "op_of_gr*assets_turn",
    "operating_profit_ttm": "op_of_gr*total_rev",
    "interest_carry_current_liability": "liab*currentdebt_to_debt-current_exint",
    "gross_profit_ttm": "grossprofit_margin*rev",
    "total_operating_cost_ttm": "costs*total_rev",
    "net_profit_ttm": "eps*shares",
    "OperateNetIncome": "opincome_of_ebt*ebit",
    "operating_cost_ttm": "cogs_of_sales*rev",
    "goods_sale_and_service_render_cash_ttm": "salescash_to_or*rev",
    "operating_liability": "liab-interestdebt",
    "operating_profit_per_share_ttm": "op_of_gr*coalesce(total_revenue_ps,revenue_ps)",
}
