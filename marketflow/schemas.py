"""Typed record models of the instrument feeds (C1 registry) and envelope schemas.

FIXED VALUES: field names and types must equal the original records' for C1 to
accept the same rows; they are stated in the records' order.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _model(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STOCK = _model(("symbol", S), ("name", S), ("real_time_price", D), ("change", D), ("percent_change", D),
               ("volume", I), ("avg_vol_3months", I), ("market_cap", D), ("pe_ratio", D), ("country", S),
               ("sector", S))

ETF = _model(("name", S), ("symbol", S), ("close_price", D), ("dividend_yield", D), ("ongoing_charge", D),
             ("category", S), ("one_day_yield", D), ("one_week_return", D), ("one_month_yield", D),
             ("three_month_yield", D), ("six_month_yield", D), ("yield_for_aaj", D), ("one_year_return", D),
             ("three_year_annualized_return", D), ("five_year_annualized_return", D),
             ("ten_year_annualized_return", D), ("entrance_fee", D), ("current_charges", D),
             ("manager_seniority", I), ("deferred_charges", D), ("minimum_initial_investment", D),
             ("asset_under_management", D), ("actions_style_matrix", S), ("bonds_style_box", S),
             ("average_stock_market_cap", D), ("average_credit_quality", S), ("morningstar_risk", S),
             ("alpha_3_years", D), ("beta_3_years", D), ("r2_over_three_years", D),
             ("three_year_standard_deviation", D), ("management", S))

EQUITY_US = _model(("name", S), ("symbol", S), ("morningstar_category", S), ("medalist_rating", S),
                   ("morningstar_rating_for_funds", S), ("total_return_1_year", D), ("total_return_3_year", D),
                   ("total_return_5_years", D), ("adjusted_expense_ratio", D), ("fund_size", D),
                   ("category", S), ("fund_type", S), ("region", S), ("funds_repartition_strategy", S))

EQUITY_INTERNATIONAL = _model(("name", S), ("symbol", S), ("medalist_rating", S),
                              ("morningstar_rating_for_funds", S), ("total_return_1_year", D),
                              ("total_return_3_year", D), ("total_return_5_years", D),
                              ("adjusted_expense_ratio", D), ("fund_size", D), ("category", S),
                              ("fund_type", S), ("region", S))

BOND_FUND = _model(("name", S), ("symbol", S), ("medalist_rating", S), ("sec_30_day_yield", D), ("ttm_yield", D),
                   ("average_effective_duration", D), ("total_return_1_year", D), ("total_return_3_year", D),
                   ("adjusted_expense_ratio", D), ("asset_under_management", D), ("category", S),
                   ("fund_type", S))

ALTERNATIVE_FUND = _model(("name", S), ("symbol", S), ("medalist_rating", S), ("morningstar_rating", S),
                          ("total_return_1_year", S), ("total_return_3_year", S), ("total_return_5_year", S),
                          ("adjusted_expense_ratio", S), ("asset_under_management", S))

MODELS = {
    "stock": STOCK,
    "etf": ETF,
    "equity_us": EQUITY_US,
    "equity_international": EQUITY_INTERNATIONAL,
    "bond_fund": BOND_FUND,
    "alternative_fund": ALTERNATIVE_FUND,
}

# Raw fund record as it reaches silver (all cells text).
RAW_FUND = _model(("symbol", S), ("name", S), ("category", S), ("fund_type", S),
                  ("adjusted_expense_ratio", S), ("asset_under_management", S))
