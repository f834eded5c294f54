"""DuckDB SQL for the domain views and the oracle queries.

The views mirror ``marketflow.plans.views``; each oracle query is a WITH
chain over the raw testdata tables.  Doubles are rounded to 6 places on both
sides (see ``marketflow.plans.queries.rounded``).
"""

from __future__ import annotations


AMOUNT_RE = r"^\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def amount_sql(c: str) -> str:
    num = f"TRY_CAST(replace(regexp_extract({c}, '{AMOUNT_RE}', 1), ',', '') AS DOUBLE)"
    unit = f"lower(regexp_extract({c}, '{AMOUNT_RE}', 2))"
    return (f"({num} * CASE {unit} WHEN '' THEN 1.0 WHEN 'k' THEN 1e3 WHEN 'th' THEN 1e3 "
            f"WHEN 'm' THEN 1e6 WHEN 'mil' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'bil' THEN 1e9 "
            f"WHEN 'bn' THEN 1e9 WHEN 't' THEN 1e12 WHEN 'tril' THEN 1e12 WHEN 'tn' THEN 1e12 END)")


V_FUNDS_SNAP = """
  SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, p_type AS category, p_brand AS fund_type,
         CASE WHEN p_size % 10 = 0 THEN '—' ELSE printf('%.2f%%', p_size / 100.0) END AS adjusted_expense_ratio,
         CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || ' Mil' AS asset_under_management
  FROM part"""

V_FUNDS = f"v_funds AS ({V_FUNDS_SNAP} UNION ALL {V_FUNDS_SNAP})"

# D1 -> D2 -> D3 (whole row) -> D4 -> D5
V_CLEAN = f"""v_clean AS (
  SELECT adjusted_expense_ratio, {amount_sql('asset_under_management')} AS asset_under_management,
         category, fund_type, name, symbol
  FROM (SELECT DISTINCT symbol, name, category, fund_type,
               TRY_CAST(replace(adjusted_expense_ratio, '%', '') AS DOUBLE) AS adjusted_expense_ratio,
               asset_under_management
        FROM v_funds) d
  WHERE symbol IS NOT NULL AND adjusted_expense_ratio IS NOT NULL AND NOT isnan(adjusted_expense_ratio)
    AND asset_under_management IS NOT NULL)"""

V_PRICES = """v_prices AS (
  SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_extendedprice AS adj_close,
         l_orderkey, l_linenumber
  FROM lineitem)"""

PRICE_ORDER = "ts, l_orderkey, l_linenumber"


def returns_cte(name: str, src: str, order: str = PRICE_ORDER) -> str:
    return f"""{name} AS (
  SELECT symbol, {order}, adj_close,
         lag(adj_close) OVER (PARTITION BY symbol ORDER BY {order}) AS prev_price,
         adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY {order}) - 1 AS daily_return,
         first_value(adj_close) OVER (PARTITION BY symbol ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_price,
         last_value(adj_close) OVER (PARTITION BY symbol ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price
  FROM {src})"""


def metrics_cte(name: str, returns: str) -> str:
    return f"""{name} AS (
  SELECT symbol, first_price, last_price,
         (last_price - first_price) / NULLIF(first_price, 0) * 100 AS total_return_pct,
         mean_return, std_dev,
         CASE WHEN std_dev <> 0 THEN mean_return / std_dev END AS sharpe_ratio, n_returns
  FROM (SELECT symbol, any_value(first_price) AS first_price, any_value(last_price) AS last_price,
               avg(daily_return) AS mean_return, stddev_samp(daily_return) AS std_dev,
               count(daily_return) AS n_returns
        FROM {returns} GROUP BY symbol) g)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


V_INVESTORS = """v_investors AS (
  SELECT c_custkey AS investor_id, c_acctbal / 100.0 AS risk_aversion, c_mktsegment AS segment FROM customer)"""


def bracket_sql(r: str) -> str:
    return (f"CASE WHEN {r} IS NULL OR isnan({r}) THEN NULL WHEN {r} <= 1 THEN 1 WHEN {r} <= 5 THEN 2 "
            f"WHEN {r} <= 10 THEN 3 WHEN {r} <= 15 THEN 4 WHEN {r} <= 20 THEN 5 WHEN {r} <= 30 THEN 6 "
            f"WHEN {r} <= 50 THEN 7 ELSE 8 END")


def bracket_return_sql(r: str) -> str:
    b = bracket_sql(r)
    return (f"(CASE {b} WHEN 1 THEN 0.08 WHEN 2 THEN 0.07 WHEN 3 THEN 0.06 WHEN 4 THEN 0.05 WHEN 5 THEN 0.04 "
            f"WHEN 6 THEN 0.03 WHEN 7 THEN 0.02 WHEN 8 THEN 0.01 ELSE 0.05 END)::DOUBLE")


# FIXED VALUES (same as marketflow.constants.RISK_BRACKETS), long form.
ALLOCATION_VALUES = """allocation(bracket, asset_class, weight, pos) AS (VALUES
  (1, 'Stocks', 0.8, 0), (1, 'Commodities', 0.05, 1), (1, 'ETFs', 0.05, 2), (1, 'Mutual Funds', 0.05, 3),
  (1, 'Bonds', 0.05, 4), (1, 'Cash', 0.0, 5),
  (2, 'Stocks', 0.6, 0), (2, 'Commodities', 0.1, 1), (2, 'ETFs', 0.2, 2), (2, 'Mutual Funds', 0.05, 3),
  (2, 'Bonds', 0.05, 4), (2, 'Cash', 0.0, 5),
  (3, 'Stocks', 0.5, 0), (3, 'Commodities', 0.1, 1), (3, 'ETFs', 0.15, 2), (3, 'Mutual Funds', 0.1, 3),
  (3, 'Bonds', 0.15, 4), (3, 'Cash', 0.0, 5),
  (4, 'Stocks', 0.4, 0), (4, 'Commodities', 0.05, 1), (4, 'ETFs', 0.2, 2), (4, 'Mutual Funds', 0.1, 3),
  (4, 'Bonds', 0.15, 4), (4, 'Cash', 0.1, 5),
  (5, 'Stocks', 0.3, 0), (5, 'Commodities', 0.05, 1), (5, 'ETFs', 0.2, 2), (5, 'Mutual Funds', 0.2, 3),
  (5, 'Bonds', 0.1, 4), (5, 'Cash', 0.05, 5),
  (6, 'Stocks', 0.2, 0), (6, 'Commodities', 0.0, 1), (6, 'ETFs', 0.2, 2), (6, 'Mutual Funds', 0.2, 3),
  (6, 'Bonds', 0.1, 4), (6, 'Cash', 0.1, 5),
  (7, 'Stocks', 0.1, 0), (7, 'Commodities', 0.0, 1), (7, 'ETFs', 0.2, 2), (7, 'Mutual Funds', 0.2, 3),
  (7, 'Bonds', 0.2, 4), (7, 'Cash', 0.1, 5),
  (8, 'Stocks', 0.0, 0), (8, 'Commodities', 0.0, 1), (8, 'ETFs', 0.3, 2), (8, 'Mutual Funds', 0.3, 3),
  (8, 'Bonds', 0.2, 4), (8, 'Cash', 0.2, 5))"""

V_GOALS = f"""v_goals AS (
  SELECT o_orderkey AS goal_id, o_custkey AS investor_id,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE lower(regexp_replace(o_orderpriority, '^[0-9]+-', '')) END AS goal,
         greatest(c_acctbal, 0.0) AS initial_investment,
         o_totalprice / 1000.0 AS contribution,
         CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'monthly' END AS contribution_period,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000.0 / 12.0 ELSE o_totalprice / 1000.0 END
           AS monthly_contribution,
         {bracket_return_sql('c_acctbal / 100.0')} AS annual_return,
         o_totalprice AS target_value, CAST(o_orderkey % 6 AS INTEGER) AS time_horizon
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

V_GOALS_EVAL = """v_eval AS (
  SELECT *, is_specific AND is_measurable AND is_time AND future_value >= target_value AS is_achievable
  FROM (SELECT *, coalesce(goal <> '', false) AS is_specific,
               coalesce(target_value > 0 AND (monthly_contribution > 0 OR initial_investment > 0), false)
                 AS is_measurable,
               coalesce(time_horizon > 0, false) AS is_time,
               CASE WHEN annual_return / 12.0 = 0
                    THEN initial_investment + monthly_contribution * (time_horizon * 12.0)
                    ELSE initial_investment * pow(1 + annual_return / 12.0, time_horizon * 12.0)
                         + monthly_contribution * (pow(1 + annual_return / 12.0, time_horizon * 12.0) - 1)
                           / (annual_return / 12.0) END AS future_value
        FROM v_goals) s)"""

V_SESSION = """v_session AS (
  SELECT user_id AS conv_id, ts, event_id, event_type,
         CASE WHEN event_type = 'signup' THEN 'initialize' WHEN event_type = 'purchase' THEN 'goal_achievable'
              WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'smalltalk' WHEN event_type = 'view' THEN 'goal_text'
              WHEN event_type = 'click' THEN 'preferences_confirmed' WHEN event_type = 'error' THEN 'reset' END
           AS intent
  FROM events)"""

V_FORMS = """v_forms AS (
  SELECT c_custkey AS investor_id, CAST(20 + c_nationkey * 2 AS VARCHAR) AS age,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'No high school degree' WHEN 'BUILDING' THEN 'Bachelor degree'
           WHEN 'FURNITURE' THEN 'Master degree' WHEN 'MACHINERY' THEN 'PhD' ELSE lower(c_mktsegment) END
           AS education,
         (['Entrepreneur', 'Managerial', 'Salarial', 'Unemployed', 'Retired'])[c_nationkey % 5 + 1] AS occupation,
         CAST(c_nationkey % 4 AS VARCHAR) AS kids,
         CASE WHEN c_acctbal < 0 THEN '—' ELSE CAST(c_acctbal AS VARCHAR) END AS income,
         CAST(c_acctbal * 3 AS VARCHAR) AS net_worth_income,
         CAST(c_custkey % 4 + 1 AS VARCHAR) AS risk, CAST(c_custkey % 2 AS VARCHAR) AS married,
         c_acctbal / 100.0 AS TrueRiskTol
  FROM customer)"""

V_FEATURES = """v_features AS (
  SELECT investor_id,
         TRY_CAST(age AS DOUBLE) AS age,
         CASE education WHEN 'No high school degree' THEN 1 WHEN 'Bachelor degree' THEN 2 WHEN 'Master degree' THEN 3
           WHEN 'PhD' THEN 4 ELSE 0 END AS education,
         CASE occupation WHEN 'Entrepreneur' THEN 1 WHEN 'Managerial' THEN 2 WHEN 'Salarial' THEN 3
           WHEN 'Unemployed' THEN 4 ELSE 0 END AS occupation,
         TRY_CAST(kids AS DOUBLE) AS kids, TRY_CAST(income AS DOUBLE) AS income,
         TRY_CAST(net_worth_income AS DOUBLE) AS net_worth, TRY_CAST(risk AS INTEGER) AS risk,
         TRY_CAST(married AS INTEGER) AS married, TrueRiskTol
  FROM v_forms)"""

V_PREDICTIONS = """v_pred AS (
  SELECT c_custkey AS investor_id, c_acctbal / 100.0 AS label, 'scaled_balance' AS model, 0 AS ordinal,
         c_acctbal * 0.009 AS prediction FROM customer
  UNION ALL
  SELECT c_custkey, c_acctbal / 100.0, 'nation_level', 1, c_nationkey * 2.0 FROM customer
  UNION ALL
  SELECT c_custkey, c_acctbal / 100.0, 'constant', 2, 45.0 FROM customer)"""

V_REGISTRY = """v_registry AS (
  SELECT 'model_' || regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS model_name, o_orderkey AS version,
         CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'Archived' END AS stage,
         'models:/model_' || regexp_extract(o_orderpriority, '^([0-9]+)', 1) || '/' || CAST(o_orderkey AS VARCHAR) AS model_uri
  FROM orders)"""


V_MESSAGES = """v_messages AS (
  SELECT event_id, ts,
         CASE WHEN event_type = 'error' THEN 'not json ' || CAST(event_id AS VARCHAR)
              ELSE json_object('type', event_type, 'data', '[' || props || ']')::VARCHAR END AS value
  FROM events)"""

SECTORS_LIST = ("['Materials', 'Finance', 'Technology', 'Healthcare', 'Industrials', 'Consumer Defensive', "
                "'Utilities', 'Energy', 'Consumer Cyclical', 'Real Estate', 'Communication Services']")

V_STOCK_ROWS = f"""v_stock AS (
  SELECT s_suppkey AS row_id, lower(n_name) AS feed,
         'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, CAST(s_acctbal AS VARCHAR) AS real_time_price,
         CAST(s_nationkey - 12 AS VARCHAR) AS change, CAST(s_nationkey - 12 AS VARCHAR) || '%' AS percent_change,
         CAST(s_suppkey * 1000 AS VARCHAR) AS volume, CAST(s_suppkey * 900 AS VARCHAR) AS avg_vol_3months,
         CAST((s_suppkey + 1) * 1000003 AS VARCHAR) AS market_cap,
         CASE WHEN s_acctbal < 0 THEN '—' ELSE CAST(s_nationkey AS VARCHAR) END AS pe_ratio,
         '' AS country, ({SECTORS_LIST})[s_suppkey % 11 + 1] AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

# The character references that the given tables hold; "&amp;" last, so that "&amp;lt;" becomes "&lt;" and no more.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0", "&amp;": "&"}


def displayed(x: str) -> str:
    """SQL of an HTML fragment as displayed (tags, references, line breaks)."""
    out = f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '[ \\t]*[\\r\\n]+[ \\t]*', ' ', 'g')"
    for name, char in ENTITIES.items():
        out = f"replace({out}, '{name}', chr({ord(char)}))"
    return f"trim({out})"


V_LI_ROWS = r"""v_li AS (
  SELECT page_id, row_pos, row_html,
         list_transform(regexp_extract_all(row_html, '(?s)<a[^>]*>(.*?)</a>', 1),
                        lambda x: @X@) AS cells
  FROM (SELECT page_id, unnest(l) AS row_html, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS row_pos
        FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS l FROM pages) p) q)""".replace("@X@", displayed("x")).replace("@H@", displayed("row_html"))

V_MIXED_ROWS = r"""v_mixed AS (
  SELECT page_id, row_pos, row_html,
         list_transform(regexp_extract_all(row_html, '(?s)<a[^>]*>(.*?)</a>', 1),
                        lambda x: @X@) AS cells
  FROM (SELECT page_id, unnest(l) AS row_html, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS row_pos
        FROM (SELECT page_id, regexp_extract_all(html, '<(?:li|p)>(.*?)</(?:li|p)>', 1) AS l FROM pages) p) q)""".replace("@X@", displayed("x")).replace("@H@", displayed("row_html"))

V_PARA_ROWS = r"""v_para AS (
  SELECT page_id, row_pos, @H@ AS para
  FROM (SELECT page_id, unnest(l) AS row_html, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS row_pos
        FROM (SELECT page_id, regexp_extract_all(html, '<p>(.*?)</p>', 1) AS l FROM pages) p) q)""".replace("@X@", displayed("x")).replace("@H@", displayed("row_html"))
