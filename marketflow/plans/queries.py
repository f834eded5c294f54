"""Registered queries: one per operator of the inventory, over the testdata views.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
on the raw tables) return the same columns.  Every double is rounded to 6
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.operators import silver
from marketflow.plans import oracle as O
from marketflow.plans import views as V
from marketflow.plans.jobs import process_funds
from marketflow.sources.prices import trailing_prices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every float/double column (oracle comparisons)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr}"


# ------------------------------------------------------------------ silver --

@register("d1_percent_to_number", O.with_(O.V_FUNDS) + f"""
SELECT symbol, adjusted_expense_ratio AS expense_text,
       {r6("TRY_CAST(replace(adjusted_expense_ratio, '%', '') AS DOUBLE)", "adjusted_expense_ratio")}
FROM v_funds""")
def q_d1(spark, sf):
    raw = V.funds_raw(spark, sf)
    return rounded(silver.percent_column(raw.select("symbol", F.col("adjusted_expense_ratio").alias("expense_text"),
                                                    "adjusted_expense_ratio")))


@register("d2_require", O.with_(O.V_FUNDS) + """
SELECT symbol, name, round(e, 6) AS adjusted_expense_ratio, asset_under_management
FROM (SELECT *, TRY_CAST(replace(adjusted_expense_ratio, '%', '') AS DOUBLE) AS e FROM v_funds) f
WHERE symbol IS NOT NULL AND e IS NOT NULL AND NOT isnan(e) AND asset_under_management IS NOT NULL""")
def q_d2(spark, sf):
    df = silver.percent_column(V.funds_raw(spark, sf))
    return rounded(silver.require(df).select("symbol", "name", "adjusted_expense_ratio", "asset_under_management"))


@register("d3_dedupe_rows", O.with_(O.V_FUNDS) + "SELECT DISTINCT * FROM v_funds")
def q_d3(spark, sf):
    return silver.dedupe_rows(V.funds_raw(spark, sf))


@register("d4_scale_amount", O.with_(O.V_FUNDS) + f"""
SELECT DISTINCT symbol, asset_under_management AS amount_text,
       {r6(O.amount_sql('asset_under_management'), 'asset_under_management')}
FROM v_funds""")
def q_d4(spark, sf):
    raw = V.funds_raw(spark, sf).select("symbol", F.col("asset_under_management").alias("amount_text"),
                                        "asset_under_management")
    return rounded(silver.amount_column(raw).distinct())


@register("d5_clean_funds", O.with_(O.V_FUNDS, O.V_CLEAN) + """
SELECT round(adjusted_expense_ratio, 6) AS adjusted_expense_ratio,
       round(asset_under_management, 6) AS asset_under_management, category, fund_type, name, symbol
FROM v_clean""")
def q_d5(spark, sf):
    return rounded(silver.clean_funds(V.funds_raw(spark, sf)))


@register("d6_distinct_symbols", O.with_(O.V_FUNDS, O.V_CLEAN) + "SELECT DISTINCT symbol FROM v_clean")
def q_d6(spark, sf):
    return silver.distinct_symbols(silver.clean_funds(V.funds_raw(spark, sf)))


_METRICS_SQL = O.with_(O.V_PRICES, O.returns_cte("r", "v_prices"), O.metrics_cte("m", "r"))


@register("d7_first_last", _METRICS_SQL + "SELECT symbol, round(first_price, 6) AS first_price, "
                                          "round(last_price, 6) AS last_price FROM m")
def q_d7(spark, sf):
    return rounded(silver.first_last(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK))


@register("d8_total_return", _METRICS_SQL + "SELECT symbol, round(total_return_pct, 6) AS total_return_pct FROM m")
def q_d8(spark, sf):
    fl = silver.first_last(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(fl.select("symbol", silver.total_return("first_price", "last_price").alias("total_return_pct")))


@register("d9_daily_return", O.with_(O.V_PRICES, O.returns_cte("r", "v_prices")) + """
SELECT symbol, ts, l_orderkey, l_linenumber, round(adj_close, 6) AS adj_close,
       round(prev_price, 6) AS prev_price, round(daily_return, 6) AS daily_return FROM r""")
def q_d9(spark, sf):
    return rounded(silver.daily_returns(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK))


@register("d10_volatility", _METRICS_SQL + "SELECT symbol, round(std_dev, 6) AS std_dev FROM m")
def q_d10(spark, sf):
    m = silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(m.select("symbol", "std_dev"))


@register("d11_mean_return", _METRICS_SQL + "SELECT symbol, round(mean_return, 6) AS mean_return FROM m")
def q_d11(spark, sf):
    m = silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(m.select("symbol", "mean_return"))


@register("d12_sharpe", _METRICS_SQL + "SELECT symbol, round(sharpe_ratio, 6) AS sharpe_ratio FROM m")
def q_d12(spark, sf):
    m = silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(m.select("symbol", "sharpe_ratio"))


_METRIC_SELECT = """SELECT symbol, round(first_price, 6) AS first_price, round(last_price, 6) AS last_price,
       round(total_return_pct, 6) AS total_return_pct, round(mean_return, 6) AS mean_return,
       round(std_dev, 6) AS std_dev, round(sharpe_ratio, 6) AS sharpe_ratio, n_returns FROM m"""


@register("d13_symbol_metrics", _METRICS_SQL + _METRIC_SELECT)
def q_d13(spark, sf):
    return rounded(silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK))


@register("d13_symbol_metrics_events", O.with_(
    "v_pev AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS adj_close FROM events)",
    O.returns_cte("r", "v_pev", "ts"), O.metrics_cte("m", "r")) + _METRIC_SELECT)
def q_d13_ev(spark, sf):
    return rounded(silver.symbol_metrics(V.prices_events(spark, sf), piece=86400))


@register("d14_enrich", _METRICS_SQL.replace("WITH ", "WITH " + O.V_FUNDS + ",\n" + O.V_CLEAN + ",\n", 1) + """
SELECT round(c.adjusted_expense_ratio, 6) AS adjusted_expense_ratio,
       round(c.asset_under_management, 6) AS asset_under_management, c.category, c.fund_type, c.name, c.symbol,
       round(m.total_return_pct, 6) AS total_return_pct, round(m.std_dev, 6) AS std_dev,
       round(m.sharpe_ratio, 6) AS sharpe_ratio
FROM v_clean c LEFT JOIN m ON c.symbol = m.symbol""")
def q_d14(spark, sf):
    funds = silver.clean_funds(V.funds_raw(spark, sf))
    metrics = silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(silver.enrich(funds, metrics))


_TRAILING = """v_trail AS (
  SELECT * FROM v_prices
  WHERE symbol IN (SELECT symbol FROM v_clean)
    AND ts > (SELECT max(ts) FROM v_prices) - INTERVAL 1 YEAR)"""

FLAGSHIP_SQL = O.with_(O.V_FUNDS, O.V_CLEAN, O.V_PRICES, _TRAILING, O.returns_cte("r", "v_trail"),
                       O.metrics_cte("m", "r")) + """
SELECT round(c.adjusted_expense_ratio, 6) AS adjusted_expense_ratio,
       round(c.asset_under_management, 6) AS asset_under_management, c.category, c.fund_type, c.name, c.symbol,
       round(m.total_return_pct, 6) AS total_return_pct, round(m.std_dev, 6) AS std_dev,
       round(m.sharpe_ratio, 6) AS sharpe_ratio
FROM v_clean c LEFT JOIN m ON c.symbol = m.symbol"""


@register("d15_process_funds", FLAGSHIP_SQL)
def q_d15(spark, sf):
    return rounded(process_funds(V.funds_raw(spark, sf), V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK))


@register("a9_trailing_prices", O.with_(O.V_FUNDS, O.V_CLEAN, O.V_PRICES, _TRAILING) + """
SELECT symbol, ts, l_orderkey, l_linenumber, round(adj_close, 6) AS adj_close FROM v_trail""")
def q_a9(spark, sf):
    symbols = silver.distinct_symbols(silver.clean_funds(V.funds_raw(spark, sf)))
    return rounded(trailing_prices(V.prices(spark, sf), symbols, period="1 year"))


# ----------------------------------------------------------- goals & risk --

from marketflow.operators import features as E  # noqa: E402
from marketflow.operators import goals as G  # noqa: E402
from marketflow.operators import sessions as S  # noqa: E402


@register("f1_risk_bracket", O.with_(O.V_INVESTORS) + f"""
SELECT investor_id, round(risk_aversion, 6) AS risk_aversion, {O.bracket_sql('risk_aversion')} AS bracket,
       round({O.bracket_return_sql('risk_aversion')}, 6) AS annual_return
FROM v_investors""")
def q_f1(spark, sf):
    return rounded(G.with_risk_bracket(V.investors(spark, sf)).select("investor_id", "risk_aversion", "bracket",
                                                                       "annual_return"))


@register("f2_allocation", O.with_(O.V_INVESTORS, O.ALLOCATION_VALUES) + f"""
SELECT i.investor_id, a.bracket, round(s.weight_sum, 6) AS weight_sum, a.asset_class, round(a.weight::DOUBLE, 6) AS weight
FROM v_investors i
JOIN allocation a ON a.bracket = {O.bracket_sql('i.risk_aversion')}
JOIN (SELECT bracket, sum(weight)::DOUBLE AS weight_sum FROM allocation GROUP BY bracket) s ON s.bracket = a.bracket""")
def q_f2(spark, sf):
    return rounded(G.allocation_long(V.investors(spark, sf)))


_GOALS_SQL = O.with_(O.V_GOALS, O.V_GOALS_EVAL)


@register("f3_smt_flags", _GOALS_SQL + "SELECT goal_id, is_specific, is_measurable, is_time FROM v_eval")
def q_f3(spark, sf):
    return G.smt_flags(V.goals(spark, sf)).select("goal_id", "is_specific", "is_measurable", "is_time")


@register("f4_future_value", _GOALS_SQL + "SELECT goal_id, round(future_value, 4) AS future_value FROM v_eval")
def q_f4(spark, sf):
    from marketflow.functions.finance import future_value
    g = V.goals(spark, sf)
    fv = future_value("initial_investment", "monthly_contribution", "annual_return", "time_horizon")
    return g.select("goal_id", F.round(fv, 4).alias("future_value"))


@register("f5_achievable", _GOALS_SQL + "SELECT goal_id, is_achievable FROM v_eval")
def q_f5(spark, sf):
    return G.evaluate_goals(V.goals(spark, sf)).select("goal_id", "is_achievable")


@register("f6_goal_outcome", _GOALS_SQL + """
SELECT goal_id, CASE WHEN is_achievable THEN 'smart' ELSE 'not_smart' END AS outcome,
       CASE WHEN NOT is_specific THEN 'specific' WHEN NOT is_measurable THEN 'measurable'
            WHEN NOT is_time THEN 'time' WHEN NOT is_achievable THEN 'achievable' END AS failed_criterion
FROM v_eval""")
def q_f6(spark, sf):
    return G.evaluate_goals(V.goals(spark, sf)).select("goal_id", "outcome", "failed_criterion")


@register("f7_goal_text", _GOALS_SQL + """
SELECT goal_id, printf('Achievable: %s, Future Value: %.2f', CASE WHEN is_achievable THEN 'True' ELSE 'False' END,
                       coalesce(future_value, 0.0)) AS achievable_text
FROM v_eval""")
def q_f7(spark, sf):
    return G.evaluate_goals(V.goals(spark, sf)).select("goal_id", "achievable_text")


@register("f8_to_monthly", O.with_(O.V_GOALS) + """
SELECT goal_id, contribution, contribution_period, monthly_contribution FROM v_goals""")
def q_f8(spark, sf):
    # exact IEEE arithmetic on both sides: compared unrounded
    return V.goals(spark, sf).select("goal_id", "contribution", "contribution_period", "monthly_contribution")


@register("f9_transcript", f"""
SELECT conv_id, '{G.HISTORY_PREFIX}' || string_agg(text, '' ORDER BY turn) AS history, count(*) AS n_answers
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def q_f9(spark, sf):
    return G.transcript(V.table(spark, sf, "conversations"))


@register("f10_session_state", O.with_(O.V_SESSION) + """
SELECT conv_id, event_id, ts, intent,
  coalesce(max(intent = 'initialize') OVER w, false) AS introduction_state,
  coalesce(max(intent = 'goal_achievable') OVER w, false) AS profiling_state,
  coalesce(last_value(CASE WHEN intent = 'preferences_confirmed' THEN true WHEN intent = 'reset' THEN false END
           IGNORE NULLS) OVER w, false) AS preferences_state,
  CASE WHEN intent = 'initialize' THEN 'initialize'
       WHEN intent IN ('goal_achievable', 'goal_text')
            AND coalesce(max(intent = 'goal_achievable') OVER wb, false) THEN 'fallback'
       WHEN intent IN ('goal_achievable', 'goal_text') THEN 'check_smart'
       WHEN intent = 'preferences_confirmed' THEN 'preferences_confirmation'
       WHEN intent = 'reset' THEN 'reset_preferences'
       WHEN NOT coalesce(max(intent = 'goal_achievable') OVER wb, false) THEN 'fallback' END AS route
FROM v_session
WINDOW w AS (PARTITION BY conv_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wb AS (PARTITION BY conv_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_f10(spark, sf):
    st = S.session_state(V.session_events(spark, sf), order=("ts", "event_id"))
    return st.select("conv_id", "event_id", "ts", "intent", "introduction_state", "profiling_state",
                     "preferences_state", "route")


@register("f9_transcript_parts", """
SELECT conv_id, CAST(floor(turn / 100) AS BIGINT) AS part, string_agg(text, '' ORDER BY turn) AS text,
       count(*) AS n_answers
FROM conversations WHERE role = 'assistant' GROUP BY conv_id, CAST(floor(turn / 100) AS BIGINT)""")
def q_f9p(spark, sf):
    return G.transcript_parts(V.table(spark, sf, "conversations"), turns_per_part=100)


@register("f11_needs_confirmation", f"""
SELECT conv_id, turn, coalesce(contains(lower(text), '{G.CONFIRM_PHRASE}'), false) AS needs_confirmation
FROM conversations WHERE role = 'assistant'""")
def q_f11(spark, sf):
    conv = V.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return G.needs_confirmation(conv).select("conv_id", "turn", "needs_confirmation")


# ------------------------------------------------------ investor features --

_FEATURES_SQL = O.with_(O.V_FORMS, O.V_FEATURES)


@register("e1_encode_categories", _FEATURES_SQL + "SELECT investor_id, education, occupation FROM v_features")
def q_e1(spark, sf):
    return E.encode_form(V.forms(spark, sf)).select("investor_id", "education", "occupation")


@register("e2_cast_form", _FEATURES_SQL + """
SELECT investor_id, round(age, 6) AS age, round(kids, 6) AS kids, round(income, 6) AS income,
       round(net_worth, 6) AS net_worth, risk, married FROM v_features""")
def q_e2(spark, sf):
    return rounded(E.encode_form(V.forms(spark, sf)).select("investor_id", "age", "kids", "income", "net_worth",
                                                            "risk", "married"))


@register("e4_feature_order", _FEATURES_SQL + """
SELECT investor_id, round(age, 6) AS age, education, occupation, round(kids, 6) AS kids,
       round(income, 6) AS income, round(net_worth, 6) AS net_worth, risk, married,
       round(TrueRiskTol, 6) AS TrueRiskTol FROM v_features""")
def q_e4(spark, sf):
    return rounded(E.feature_order(E.encode_form(V.forms(spark, sf)), keep=("investor_id",)))


def _scaled_sql():
    cols = []
    for c in E.FEATURE_COLUMNS:
        cols.append(f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / "
                    f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1.0), 6) AS {c}")
    return _FEATURES_SQL + "SELECT investor_id, " + ", ".join(cols) + " FROM v_features"


@register("e6_scale", _scaled_sql())
def q_e6(spark, sf):
    feats = E.encode_form(V.forms(spark, sf))
    sc = E.fit_scaler(feats)
    return rounded(E.scale(feats, sc).select("investor_id", *E.FEATURE_COLUMNS))


@register("e10_regression_error", O.with_(O.V_PREDICTIONS) + """
SELECT model, round(avg(pow(label - prediction, 2)), 6) AS mse, count(*) AS n,
       round(sqrt(avg(pow(label - prediction, 2))), 6) AS rmse
FROM v_pred GROUP BY model""")
def q_e10(spark, sf):
    return rounded(E.regression_error(V.predictions(spark, sf)))


@register("e11_pick_best", O.with_(O.V_PREDICTIONS) + """
SELECT arg_min(model, mse * 10 + ordinal) AS best_model, round(min(mse), 6) AS best_mse
FROM (SELECT model, any_value(ordinal) AS ordinal, avg(pow(label - prediction, 2)) AS mse
      FROM v_pred GROUP BY model) e""")
def q_e11(spark, sf):
    p = V.predictions(spark, sf)
    err = E.regression_error(p, group=("model", "ordinal"))
    return rounded(E.pick_best(err))


@register("e12_latest_version", O.with_(O.V_REGISTRY) + """
SELECT model_name, max(version) AS latest_version, arg_max(model_uri, version) AS model_uri
FROM v_registry WHERE stage IN ('None', 'Staging', 'Production') GROUP BY model_name""")
def q_e12(spark, sf):
    from marketflow.constants import MODEL_STAGES
    return E.latest_version(V.registry(spark, sf), stages=MODEL_STAGES)


# ---------------------------------------------------- envelope & bronze ----

from marketflow.constants import (COMMODITY_TYPES, FUND_TYPES, HEAVY_SECTORS, LIGHT_SECTORS, STOCK_COUNTRIES,  # noqa: E402
                                  STOCK_LAYOUT)
from marketflow.schemas import MODELS, RAW_FUND  # noqa: E402
from marketflow.operators import pages as B  # noqa: E402
from marketflow.operators import quality as C  # noqa: E402
from marketflow.sources import envelope as A  # noqa: E402

_EVENT_RECORD = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                              T.StructField("props", T.StringType())])
PUBLISH_TEST_BYTES = 64 * 1024  # small limit so every feed is split in several messages


@register("a2_decode_envelope", O.with_(O.V_MESSAGES) + """
SELECT event_id,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.type') END AS message_type,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.data') END AS data
FROM v_messages""")
def q_a2(spark, sf):
    return A.decode_envelope(V.messages(spark, sf), keep=("event_id",))


def _published(spark, sf):
    ev = V.table(spark, sf, "events")
    return A.publish_feed(ev, "event_type", ["event_id", "user_id", "props"], max_bytes=PUBLISH_TEST_BYTES)


@register("a5_publish_feed", """
SELECT event_type AS message_type, count(*) AS n_records,
       CAST(sum(strlen(to_json(json_object('event_id', event_id, 'user_id', user_id, 'props', props)::VARCHAR)::VARCHAR) - 2) AS BIGINT) AS n_bytes,
       true AS all_fit
FROM events GROUP BY event_type""")
def q_a5(spark, sf):
    p = _published(spark, sf)
    return p.groupBy("message_type").agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"),
                                         F.bool_and("fits").alias("all_fit"))


@register("d16_unnest_bronze", "SELECT event_type AS message_type, event_id, user_id, props FROM events")
def q_d16(spark, sf):
    bronze = A.decode_envelope(_published(spark, sf))
    return silver.unnest_bronze(bronze, None, _EVENT_RECORD)


@register("d16_unnest_messages", O.with_(O.V_MESSAGES) + """
SELECT json_extract_string(value, '$.type') AS message_type,
       CAST(json_extract(json_extract_string(value, '$.data'), '$[0].k') AS BIGINT) AS k
FROM v_messages WHERE json_valid(value)""")
def q_d16b(spark, sf):
    bronze = A.decode_envelope(V.messages(spark, sf))
    return silver.unnest_bronze(bronze, None, T.StructType([T.StructField("k", T.LongType())]))


@register("d16_bronze_rejects", O.with_(O.V_MESSAGES) + "SELECT event_id FROM v_messages WHERE NOT json_valid(value)")
def q_d16c(spark, sf):
    bronze = A.decode_envelope(V.messages(spark, sf), keep=("event_id",))
    return silver.bronze_rejects(bronze, T.StructType([T.StructField("k", T.LongType())])).select("event_id")


# --------------------------------------------------------------- quality --

def _stock_rows(spark, sf):
    cells = V.stock_cells(spark, sf)
    named = B.apply_layout(cells, {"stocks": STOCK_LAYOUT}, F.lit("stocks"), keep=("row_id", "feed"))
    return named


@register("b10_apply_layout", O.with_(O.V_STOCK_ROWS) + """
SELECT row_id, feed, symbol, name, real_time_price, change, percent_change, volume, avg_vol_3months,
       market_cap, pe_ratio, country, sector FROM v_stock""")
def q_b10(spark, sf):
    return _stock_rows(spark, sf)


@register("b11_add_constants", O.with_(O.V_STOCK_ROWS) + """
SELECT row_id, feed AS country, 'screener' AS source,
       CASE WHEN feed = 'nation_0' THEN 'US' ELSE 'INTL' END AS market FROM v_stock""")
def q_b11(spark, sf):
    df = B.add_constants(_stock_rows(spark, sf), {"country": F.col("feed"), "source": "screener"})
    df = df.withColumn("market", F.when(F.col("feed") == "nation_0", F.lit("US")).otherwise(F.lit("INTL")))
    return df.select("row_id", "country", "source", "market")


def _conform_sql():
    from marketflow.schemas import STOCK
    cols, fails = [], []
    for f in STOCK.fields:
        src = {"country": "feed", "percent_change": "replace(percent_change, '%', '')"}.get(f.name, f.name)
        typ = {"DoubleType()": "DOUBLE", "IntegerType()": "INTEGER", "StringType()": "VARCHAR"}[repr(f.dataType)]
        e = src if typ == "VARCHAR" else f"TRY_CAST({src} AS {typ})"
        cols.append(f"{'round(' + e + ', 6)' if typ == 'DOUBLE' else e} AS {f.name}")
        fails.append(f"CASE WHEN {e} IS NULL THEN '{f.name}' END")
    failed = "concat_ws(',', " + ", ".join(fails) + ")"
    return (O.with_(O.V_STOCK_ROWS) + "SELECT row_id, " + ", ".join(cols) +
            f", {failed} AS failed_fields, {failed} = '' AS is_valid FROM v_stock")


@register("c1_conform", _conform_sql())
def q_c1(spark, sf):
    df = B.add_constants(_stock_rows(spark, sf), {"country": F.col("feed")})
    return rounded(C.conform(silver.percent_column(df, "percent_change"), "stock", keep=("row_id",)))


_PAYLOAD_KEYS = ["age", "education", "occupation", "kids", "income", "net_worth", "risk"]


@register("c2_check_keys", f"""
WITH p AS (
  SELECT c_custkey AS investor_id,
         CASE WHEN c_mktsegment = 'HOUSEHOLD'
              THEN json_object({", ".join(f"'{k}', c_nationkey" for k in _PAYLOAD_KEYS)}, 'spouse', 1)
              ELSE json_object({", ".join(f"'{k}', c_nationkey" for k in _PAYLOAD_KEYS)}, 'married', 1) END::VARCHAR
           AS payload
  FROM customer),
k AS (SELECT investor_id, json_keys(payload) AS keys FROM p)
SELECT investor_id,
       array_to_string(list_sort(list_filter({E.FEATURE_COLUMNS!r}, lambda x: NOT list_contains(keys, x))), ',')
         AS missing,
       array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains({E.FEATURE_COLUMNS!r}, x))), ',')
         AS extra
FROM k""".replace('"', "'") + "")
def q_c2(spark, sf):
    return C.check_keys(_investor_payloads(spark, sf)).select("investor_id", "missing", "extra")


def _investor_payloads(spark, sf):
    c = V.table(spark, sf, "customer")
    base = [F.col("c_nationkey").alias(k) for k in _PAYLOAD_KEYS]
    payload = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.to_json(F.struct(*base, F.lit(1).alias("spouse")))) \
               .otherwise(F.to_json(F.struct(*base, F.lit(1).alias("married"))))
    return c.select(F.col("c_custkey").alias("investor_id"), payload.alias("payload"))


_ALLOWED_TYPES = ["CLICK", "PURCHASE", "SIGNUP", "VIEW"]


@register("c3_check_member", O.with_(O.V_MESSAGES) + f"""
SELECT event_id, message_type,
       coalesce(upper(message_type) IN ({", ".join(repr(t) for t in _ALLOWED_TYPES)}), false) AS accepted
FROM (SELECT event_id, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.type') END AS message_type
      FROM v_messages) m""")
def q_c3(spark, sf):
    dec = A.decode_envelope(V.messages(spark, sf), keep=("event_id",))
    return C.member_flag(dec, "message_type", [t.lower() for t in _ALLOWED_TYPES], fold="upper") \
            .select("event_id", "message_type", "accepted")


@register("c4_keep_new", """
SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM events
WHERE ts >= TIMESTAMP '2024-01-15' OR event_type = 'click'""")
def q_c4(spark, sf):
    ev = V.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    existing = (ev.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
                  .withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1)
                                        .otherwise(F.col("value"))))
    new = C.keep_new(ev.drop("ts"), existing.drop("ts"), keys=["event_id"])
    return rounded(new)


@register("c5_gold", ORACLE["d14_enrich"].replace(
    "FROM v_clean c LEFT JOIN m ON c.symbol = m.symbol",
    """FROM v_clean c LEFT JOIN m ON c.symbol = m.symbol
WHERE m.total_return_pct IS NOT NULL AND NOT isnan(m.total_return_pct) AND m.std_dev IS NOT NULL
  AND NOT isnan(m.std_dev) AND m.sharpe_ratio IS NOT NULL AND NOT isnan(m.sharpe_ratio)
  AND c.adjusted_expense_ratio >= 0 AND c.asset_under_management >= 0"""))
def q_c5(spark, sf):
    funds = silver.clean_funds(V.funds_raw(spark, sf))
    metrics = silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK)
    return rounded(C.gold(silver.enrich(funds, metrics)))


# ------------------------------------------------------------------ pages --

def _li_rows(spark, sf):
    return B.extract_rows(V.pages(spark, sf), row_pattern=B.LIST_ROW, cell_pattern=B.LINK_CELL)


@register("b1_extract_rows", O.with_(O.V_LI_ROWS) + """
SELECT page_id, row_pos, CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '|') AS cells_text FROM v_li""")
def q_b1(spark, sf):
    r = _li_rows(spark, sf)
    return r.select("page_id", "row_pos", F.size("cells").alias("n_cells"),
                    F.array_join("cells", "|").alias("cells_text"))


_NAME_RE = "<a[^>]*>(.*?)</a>"
_HREF_RE = 'href="([^"]*)"'


def _named_li(spark, sf):
    return B.extract_name_symbol(_li_rows(spark, sf), name_pattern=_NAME_RE, symbol_pattern=_HREF_RE)


_NAMED_SQL = O.with_(O.V_LI_ROWS, f"""v_named AS (
  SELECT page_id, row_pos, cells,
         trim(regexp_replace(regexp_extract(row_html, '{_NAME_RE}', 1), '<[^>]*>', '', 'g')) AS name,
         trim(regexp_replace(regexp_extract(row_html, '{_HREF_RE}', 1), '<[^>]*>', '', 'g')) AS symbol
  FROM v_li)""")


@register("b2_extract_name_symbol", _NAMED_SQL + """
SELECT page_id, row_pos, name, symbol FROM v_named WHERE name <> '' AND symbol <> ''""")
def q_b2(spark, sf):
    return _named_li(spark, sf).select("page_id", "row_pos", "name", "symbol")


@register("b3_zip_headers", O.with_(O.V_LI_ROWS) + """
SELECT page_id, row_pos, (['label', 'extra'])[i] AS key, cells[i] AS value
FROM v_li, range(1, 3) t(i) WHERE i <= len(cells)""")
def q_b3(spark, sf):
    z = B.zip_headers(_li_rows(spark, sf), ["label", "extra"])
    return z.select("page_id", "row_pos", F.explode("record").alias("key", "value"))


@register("b4_drop_bad_rows", O.with_(O.V_MIXED_ROWS) + """
SELECT page_id, row_pos, CAST(len(cells) AS INTEGER) AS n_cells FROM v_mixed WHERE len(cells) > 0""")
def q_b4(spark, sf):
    rows = B.extract_rows(V.pages(spark, sf), row_pattern=r"<(?:li|p)>(.*?)</(?:li|p)>", cell_pattern=B.LINK_CELL)
    kept, _rej = B.drop_bad_rows(rows)
    return kept.select("page_id", "row_pos", F.size("cells").alias("n_cells"))


_TIER_BY_REGION = ["usa", "big", "medium", "small", "frontier"]  # 'frontier' has no caps: rejected


def _crawl(spark, sf):
    n = V.table(spark, sf, "nation")
    tier = F.element_at(F.array(*[F.lit(t) for t in _TIER_BY_REGION]), (F.col("n_regionkey") + 1).cast("int"))
    countries = n.select(F.lower("n_name").alias("country"), tier.alias("tier"))
    sectors = (V.table(spark, sf, "part").select(F.col("p_type").alias("sector")).distinct()
               .withColumn("sector_class", F.when(F.col("sector") < "N", F.lit("heavy")).otherwise(F.lit("light"))))
    url = F.concat(F.lit("https://screener.example/"), F.col("country"), F.lit("/"), F.lower("sector"),
                   F.lit("?offset={i}&count=250"))
    return B.crawl_plan(countries, sectors, B.tier_caps(spark), url_template=url)


_CRAWL_SQL = """WITH countries AS (
  SELECT lower(n_name) AS country, (['usa', 'big', 'medium', 'small', 'frontier'])[n_regionkey + 1] AS tier
  FROM nation),
caps(tier, sector_class, max_pages) AS (VALUES ('usa', 'heavy', 5), ('usa', 'light', 5), ('big', 'heavy', 5),
  ('big', 'light', 5), ('medium', 'heavy', 5), ('medium', 'light', 4), ('small', 'heavy', 4), ('small', 'light', 3)),
sectors AS (SELECT DISTINCT p_type AS sector, CASE WHEN p_type < 'N' THEN 'heavy' ELSE 'light' END AS sector_class
            FROM part),
plan AS (SELECT c.country, c.tier, s.sector, s.sector_class, k.max_pages,
                'https://screener.example/' || c.country || '/' || lower(s.sector) || '?offset={i}&count=250'
                  AS url_template
         FROM countries c JOIN caps k ON c.tier = k.tier JOIN sectors s ON s.sector_class = k.sector_class)
"""


@register("b12_crawl_plan", _CRAWL_SQL + "SELECT country, tier, sector, sector_class, max_pages, url_template FROM plan")
def q_b12(spark, sf):
    plan, _rej = _crawl(spark, sf)
    return plan.select("country", "tier", "sector", "sector_class", "max_pages", "url_template")


@register("b12_crawl_rejects", _CRAWL_SQL + "SELECT country, tier FROM countries WHERE tier NOT IN (SELECT tier FROM caps)")
def q_b12r(spark, sf):
    _plan, rej = _crawl(spark, sf)
    return rej.select("country", "tier")


@register("b5_page_offsets", _CRAWL_SQL + """
SELECT country, sector, CAST(page AS INTEGER) AS page, CAST(page * 250 AS INTEGER) AS offset,
       replace(url_template, '{i}', CAST(page * 250 AS VARCHAR)) AS url
FROM plan, range(0, 5) t(page) WHERE page < max_pages""")
def q_b5(spark, sf):
    plan, _rej = _crawl(spark, sf)
    return B.page_offsets(plan).select("country", "sector", "page", "offset", "url")


_HOST_RE = "^https?://([^/?#]+)"


@register("b6_until_empty_page", f"""
WITH p AS (SELECT regexp_extract(url, '{_HOST_RE}', 1) AS feed, page_id,
                  NOT regexp_matches(html, '<li><a href="/[A-Z]') AS is_empty FROM pages),
w AS (SELECT *, sum(CASE WHEN is_empty THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY page_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
             row_number() OVER (PARTITION BY feed ORDER BY page_id) AS rk FROM p)
SELECT feed, page_id FROM w WHERE seen = 0 AND rk <= 3""")
def q_b6(spark, sf):
    p = V.pages(spark, sf).select(F.regexp_extract("url", _HOST_RE, 1).alias("feed"), F.col("page_id").alias("page"),
                                  (~F.col("html").rlike('<li><a href="/[A-Z]')).alias("is_empty"))
    return B.until_empty_page(p, cap=3).select("feed", F.col("page").alias("page_id"))


@register("b7_dedupe_first", _NAMED_SQL + """
SELECT name, page_id, row_pos, symbol FROM (
  SELECT name, page_id, row_pos, symbol,
         row_number() OVER (PARTITION BY name ORDER BY page_id, row_pos) AS rn
  FROM v_named WHERE name <> '' AND symbol <> '') x WHERE rn = 1""")
def q_b7(spark, sf):
    return B.dedupe_first(_named_li(spark, sf).select("name", "page_id", "row_pos", "symbol"))


def _para_rows(spark, sf):
    r = B.extract_rows(V.pages(spark, sf), row_pattern=r"<p>(.*?)</p>", cell_pattern=r"^(.*)$")
    from marketflow.functions.text import strip_tags
    return r.select("page_id", "row_pos", strip_tags("row_html").alias("para"))


@register("b8_merge_tabs", O.with_(O.V_LI_ROWS, O.V_PARA_ROWS) + """
SELECT t0.page_id AS feed, t0.row_pos AS pos, coalesce(t1.para, t0.cells[1]) AS name,
       t0.cells[1] AS link_text, coalesce(CAST(length(t1.para) AS INTEGER), 0) AS para_len,
       t1.para IS NOT NULL AS has_para
FROM v_li t0 LEFT JOIN v_para t1 ON t0.page_id = t1.page_id AND t0.row_pos = t1.row_pos""")
def q_b8(spark, sf):
    tab0 = _li_rows(spark, sf).select(F.col("page_id").alias("feed"), F.col("row_pos").alias("pos"),
                                      F.get("cells", 0).alias("name"), F.get("cells", 0).alias("link_text"))
    tab1 = _para_rows(spark, sf).select(F.col("page_id").alias("feed"), F.col("row_pos").alias("pos"),
                                        F.col("para").alias("name"), F.length("para").alias("para_len"))
    tab1 = tab1.withColumn("has_para", F.lit(True))
    m = B.merge_tabs([tab0, tab1])
    return m.select("feed", "pos", "name", "link_text", F.coalesce("para_len", F.lit(0)).alias("para_len"),
                    F.coalesce("has_para", F.lit(False)).alias("has_para"))


@register("b9_union_feeds", O.with_(O.V_LI_ROWS, O.V_PARA_ROWS) + """
SELECT 'nav' AS category, page_id, row_pos, cells[1] AS text, CAST(len(cells) AS INTEGER) AS n_links,
       'pages' AS fund_type FROM v_li
UNION ALL
SELECT 'article', page_id, row_pos, para, CAST(0 AS INTEGER), 'pages' FROM v_para""")
def q_b9(spark, sf):
    nav = _li_rows(spark, sf).select("page_id", "row_pos", F.get("cells", 0).alias("text"),
                                     F.size("cells").alias("n_links"))
    art = _para_rows(spark, sf).select("page_id", "row_pos", F.col("para").alias("text"))
    out = B.union_feeds({"nav": nav, "article": art}, tags={"fund_type": "pages"})
    return out.select("category", "page_id", "row_pos", "text", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      "fund_type")


@register("b13_cache", _CRAWL_SQL + """,
writes AS (SELECT 'nation_' || CAST(p_partkey % 23 AS VARCHAR) || '_' || lower(p_type) AS cache_key,
                  'https://screener.example/q/' || CAST(p_partkey AS VARCHAR) || '?offset={i}&count=250' AS url,
                  p_partkey AS written_at FROM part),
cache AS (SELECT cache_key, arg_max(url, written_at) AS url FROM writes GROUP BY cache_key)
SELECT r.cache_key, c.url, c.url IS NOT NULL AS hit
FROM (SELECT lower(country) || '_' || lower(sector) AS cache_key FROM plan) r LEFT JOIN cache c
  ON r.cache_key = c.cache_key""")
def q_b13(spark, sf):
    plan, _rej = _crawl(spark, sf)
    p = V.table(spark, sf, "part")
    writes = p.select(
        F.concat(F.lit("nation_"), (F.col("p_partkey") % 23).cast("string"), F.lit("_"),
                 F.lower("p_type")).alias("cache_key"),
        F.concat(F.lit("https://screener.example/q/"), F.col("p_partkey").cast("string"),
                 F.lit("?offset={i}&count=250")).alias("url"),
        F.col("p_partkey").alias("written_at"))
    cache = B.cache_upsert(writes)
    req = plan.select(B.cache_key("country", "sector").alias("cache_key"))
    looked, _miss = B.cache_lookup(req, cache)
    return looked.select("cache_key", "url", "hit")


# ----------------------------------------------------- files & models -----

from marketflow.constants import ETF_FIELD_NAMES, ETF_TABS, N_TRIALS, SEARCH_RANGES, SURVEY_RENAMES  # noqa: E402
from marketflow.operators import models as M  # noqa: E402
from marketflow.operators.split import split_bronze, split_payload_keys  # noqa: E402
from marketflow.session import materialize, scratch_path  # noqa: E402
from marketflow.sources.cache import fill_cache, read_cache, store_cache  # noqa: E402
from marketflow.sources import files as FS  # noqa: E402
from marketflow.sources.prices import commodity_series  # noqa: E402


@register("a4_read_ndjson", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer""")
def q_a4(spark, sf):
    path = scratch_path(spark, "ndjson-customer")
    FS.write_ndjson(V.table(spark, sf, "customer"), path)  # A6
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return rounded(FS.read_ndjson(spark, path, schema=schema))  # A4


_SURVEY_OUT = {v: k for k, v in SURVEY_RENAMES.items()}


@register("a7_read_survey_csv", O.with_(O.V_FORMS, O.V_FEATURES) + """
SELECT investor_id, round(age, 6) AS age, education, occupation, round(kids, 6) AS kids,
       round(income, 6) AS income, round(net_worth, 6) AS net_worth, risk, married,
       round(TrueRiskTol, 6) AS TrueRiskTol FROM v_features""")
def q_a7(spark, sf):
    feats = E.feature_order(E.encode_form(V.forms(spark, sf)), keep=("investor_id",))
    survey = feats.withColumnsRenamed(_SURVEY_OUT).withColumn("LIFECL07", F.lit(1)).withColumn("WSAVED07", F.lit(2))
    path = scratch_path(spark, "survey-csv")
    FS.write_csv(survey, path)  # A8
    schema = ("investor_id long, AGE07 double, EDCL07 int, OCCAT107 int, KIDS07 double, INCOME07 double, "
              "NETWORTH07 double, RISK07 int, MARRIED07 int, TrueRiskTol double, LIFECL07 int, WSAVED07 int")
    back = FS.read_survey_csv(spark, path, schema=schema)  # A7
    return rounded(E.feature_order(E.rename_survey(back), keep=("investor_id",)))  # E3, E4


@register("a10_commodity_series", """
SELECT event_type AS commodity, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(value, 6) AS value FROM events""")
def q_a10(spark, sf):
    ev = V.table(spark, sf, "events")
    point = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("value"))
    body = F.to_json(F.struct(F.array(point).alias("data")))
    resp = ev.select(F.col("event_type").alias("commodity"), body.alias("body"))
    out = commodity_series(resp)
    return rounded(out.withColumn("date", F.col("date").cast("string")))   # ISO text for the comparison


def _features_labelled(spark, sf):
    f = E.feature_order(E.encode_form(V.forms(spark, sf)), keep=("investor_id",))
    return f.withColumnRenamed("TrueRiskTol", "label")


@register("e5_split", """
SELECT c_custkey AS investor_id,
       CASE WHEN CAST('0x' || substr(md5('42:' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000
            THEN 'test' ELSE 'train' END AS part FROM customer""")
def q_e5(spark, sf):
    f = _features_labelled(spark, sf)
    tr, te = E.split(f, "investor_id")
    return tr.select("investor_id", F.lit("train").alias("part")).unionByName(
        te.select("investor_id", F.lit("test").alias("part")))


def _stats_sql():
    parts = []
    for c in E.FEATURE_COLUMNS:
        parts.append(f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
                     f"round(stddev_pop(CAST({c} AS DOUBLE)), 6) AS sd FROM v_features")
    return _FEATURES_SQL + "\nUNION ALL\n".join(parts)


@register("e7_scaler_roundtrip", _stats_sql())
def q_e7(spark, sf):
    feats = E.encode_form(V.forms(spark, sf))
    path = scratch_path(spark, "scaler")
    E.save_scaler(E.fit_scaler(feats), path)
    return rounded(E.scaler_long(E.load_scaler(spark, path)))


# Model sizes of the training queries: the lower end of the search ranges (MLlib runs a job per tree level).
_FOREST = {"n_estimators": 50, "max_depth": 10}
_BOOSTED = {"n_estimators": 50, "max_depth": 3}
_COMPLETE_ROW = " AND ".join(f"{c} IS NOT NULL" for c in E.FEATURE_COLUMNS)
_IS_TEST = "CAST('0x' || substr(md5('42:' || CAST(investor_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000"


@register("e8_train", _FEATURES_SQL + f"""
SELECT m.model, CAST(m.ordinal AS INTEGER) AS ordinal, (SELECT count(*) FROM v_features WHERE {_COMPLETE_ROW} AND {_IS_TEST}) AS n,
       true AS below_mean_predictor, CAST(3 AS BIGINT) AS n_distinct_errors
FROM (VALUES ('forest', 0), ('boosted_a', 1), ('boosted_b', 2)) m(model, ordinal)""")
def q_e8(spark, sf):
    """The three models; a fitted error has no SQL counterpart, so each is
    held against the error of always predicting the mean label."""
    f = _features_labelled(spark, sf)
    tr, te = E.split(f, "investor_id")
    sc = E.fit_scaler(tr)
    trs, tes = E.scale(tr, sc), E.scale(te, sc).dropna()
    mean = tr.dropna().agg(F.avg("label")).first()[0]
    out = None
    for i, kind in enumerate(M.MODEL_KINDS):
        m = M.train(trs, kind, params=_FOREST if kind == "forest" else _BOOSTED)
        pred = M.predict(m, tes).withColumn("model", F.lit(kind)).withColumn("ordinal", F.lit(i))
        err = E.regression_error(pred, group=("model", "ordinal"))
        out = err if out is None else out.unionByName(err)
    out = materialize(out, "train-errors", partitions=None)
    base = tes.agg(F.avg(F.pow(F.col("label") - mean, 2))).first()[0]
    different = out.select(F.round("mse", 6)).distinct().count()
    return out.select("model", "ordinal", "n", (F.col("mse") < base).alias("below_mean_predictor"),
                      F.lit(different).cast("long").alias("n_distinct_errors"))


@register("e9_tune", _FEATURES_SQL + f"""
SELECT m.model, r.rung, r.trees, r.n_trials, n.n, true AS in_search_range, true AS best_below_mean_predictor
FROM (VALUES ('forest'), ('boosted_a'), ('boosted_b')) m(model),
     (VALUES (0, 1, CAST({N_TRIALS} AS BIGINT)), (1, 4, CAST({N_TRIALS // 4} AS BIGINT)), (2, 16, CAST(1 AS BIGINT))) r(rung, trees, n_trials),
     (SELECT count(*) AS n FROM v_features WHERE {_COMPLETE_ROW} AND NOT ({_IS_TEST})) n""")
def q_e9(spark, sf):
    """All trials of the three kinds by successive halving; a fitted error has no
    SQL counterpart, so the best is held against the mean predictor's."""
    tr, _te = E.split(_features_labelled(spark, sf), "investor_id")
    tr = E.scale(tr, E.fit_scaler(tr))
    spread = tr.dropna().agg(F.var_pop("label")).first()[0]          # error of the mean predictor
    out = []
    for kind in M.MODEL_KINDS:
        runs = M.halving(tr, kind, first_trees=1, parallelism=8)
        ranges = SEARCH_RANGES["forest" if kind == "forest" else "boosted"]
        for rung in sorted({r["rung"] for r in runs}):
            mine = [r for r in runs if r["rung"] == rung]
            fits = all(v in span if isinstance(span, list) else span[0] <= v <= span[1]
                       for r in mine for name, span in ranges.items() for v in [r["params"][name]])
            out.append((kind, rung, max(r["trees"] for r in mine), len(mine), mine[0]["n"], fits, runs[-1]["mse"] < spread))
    return spark.createDataFrame(out, "model string, rung int, trees int, n_trials long, n long, in_search_range boolean, best_below_mean_predictor boolean")


@register("e13_score", _FEATURES_SQL + f"""
SELECT investor_id, {_COMPLETE_ROW} AS accepted, CASE WHEN {_COMPLETE_ROW} THEN true END AS in_label_range,
       CASE WHEN {_COMPLETE_ROW} THEN true END AS bracket_fits
FROM v_features""")
def q_e13(spark, sf):
    """Payloads with a missing field are rejected; an estimate lies within
    the labels the forest was trained on, and its bracket is the estimate's."""
    from marketflow.functions.finance import bracket_return
    f = _features_labelled(spark, sf)
    tr, _te = E.split(f, "investor_id")
    sc = E.fit_scaler(tr)
    model = M.train(E.scale(tr, sc), "forest", params=_FOREST)
    payload = F.to_json(F.struct(*[F.col(c).cast("double").alias(c) for c in E.FEATURE_COLUMNS]))
    scored, bad = M.score_payloads(f.select("investor_id", payload.alias("payload")), sc, model, keep=("investor_id",))
    low, high = tr.agg(F.min("label"), F.max("label")).first()
    est = F.col("risk_aversion_estimate")
    ok = G.with_risk_bracket(scored, "risk_aversion_estimate").select(
        "investor_id", F.lit(True).alias("accepted"), est.between(low, high).alias("in_label_range"),
        (bracket_return(est) == F.col("annual_return")).alias("bracket_fits"))
    none = F.lit(None).cast("boolean")
    return ok.unionByName(bad.select("investor_id", F.lit(False).alias("accepted"), none.alias("in_label_range"),
                                     none.alias("bracket_fits")))


# -------------------------------------------------------------- streaming --

from marketflow.streaming import bronze as SB  # noqa: E402
from marketflow.streaming import sessions as SS  # noqa: E402


@register("a3_bronze_stream", O.with_(O.V_MESSAGES) + """
SELECT CASE WHEN json_valid(value) THEN json_extract_string(value, '$.type') END AS message_type,
       CASE WHEN json_valid(value) THEN json_extract_string(value, '$.data') END AS data
FROM v_messages""")
def q_a3(spark, sf):
    """A1 -> A2 -> A3 as a bounded stream: envelope text files -> bronze JSON
    partitioned by message type, several micro-batches."""
    src, sink, ck = (scratch_path(spark, n) for n in ("bronze-src", "bronze", "bronze-ckpt"))
    V.messages(spark, sf).select("value").write.text(src)
    q = SB.bronze_stream(spark, sink, ck, source_fmt="text", source_path=src,
                         source_options={"maxFilesPerTrigger": "1"}, available_now=True)
    q.awaitTermination()
    return spark.read.schema("data string, message_type string").json(sink)


@register("c4_keep_new_stream", """
SELECT event_id, user_id, event_type,
       round(CASE WHEN event_type = 'click' THEN value + 1 ELSE value END, 6) AS value, props FROM events
WHERE ts < TIMESTAMP '2024-01-15'
UNION ALL
SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM events
WHERE ts >= TIMESTAMP '2024-01-15' OR event_type = 'click'""")
def q_c4s(spark, sf, buckets=None):
    """C4 exact, streaming: an early snapshot, then the full snapshot re-sent
    with changed clicks; only unseen or changed records reach the sink."""
    ev = V.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    early = (ev.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
               .withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1)
                                     .otherwise(F.col("value"))))
    src, sink, ck = (scratch_path(spark, n) for n in ("keepnew-src", "keepnew", "keepnew-ckpt"))
    early.drop("ts").write.parquet(f"{src}/b1")   # the first snapshot
    ev.drop("ts").write.parquet(f"{src}/b2")      # the second, written later
    schema = "event_id long, user_id long, event_type string, value double, props string"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    SB.keep_new_stream(stream, sink, ck, keys=["event_id"], available_now=True, buckets=buckets).awaitTermination()
    return rounded(spark.read.parquet(sink).select("event_id", "user_id", "event_type", "value", "props"))


@register("c4_keep_new_buckets", ORACLE["c4_keep_new_stream"])
def q_c4b(spark, sf):
    """C4 exact, streaming, from a sink in hash buckets of the key."""
    return q_c4s(spark, sf, buckets=8)


@register("c4_keep_new_state", ORACLE["c4_keep_new_stream"])
def q_c4st(spark, sf):
    """C4 exact, streaming, with keyed state (RocksDB): the same two
    snapshots as ``c4_keep_new_stream``; seen (key, content) pairs live in
    the state store instead of being re-read from the sink."""
    ev = V.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    early = (ev.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
               .withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1)
                                     .otherwise(F.col("value"))))
    src, sink, ck = (scratch_path(spark, n) for n in ("keepstate-src", "keepstate", "keepstate-ckpt"))
    early.drop("ts").write.parquet(f"{src}/b1")
    ev.drop("ts").write.parquet(f"{src}/b2")
    schema = "event_id long, user_id long, event_type string, value double, props string"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    SB.keep_new_state_stream(stream, sink, ck, keys=["event_id"], available_now=True).awaitTermination()
    return rounded(spark.read.parquet(sink).select("event_id", "user_id", "event_type", "value", "props"))


def _sliced_session_events(spark, sf, name, run, change=lambda ev: ev):
    """Session events as three time slices of several files each; a slice
    arrives when the one before it has been processed (``run(stream)``)."""
    ev = change(V.session_events(spark, sf).select("conv_id", "ts", "event_id", "intent"))
    src = scratch_path(spark, name)
    cuts = [F.lit(c).cast("timestamp_ntz") for c in ("2024-01-11", "2024-01-21")]
    ts = F.col("ts")
    for k, cond in enumerate([ts < cuts[0], (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]]):
        ev.filter(cond).repartition(4).write.parquet(f"{src}/part{k}")
        run(spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").parquet(src)).awaitTermination()


_SESSION_COLUMNS = ("conv_id", "event_id", "intent", "introduction_state", "profiling_state", "preferences_state", "route")


@register("f10_session_stream", ORACLE["f10_session_state"].replace(
    "SELECT conv_id, event_id, ts, intent,", "SELECT conv_id, event_id, intent,"))
def q_f10s(spark, sf):
    """F10 with keyed streaming state: slice after slice of the session
    events; output written to a parquet sink."""
    sink, ck = (scratch_path(spark, n) for n in ("sess", "sess-ckpt"))

    def run(stream):
        with SB.state_store(spark):        # keyed state in RocksDB, not in executor heap
            return (SS.session_state_stream(stream).writeStream.format("parquet").outputMode("append")
                    .option("checkpointLocation", ck).trigger(availableNow=True).start(sink))
    _sliced_session_events(spark, sf, "sess-src", run)
    return spark.read.parquet(sink).select(*_SESSION_COLUMNS)


@register("f10_session_batches", ORACLE["f10_session_stream"])
def q_f10b(spark, sf):
    """F10 on a stream, each micro-batch run by the skew-safe batch operator
    seeded with the carried state, slice after slice."""
    sink, state, ck = (scratch_path(spark, n) for n in ("sessb", "sessb-state", "sessb-ckpt"))
    _sliced_session_events(spark, sf, "sessb-src", lambda stream: SS.session_state_batches(
        stream, sink, state, ck, available_now=True, compact_every=2))
    return spark.read.parquet(sink).select(*_SESSION_COLUMNS)


_SPLIT = {"hot_rows": 2, "rows_per_bucket": 500}      # every key is split, so the bucketed plans meet the plain oracles

# Text keys, one conversation in eleven without a key: together they are the NULL conversation.
_KEYED_SQL = O.with_(O.V_SESSION.replace("user_id AS conv_id", "CASE WHEN user_id % 11 <> 0 THEN 'c-' || user_id END AS conv_id"))


def _keyed(ev):
    return ev.withColumn("conv_id", F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("c-"), F.col("conv_id"))))


_KEYED_ORACLE = ORACLE["f10_session_stream"].replace(O.with_(O.V_SESSION), _KEYED_SQL)


@register("f10_session_stream_keys", _KEYED_ORACLE)
def q_f10sk(spark, sf):
    """The keyed stream with text keys and a NULL conversation of many events,
    whose bursts are merged from pieces in the state store."""
    sink, ck = (scratch_path(spark, n) for n in ("sessk", "sessk-ckpt"))

    def run(stream):
        with SB.state_store(spark):
            return (SS.session_state_stream(stream, piece=500, fan=2).writeStream.format("parquet").outputMode("append")
                    .option("checkpointLocation", ck).trigger(availableNow=True).start(sink))
    _sliced_session_events(spark, sf, "sessk-src", run, _keyed)
    return spark.read.parquet(sink).select(*_SESSION_COLUMNS)


@register("f10_session_batches_keys", _KEYED_ORACLE)
def q_f10bk(spark, sf):
    sink, state, ck = (scratch_path(spark, n) for n in ("sessbk", "sessbk-state", "sessbk-ckpt"))
    _sliced_session_events(spark, sf, "sessbk-src", lambda stream: SS.session_state_batches(
        stream, sink, state, ck, available_now=True, compact_every=2), _keyed)
    return spark.read.parquet(sink).select(*_SESSION_COLUMNS)


_IDLE_DAYS = 2
_IDLE_SQL = (O.with_(O.V_SESSION, f"""v_visit AS (
  SELECT *, sum(gap) OVER (PARTITION BY conv_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts, event_id) > INTERVAL {_IDLE_DAYS} DAY THEN 1 ELSE 0 END AS gap
        FROM v_session) g)""")
             + ORACLE["f10_session_stream"][len(O.with_(O.V_SESSION)):].replace("FROM v_session", "FROM v_visit")
             .replace("PARTITION BY conv_id", "PARTITION BY conv_id, visit"))


@register("f10_session_idle", _IDLE_SQL)
def q_f10i(spark, sf):
    st = S.session_state(V.session_events(spark, sf), order=("ts", "event_id"), idle_seconds=_IDLE_DAYS * 86_400)
    return st.select(*_SESSION_COLUMNS)


@register("f10_session_idle_split", _IDLE_SQL)
def q_f10is(spark, sf):
    st = S.session_state(V.session_events(spark, sf), order=("ts", "event_id"), idle_seconds=_IDLE_DAYS * 86_400, **_SPLIT)
    return st.select(*_SESSION_COLUMNS)


@register("f10_session_stream_idle", _IDLE_SQL)
def q_f10si(spark, sf):
    """The keyed stream whose silent conversations are removed by event-time timers."""
    sink, ck = (scratch_path(spark, n) for n in ("sessi", "sessi-ckpt"))

    def run(stream):
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
        with SB.state_store(spark):
            return (SS.session_state_stream(stream, idle_seconds=_IDLE_DAYS * 86_400).writeStream.format("parquet").outputMode("append")
                    .option("checkpointLocation", ck).trigger(availableNow=True).start(sink))
    _sliced_session_events(spark, sf, "sessi-src", run)
    return spark.read.parquet(sink).select(*_SESSION_COLUMNS)


@register("d9_daily_return_split", ORACLE["d9_daily_return"])
def q_d9_split(spark, sf):
    return rounded(silver.daily_returns(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK, **_SPLIT))


@register("d13_symbol_metrics_split", ORACLE["d13_symbol_metrics"])
def q_d13_split(spark, sf):
    return rounded(silver.symbol_metrics(V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK, piece=5 * 86_400))


@register("f10_session_state_split", ORACLE["f10_session_state"])
def q_f10_split(spark, sf):
    st = S.session_state(V.session_events(spark, sf), order=("ts", "event_id"), **_SPLIT)
    return st.select("conv_id", "event_id", "ts", "intent", "introduction_state", "profiling_state",
                     "preferences_state", "route")


@register("b6_until_empty_page_split", ORACLE["b6_until_empty_page"])
def q_b6_split(spark, sf):
    p = V.pages(spark, sf).select(F.regexp_extract("url", _HOST_RE, 1).alias("feed"), F.col("page_id").alias("page"),
                                  (~F.col("html").rlike('<li><a href="/[A-Z]')).alias("is_empty"))
    return B.until_empty_page(p, cap=3, hot_rows=2, rows_per_bucket=20).select("feed", F.col("page").alias("page_id"))


_FILL_SQL = O.with_(O.V_PRICES, """v_gaps AS (
  SELECT symbol, ts, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE adj_close END AS p FROM v_prices)""",
                    """v_fill AS (
  SELECT symbol, ts, l_orderkey, l_linenumber,
         last_value(p IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj_close FROM v_gaps)""") + """
SELECT symbol, ts, l_orderkey, l_linenumber, round(adj_close, 6) AS adj_close, round(prev, 6) AS prev_price,
       round(adj_close / nullif(prev, 0) - 1, 6) AS daily_return
FROM (SELECT *, lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber) AS prev FROM v_fill) t"""


def _gap_prices(spark, sf):
    return V.prices(spark, sf).withColumn("adj_close", F.when(F.col("l_linenumber") % 3 != 0, F.col("adj_close")))


@register("d9_daily_return_fill", _FILL_SQL)
def q_d9_fill(spark, sf):
    return rounded(silver.daily_returns(_gap_prices(spark, sf), tiebreak=V.PRICE_TIEBREAK, fill=True))


@register("d9_daily_return_fill_split", _FILL_SQL)
def q_d9_fill_split(spark, sf):
    return rounded(silver.daily_returns(_gap_prices(spark, sf), tiebreak=V.PRICE_TIEBREAK, fill=True, **_SPLIT))


_COMPLETE = " AND ".join(f"f.{c} IS NOT NULL" for c in E.FEATURE_COLUMNS)


@register("profile_investors", O.with_(O.V_FORMS, O.V_FEATURES, O.V_GOALS, O.V_GOALS_EVAL) + f"""
SELECT e.goal_id, e.investor_id, NOT ({_COMPLETE}) AS rejected,
       CASE WHEN {_COMPLETE} THEN '' ELSE concat_ws(',', {", ".join(f"CASE WHEN f.{c} IS NULL THEN '{c}' END" for c in E.FEATURE_COLUMNS)}) END
         AS failed_fields,
       CASE WHEN {_COMPLETE} THEN true END AS rate_fits_estimate, e.is_specific, e.is_measurable, e.is_time,
       true AS outcome_fits_value
FROM v_eval e JOIN v_features f ON f.investor_id = e.investor_id""")
def q_profile(spark, sf):
    """SURVEY §3.3 end to end: forms -> model risk -> bracket; goals with the
    bracket rate -> outcome.  The trained estimate has no SQL counterpart, so
    the query checks what must hold for it: the label range, the bracket of
    the estimate, the outcome by the future value, and who is rejected."""
    from marketflow.functions.finance import bracket_return
    from marketflow.plans.jobs import profile_investors
    f = _features_labelled(spark, sf)
    tr, _te = E.split(f, "investor_id")
    sc = E.fit_scaler(tr)
    model = M.train(E.scale(tr, sc), "forest", params=_FOREST)
    inv, _alloc, ev, rejected = profile_investors(V.forms(spark, sf), V.goals(spark, sf), sc, model)
    low, high = tr.agg(F.min("label"), F.max("label")).first()
    est = F.col("risk_aversion_estimate")
    inv = inv.select("investor_id", (est.between(low, high) & (bracket_return(est) == F.col("annual_return"))).alias("_in_range"),
                     F.col("annual_return").alias("_rate"))
    j = ev.join(inv, "investor_id", "left").join(rejected, "investor_id", "left")
    smart = F.col("is_specific") & F.col("is_measurable") & F.col("is_time") & (F.col("future_value") >= F.col("target_value"))
    return j.select("goal_id", "investor_id", F.col("failed_fields").isNotNull().alias("rejected"),
                    F.coalesce("failed_fields", F.lit("")).alias("failed_fields"),
                    (F.col("_in_range") & F.col("annual_return").eqNullSafe(F.col("_rate"))).alias("rate_fits_estimate"),
                    "is_specific", "is_measurable", "is_time",
                    (F.coalesce(smart, F.lit(False)) == (F.col("outcome") == "smart")).alias("outcome_fits_value"))


@register("medallion_funds", FLAGSHIP_SQL)
def q_medallion(spark, sf):
    """Raw fund records -> envelopes per fund type (A5) -> decoded (A2) ->
    bronze table partitioned by message type -> unnested (D16) -> silver
    job (D15).  The round trip is lossless, so the result equals d15."""
    from marketflow.plans.jobs import silver_from_bronze, write_bronze_batch
    from marketflow.schemas import RAW_FUND
    raw = V.funds_raw(spark, sf)
    packed = A.publish_feed(raw, "fund_type", [f.name for f in RAW_FUND.fields])
    path = scratch_path(spark, "bronze-funds")
    write_bronze_batch(A.decode_envelope(packed), path)
    return rounded(silver_from_bronze(spark, path, V.prices(spark, sf), tiebreak=V.PRICE_TIEBREAK))


_FEED_FUNDS = O.V_FUNDS.replace("p_brand", f"({FUND_TYPES!r})[p_partkey % 7 + 1]")


@register("medallion_feeds", FLAGSHIP_SQL.replace(O.V_FUNDS, _FEED_FUNDS))
def q_medallion_feeds(spark, sf):
    """All seven fund feeds from their cells: layout (B10), feed constants
    (B11), fund record, envelopes (A5), decoded (A2), bronze, unnested (D16),
    silver job (D15)."""
    from marketflow.plans.jobs import silver_from_bronze, write_bronze_batch
    named = B.add_fund_constants(B.apply_fund_layout(V.fund_cells(spark, sf)))
    packed = A.publish_feed(B.fund_records(named), "fund_type", [f.name for f in RAW_FUND.fields])
    path = scratch_path(spark, "bronze-feeds")
    write_bronze_batch(A.decode_envelope(packed), path)
    return rounded(silver_from_bronze(spark, path, V.prices(spark, sf), message_types=FUND_TYPES,
                                      tiebreak=V.PRICE_TIEBREAK))


# ------------------------------------------------ further forms of operators --

def _layout_sql():
    from marketflow.constants import FEED_CONSTANTS, FEED_LAYOUTS
    names = []
    for cols in FEED_LAYOUTS.values():
        names += [c for c in cols if c not in names]
    value = {"adjusted_expense_ratio": "adjusted_expense_ratio", "asset_under_management": "asset_under_management",
             "fund_size": "asset_under_management"}
    out = []
    for n in names:
        feeds = ", ".join(f"'{t}'" for t, cols in FEED_LAYOUTS.items() if n in cols)
        out.append(f"CASE WHEN fund_type IN ({feeds}) THEN {value.get(n, repr(n))} END AS {n}")
    for i, c in ((0, "region"), (1, "funds_repartition_strategy")):
        cases = " ".join(f"WHEN '{t}' THEN '{v[i]}'" for t, v in FEED_CONSTANTS.items() if v[i] is not None)
        out.append(f"CASE fund_type {cases} END AS {c}")
    return O.with_(_FEED_FUNDS) + "SELECT DISTINCT name, symbol, category, fund_type, " + ", ".join(out) + " FROM v_funds"


@register("b10_fund_layouts", _layout_sql())
def q_b10_funds(spark, sf):
    """B10 and B11 for the seven fund feeds."""
    return B.add_fund_constants(B.apply_fund_layout(V.fund_cells(spark, sf)))


_TR_SQL = """
SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag,
                               l_linestatus) - 1 AS INTEGER) AS row_pos,
       'F' || CAST(l_partkey AS VARCHAR) || ' & Co' AS name, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
       CAST(l_linenumber AS VARCHAR) || '|<' || l_returnflag || '> ''n''|' || l_linestatus AS cells_text
FROM lineitem"""


@register("b1_table_rows", _TR_SQL)
def q_b1_tables(spark, sf):
    """B1 and B2 on table markup: a page per order, a row per line with
    attributes, line breaks and character references in its cells."""
    li = V.table(spark, sf, "lineitem")
    row = F.concat(F.lit('<tr class="r"><th scope="row">\n<a href="#">F'), F.col("l_partkey").cast("string"),
                   F.lit(" &amp; Co</a><div class='s'>\n S"), F.col("l_suppkey").cast("string"),
                   F.lit("</div></th><td>"), F.col("l_linenumber").cast("string"), F.lit("</td>\n<td id='x'> &lt;<b>"),
                   F.col("l_returnflag"), F.lit("</b>&gt; &#39;n&#x27; </td><td>\n"), F.col("l_linestatus"), F.lit("\n</td></tr>\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", row.alias("r")))), lambda x: x["r"]), "")
    pages = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    got = B.extract_name_symbol(B.extract_rows(pages))
    return got.select("page_id", "row_pos", "name", "symbol", F.array_join("cells", "|").alias("cells_text"))


_NESTED_SQL = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem)
SELECT l_orderkey AS page_id, CAST(0 AS INTEGER) AS table_pos, CAST(NULL AS INTEGER) AS parent_pos, CAST(i AS INTEGER) AS row_pos,
       'F' || l_partkey || ' & Co' AS name, 'S' || l_suppkey AS symbol, l_linenumber || '|' || l_linestatus || chr(233) AS cells_text FROM l
UNION ALL
SELECT l_orderkey, CAST(i + 1 AS INTEGER), 0, 0, NULL, NULL, 'in ' || l_returnflag FROM l"""


@register("b1_nested_tables", _NESTED_SQL)
def q_b1_nested(spark, sf):
    """B1 and B2 by the parser: a table in a cell of each row, row ends left
    out, a comment, a script and an attribute that hold markup."""
    from marketflow.operators.markup import table_rows
    li = V.table(spark, sf, "lineitem")
    row = F.concat(F.lit('<tr><th><a title="a>b" href="#">F'), F.col("l_partkey").cast("string"), F.lit(" &amp; Co</a>\n<div>S"), F.col("l_suppkey").cast("string"),
                   F.lit("</div><td>"), F.col("l_linenumber").cast("string"), F.lit("<table><tr><td>in "), F.col("l_returnflag"),
                   F.lit("<!-- <tr><td>no</td></tr> --></table><td>"), F.col("l_linestatus"), F.lit('<script>var t = "</td></tr></table>";</script>&eacute;\n'))
    key = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, row.alias("r")))), lambda x: x["r"]), "")
    pages = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    return table_rows(pages).select("page_id", "table_pos", "parent_pos", "row_pos", "name", "symbol", F.array_join("cells", "|").alias("cells_text"))


_ETF_PLACES = [(t, j, ETF_FIELD_NAMES[n]) for t, names in enumerate(ETF_TABS) for j, n in enumerate(names) if j]


def _etf_sql():
    kinds = {f.name: f.dataType.simpleString() for f in MODELS["etf"].fields}
    def cell(t, j, f):
        v = f"CAST((t{t}.k * {t + 1} + {j}) % 1000 AS VARCHAR)"
        if kinds[f] == "string":
            return f"'x' || {v} AS {f}"
        return f"CAST({f'CASE WHEN t{t}.k % 13 <> 0 THEN {v} END' if (t, j) == (2, 1) else v} AS {kinds[f].upper()}) AS {f}"
    joins = " ".join(f"LEFT JOIN n t{t} ON t{t}.tab = {t} AND t{t}.feed = t0.feed AND t{t}.pos = t0.pos" for t in range(1, 6))
    names = ", ".join(f"t{t}.name" for t in range(5, -1, -1))
    fields = [f.name for f in MODELS["etf"].fields]
    return f"""
WITH l AS (SELECT p_brand AS feed, p_partkey AS k, tab, p_partkey // 50 AS page, 0 AS again FROM part, range(6) r(tab)
           UNION ALL SELECT p_brand, p_partkey, tab, p_partkey // 50 - 1, 1 FROM part, range(6) r(tab) WHERE p_partkey % 50 < 3 AND p_partkey >= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY feed, tab, k ORDER BY page, again) AS nth FROM l WHERE NOT (tab = 5 AND k % 7 = 0)),
n AS (SELECT feed, tab, k, 'E & F ' || k AS name, row_number() OVER (PARTITION BY feed, tab ORDER BY page, again, k) - 1 AS pos FROM f WHERE nth = 1),
m AS (SELECT t0.pos, coalesce({names}) AS name, {", ".join(cell(*p) for p in _ETF_PLACES)}, t0.feed AS management FROM n t0 {joins} WHERE t0.tab = 0),
x AS (SELECT pos, {", ".join(fields)}, concat_ws(',', {", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fields)}) AS failed_fields FROM m)
SELECT *, failed_fields = '' AS is_valid FROM x"""


@register("etf_records", _etf_sql())
def q_etf(spark, sf):
    """ETF pages to typed records: six tabs, a page per fifty funds, the first
    funds of a page also at the end of the page before; the last tab lacks some
    funds, so names move up as the merge by place has it."""
    p = V.table(spark, sf, "part").select(F.col("p_brand").alias("feed"), F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("tab"))
    p = p.filter("NOT (tab = 5 AND k % 7 = 0)")
    pages = [F.struct(F.expr("k div 50").alias("page"), F.lit(0).alias("again"))]
    shown = F.when((F.col("k") % 50 < 3) & (F.col("k") >= 50), F.array(*pages, F.struct(F.expr("k div 50 - 1").alias("page"), F.lit(1).alias("again")))).otherwise(F.array(*pages))
    p = p.withColumn("at", F.explode(shown)).select("feed", "k", "tab", "at.*")
    kinds = {f.name: f.dataType.simpleString() for f in MODELS["etf"].fields}

    def tab_row(t):
        cells = []
        for _, j, f in [x for x in _ETF_PLACES if x[0] == t]:
            v = ((F.col("k") * (t + 1) + j) % 1000).cast("string")
            v = F.when(F.col("k") % 13 == 0, "&mdash;").otherwise(v) if (t, j) == (2, 1) else F.concat(F.lit("x"), v) if kinds[f] == "string" else v
            cells += [F.lit("<td>"), v, F.lit("</td>")]
        return F.concat(F.lit("<tr><td><b>E &amp; F "), F.col("k").cast("string"), F.lit("</b></td>"), *cells, F.lit("</tr>"))
    row = tab_row(0)
    for t in range(1, 6):
        row = F.when(F.col("tab") == t, tab_row(t)).otherwise(row)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("again", "k", row.alias("r")))), lambda x: x["r"]), "\n")   # a page's rows
    html = F.concat(F.lit("<table><tr><th>Name</th></tr>"), rows, F.lit("</table>"))
    return B.etf_records(p.groupBy("feed", "tab", "page").agg(html.alias("html")))


@register("b4_bad_rows", O.with_(O.V_MIXED_ROWS) + "SELECT page_id, row_pos FROM v_mixed WHERE len(cells) = 0")
def q_b4_bad(spark, sf):
    rows = B.extract_rows(V.pages(spark, sf), row_pattern=r"<(?:li|p)>(.*?)</(?:li|p)>", cell_pattern=B.LINK_CELL)
    return B.drop_bad_rows(rows)[1].select("page_id", "row_pos")


@register("b13_cache_misses", ORACLE["b13_cache"].replace("SELECT r.cache_key, c.url, c.url IS NOT NULL AS hit", "SELECT r.cache_key")
          + " WHERE c.url IS NULL")
def q_b13_misses(spark, sf):
    plan, _rej = _crawl(spark, sf)
    p = V.table(spark, sf, "part")
    cache = B.cache_upsert(p.select(
        F.concat(F.lit("nation_"), (F.col("p_partkey") % 23).cast("string"), F.lit("_"), F.lower("p_type")).alias("cache_key"),
        F.col("p_name").alias("url"), F.col("p_partkey").alias("written_at")))
    return B.cache_lookup(plan.select(B.cache_key("country", "sector").alias("cache_key")), cache)[1].select("cache_key")


def _model_cells(spark, sf, name):
    """Text cells of a typed model from the parts; every fifth row has a cell that doesn't parse."""
    fields = MODELS[name].fields
    numeric = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    bad = numeric[0] if numeric else fields[0].name

    def cell(f):
        good = (F.col("p_name") if isinstance(f.dataType, T.StringType) else
                F.col("p_size").cast("string") if isinstance(f.dataType, T.IntegerType) else F.col("p_retailprice").cast("string"))
        broken = F.lit("—") if numeric else F.lit(None).cast("string")
        return F.when(F.col("p_partkey") % 5 == 0, broken).otherwise(good) if f.name == bad else good
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", *[cell(f).alias(f.name) for f in fields]), bad


def _etf_cells(spark, sf):
    """The typed ETF record put together from its six screener tabs."""
    wide, bad = _model_cells(spark, sf, "etf")
    tabs = []
    for i, headers in enumerate(ETF_TABS):
        cells = F.array(*[F.col(ETF_FIELD_NAMES[h]) for h in headers])
        tabs.append(B.etf_tab(wide.select(F.lit("etf").alias("feed"), F.col("p_partkey").alias("pos"), cells.alias("cells")), i, typed=True))
    merged = B.add_constants(B.merge_tabs(tabs), {"management": "passive"})
    return merged.withColumnRenamed("pos", "p_partkey").drop("feed"), bad


def _models_sql():
    parts = []
    for name, model in MODELS.items():
        numeric = [f.name for f in model.fields if not isinstance(f.dataType, T.StringType)]
        bad = numeric[0] if numeric else model.fields[0].name
        parts.append(f"SELECT '{name}' AS model, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '{bad}' ELSE '' END AS failed_fields, "
                     "p_partkey % 5 <> 0 AS is_valid FROM part")
    return "\nUNION ALL\n".join(parts)


@register("c1_conform_models", _models_sql())
def q_c1_models(spark, sf):
    """C1 for the six record models, rows of both outcomes."""
    out = None
    for name in MODELS:
        cells, _bad = _etf_cells(spark, sf) if name == "etf" else _model_cells(spark, sf, name)
        got = C.conform(cells, name, keep=("p_partkey",)).select(F.lit(name).alias("model"), "p_partkey", "failed_fields", "is_valid")
        out = got if out is None else out.unionByName(got)
    return out


_LISTS = {"fund": FUND_TYPES, "commodity": COMMODITY_TYPES, "country": STOCK_COUNTRIES}
_MEMBER_SQL = """WITH v AS (
  SELECT p_partkey AS id, 'fund' AS list, CASE WHEN p_partkey % 9 = 8 THEN p_brand ELSE ({funds})[p_partkey % 7 + 1] END AS value FROM part
  UNION ALL SELECT p_partkey, 'commodity', CASE WHEN p_partkey % 9 = 8 THEN p_brand ELSE lower(({commodities})[p_partkey % 7 + 1]) END FROM part
  UNION ALL SELECT c_custkey, 'country', CASE WHEN c_custkey % 25 >= 20 THEN 'atlantis' ELSE upper(({countries})[c_custkey % 25 + 1]) END FROM customer)
SELECT id, list, value, coalesce(CASE list WHEN 'fund' THEN upper(value) IN (SELECT upper(unnest({funds})))
    WHEN 'commodity' THEN upper(value) IN (SELECT unnest({commodities})) ELSE upper(value) IN (SELECT upper(unnest({countries}))) END, false) AS accepted
FROM v""".format(funds=FUND_TYPES, commodities=COMMODITY_TYPES, countries=STOCK_COUNTRIES)


@register("c3_member_lists", _MEMBER_SQL)
def q_c3_lists(spark, sf):
    """C3 in its join form with the fund, commodity and country lists."""
    p, c = V.table(spark, sf, "part"), V.table(spark, sf, "customer")

    def pick(values, key, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % n + 1).cast("int"))
    odd = F.col("p_partkey") % 9 == 8
    views = {
        "fund": p.select(F.col("p_partkey").alias("id"), F.when(odd, F.col("p_brand")).otherwise(pick(FUND_TYPES, "p_partkey", 7)).alias("value")),
        "commodity": p.select(F.col("p_partkey").alias("id"), F.when(odd, F.col("p_brand")).otherwise(
            F.lower(pick(COMMODITY_TYPES, "p_partkey", 7))).alias("value")),
        "country": c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 25 >= 20, F.lit("atlantis")).otherwise(
            F.upper(pick(STOCK_COUNTRIES + ["-"] * 5, "c_custkey", 25))).alias("value"))}
    out = None
    for name, df in views.items():
        for accepted, part in zip((True, False), C.check_member(spark, df, "value", _LISTS[name], fold="upper")):
            part = part.select("id", F.lit(name).alias("list"), "value", F.lit(accepted).alias("accepted"))
            out = part if out is None else out.unionByName(part)
    return out


@register("d4_scale_units", """
SELECT p_partkey, CASE p_partkey % 5
         WHEN 0 THEN round(CAST(p_size AS DOUBLE) * 1000 * 1e9, 6) WHEN 1 THEN round((p_size + 0.5) * 1e6, 6)
         WHEN 2 THEN round(CAST(p_size AS DOUBLE) * 1e3, 6) WHEN 3 THEN CAST(p_size AS DOUBLE) END AS amount FROM part""")
def q_d4_units(spark, sf):
    """D4 with billions, thousands separators, decimals, other units, no unit and no number."""
    p = V.table(spark, sf, "part")
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = (F.when(k == 0, F.concat(size, F.lit(",000 Bil"))).when(k == 1, F.concat(size, F.lit(".5 mil")))
             .when(k == 2, F.concat(size, F.lit("K"))).when(k == 3, size).otherwise(F.lit("n/a")))
    return rounded(silver.amount_column(p.select("p_partkey", text.alias("amount")), "amount"))


_TF = "CASE WHEN {} THEN 'True' ELSE 'False' END"


@register("f7_goal_summary", _GOALS_SQL + f"""
SELECT goal_id, printf('goal: %s | initial_investment: %.2f | monthly_contribution: %.2f | annual_return: %.4f | target_value: %.2f | time_horizon: %d | is_specific: %s | is_measurable: %s | is_time: %s',
       goal, initial_investment, floor(monthly_contribution * 100) / 100, annual_return, target_value, time_horizon,
       {_TF.format('is_specific')}, {_TF.format('is_measurable')}, {_TF.format('is_time')}) AS summary FROM v_eval""")
def q_f7_summary(spark, sf):
    # whole cents, since engines print half a cent differently
    g = G.smt_flags(V.goals(spark, sf)).withColumn("monthly_contribution", F.floor(F.col("monthly_contribution") * 100) / 100)
    return g.select("goal_id", G.goal_summary().alias("summary"))


@register("e12_log_run", O.with_(O.V_PREDICTIONS) + """
SELECT model AS model_name, CAST(2 AS BIGINT) AS latest_version, 'runs/' || model || '/2' AS model_uri FROM v_pred GROUP BY model""")
def q_e12_log(spark, sf):
    """E10 -> E12: each model's error is logged twice; the registry's newest version is read back."""
    err = E.regression_error(V.predictions(spark, sf)).collect()        # one row per model
    path = scratch_path(spark, "registry")
    for version in (1, 2):
        for r in err:
            E.log_run(spark, path, r["model"], {"rule": r["model"]}, r["mse"], f"runs/{r['model']}/{version}")
    return E.latest_version(spark.read.parquet(path))


@register("d16_record_rejects", """
SELECT 'k' AS message_type, '{"k":"' || event_type || '"}' AS record, 'k' AS failed_fields FROM events WHERE event_id % 4 = 0""")
def q_d16_rejects(spark, sf):
    """Records with a field that doesn't parse are kept apart."""
    ev = V.table(spark, sf, "events")
    bad = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    data = F.concat(F.lit('[{"k":1},'), F.when(F.col("event_id") % 4 == 0, bad).otherwise(F.lit('{"k":2}')), F.lit("]"))
    bronze = ev.select(F.lit("k").alias("message_type"), data.alias("data"))
    return silver.record_rejects(bronze, "k", T.StructType([T.StructField("k", T.LongType())]))


_TEST_ROWS = (f"CAST('0x' || substr(md5('42:' || CAST(f.investor_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000")


@register("train_and_register", _FEATURES_SQL + f"""
SELECT m.model, CAST(m.ordinal AS INTEGER) AS ordinal, (SELECT count(*) FROM v_features f WHERE {_COMPLETE} AND {_TEST_ROWS}) AS n,
       true AS below_mean_predictor, CAST(1 AS BIGINT) AS n_best, CAST(4 AS BIGINT) AS n_registered
FROM (VALUES ('forest', 0), ('boosted_a', 1), ('boosted_b', 2)) m(model, ordinal)""")
def q_train_register(spark, sf):
    """E8 -> E10 -> E11 -> E12 as one job; the errors have no SQL counterpart,
    so each is held against the error of always predicting the mean label."""
    from marketflow.plans.jobs import train_and_register
    f = _features_labelled(spark, sf)
    tr, te = E.split(f, "investor_id")
    sc = E.fit_scaler(tr)
    path = scratch_path(spark, "runs")
    got = train_and_register(E.scale(tr, sc), E.scale(te, sc), path, scratch_path(spark, "best-model"),
                             params={"forest": _FOREST, "boosted_a": _BOOSTED, "boosted_b": _BOOSTED})
    mean = tr.dropna().agg(F.avg("label")).first()[0]
    base = te.dropna().agg(F.avg(F.pow(F.col("label") - mean, 2))).first()[0]
    best = got.filter("best").count()
    runs = spark.read.parquet(path).select("model_name").distinct().count()
    return got.select("model", "ordinal", "n", (F.col("mse") < base).alias("below_mean_predictor"),
                      F.lit(best).cast("long").alias("n_best"), F.lit(runs).cast("long").alias("n_registered"))


@register("b13_stored_cache", _CRAWL_SQL + """,
cache AS (SELECT 'nation_' || CAST(p_partkey % 23 AS VARCHAR) || '_' || lower(p_type) AS cache_key,
                 arg_max('https://screener.example/q/' || CAST(p_partkey AS VARCHAR) || '?offset={i}&count=250', p_partkey) AS url
          FROM part GROUP BY 1),
r AS (SELECT lower(country) || '_' || lower(sector) AS cache_key FROM plan)
SELECT r.cache_key, coalesce(c.url, 'https://screener.example/new/' || r.cache_key) AS url, c.url IS NOT NULL AS hit,
       true AS hit_next_time
FROM r LEFT JOIN cache c ON r.cache_key = c.cache_key""")
def q_b13_stored(spark, sf):
    """B13 stored: two rounds of writes, then requests that fill the cache, then the same requests again."""
    root = scratch_path(spark, "url-cache")
    writes = V.table(spark, sf, "part").select(
        F.concat(F.lit("nation_"), (F.col("p_partkey") % 23).cast("string"), F.lit("_"), F.lower("p_type")).alias("cache_key"),
        F.concat(F.lit("https://screener.example/q/"), F.col("p_partkey").cast("string"), F.lit("?offset={i}&count=250")).alias("url"),
        F.col("p_partkey").cast("long").alias("written_at"))
    first = F.col("written_at") % 2 == 0
    store_cache(writes.filter(~first), root)             # the later writes of some keys come first
    store_cache(writes.filter(first), root)
    requests = _crawl(spark, sf)[0].select(B.cache_key("country", "sector").alias("cache_key"))

    def generate(missing):
        return missing.select("cache_key", F.concat(F.lit("https://screener.example/new/"), F.col("cache_key")).alias("url"))

    filled = fill_cache(requests, root, generate)
    known = read_cache(spark, root).select("cache_key", F.lit(True).alias("_known"))
    return (filled.join(known, "cache_key", "left")
            .select("cache_key", "url", "hit", F.coalesce("_known", F.lit(False)).alias("hit_next_time")))


_C2_SPLIT = ORACLE["c2_check_keys"].replace("WITH p AS", "WITH q AS (WITH p AS", 1) + ")"


@register("c2_split", _C2_SPLIT + """
SELECT investor_id, missing, extra, CASE WHEN missing = '' AND extra = '' THEN 'accepted' ELSE 'rejected' END AS verdict FROM q""")
def q_c2_split(spark, sf):
    """Both sides written by one job and read back."""
    got = split_payload_keys(_investor_payloads(spark, sf), scratch_path(spark, "payload-keys"))
    return got.table.select("investor_id", "missing", "extra", "verdict")


@register("c2_split_counts", _C2_SPLIT + f"""
SELECT 'accepted' AS rule, count(*) FILTER (missing = '' AND extra = '') AS n FROM q
UNION ALL SELECT 'rejected', count(*) FILTER (missing <> '' OR extra <> '') FROM q
UNION ALL SELECT 'extra', count(*) FILTER (extra <> '') FROM q
UNION ALL SELECT 'missing ' || k, count(*) FILTER (list_contains(string_split(missing, ','), k))
FROM q, (SELECT unnest({E.FEATURE_COLUMNS!r}) AS k) GROUP BY k""")
def q_c2_counts(spark, sf):
    """Rows of each rule, observed while the split is written."""
    got = split_payload_keys(_investor_payloads(spark, sf), scratch_path(spark, "payload-keys"))
    return spark.createDataFrame(list(got.counts.items()), "rule string, n long")


def _mixed_bronze(spark, sf):
    """One message per event: two records, the second of another kind for
    every fourth event; error events arrive as text that is not JSON."""
    ev = V.table(spark, sf, "events")
    bad = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    data = F.concat(F.lit('[{"k":'), F.col("event_id").cast("string"), F.lit("},"),
                    F.when(F.col("event_id") % 4 == 0, bad).otherwise(F.lit('{"k":-1}')), F.lit("]"))
    text = F.concat(F.lit("not json "), F.col("event_id").cast("string"))
    return ev.select(F.col("event_type").alias("message_type"), F.when(F.col("event_type") == "error", text).otherwise(data).alias("data"))


_D16_SPLIT = """WITH q AS (
  SELECT event_type AS message_type, 'message' AS verdict, CAST(NULL AS BIGINT) AS k, 'not json ' || CAST(event_id AS VARCHAR) AS record,
         CAST(NULL AS VARCHAR) AS failed_fields FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_type, 'accepted', event_id, NULL, NULL FROM events WHERE event_type <> 'error'
  UNION ALL SELECT event_type, 'accepted', -1, NULL, NULL FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0
  UNION ALL SELECT event_type, 'record', NULL, '{"k":"' || event_type || '"}', 'k' FROM events WHERE event_type <> 'error' AND event_id % 4 = 0)
"""
_K_RECORD = T.StructType([T.StructField("k", T.LongType())])


@register("d16_split", _D16_SPLIT + "SELECT message_type, verdict, k, record, failed_fields FROM q")
def q_d16_split(spark, sf):
    """Records, refused records and refused messages written by one job."""
    got = split_bronze(_mixed_bronze(spark, sf), scratch_path(spark, "bronze-split"), None, _K_RECORD)
    return got.table.select("message_type", "verdict", "k", F.col("_record").alias("record"), F.col("_failed").alias("failed_fields"))


@register("d16_split_counts", _D16_SPLIT + """
SELECT v AS rule, count(*) FILTER (verdict = v) AS n FROM q, (SELECT unnest(['accepted', 'record', 'message']) AS v) GROUP BY v
UNION ALL SELECT 'failed k', count(*) FILTER (failed_fields = 'k') FROM q""")
def q_d16_counts(spark, sf):
    """Rows of each verdict and failing field, observed while the split is written."""
    got = split_bronze(_mixed_bronze(spark, sf), scratch_path(spark, "bronze-split"), None, _K_RECORD)
    return spark.createDataFrame(list(got.counts.items()), "rule string, n long")


@register("c3_asset_class", """
WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'bonds' WHEN s_suppkey % 5 = 1 THEN 'commodity' WHEN s_suppkey % 5 = 2 THEN 'Bond_Funds'
                             WHEN s_suppkey % 5 = 3 THEN 'unknown' ELSE 'usa' END AS message_type FROM supplier)
SELECT s_suppkey, message_type, CASE message_type WHEN 'bonds' THEN 'bond' WHEN 'commodity' THEN 'commodity' WHEN 'Bond_Funds' THEN 'fund'
                                                  WHEN 'usa' THEN 'stock' END AS asset_class FROM m""")
def q_asset_class(spark, sf):
    """Q16: message types with their asset class, the unknown ones kept."""
    key = F.col("s_suppkey") % 5
    kinds = (F.when(key == 0, "bonds").when(key == 1, "commodity").when(key == 2, "Bond_Funds").when(key == 3, "unknown").otherwise("usa"))
    return C.with_asset_class(V.table(spark, sf, "supplier").select("s_suppkey", kinds.alias("message_type")))
