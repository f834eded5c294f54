"""Domain views over the driver's testdata tables.

Each view is derived from the given tables by Spark, so its size grows with
them.  The same mappings are written as SQL in ``marketflow.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def funds_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_FUNDS: one fund per part, all cells as scraped text.

    The feed is re-sent every few minutes, so bronze holds the same snapshot
    twice; the silver de-duplication removes the copy.
    """
    p = table(spark, sf_dir, "part")
    snap = p.select(
        F.col("p_partkey").cast("string").alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("fund_type"),
        F.when(F.col("p_size") % 10 == 0, F.lit("—"))
         .otherwise(F.format_string("%.2f%%", F.col("p_size") / F.lit(100.0))).alias("adjusted_expense_ratio"),
        F.concat(F.floor("p_retailprice").cast("string"), F.lit(" Mil")).alias("asset_under_management"),
    )
    return snap.unionByName(snap)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_PRICES: symbol = part key, ts = ship date, adj_close = extended price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("adj_close"),
        F.col("l_orderkey").alias("l_orderkey"),
        F.col("l_linenumber").alias("l_linenumber"),
    )


PRICE_TIEBREAK = ("l_orderkey", "l_linenumber")


def prices_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_PRICES_EV: symbol = user, ts, adj_close = value ((user, ts) unique)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("symbol"), "ts", F.col("value").alias("adj_close"))


def investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_INVESTORS: risk aversion = account balance / 100 (all eight brackets occur)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("investor_id"),
                    (F.col("c_acctbal") / F.lit(100.0)).alias("risk_aversion"),
                    F.col("c_mktsegment").alias("segment"))


# Segment -> education label; HOUSEHOLD stays unmapped (encodes to 0).
_EDU_BY_SEGMENT = {"AUTOMOBILE": "No high school degree", "BUILDING": "Bachelor degree",
                   "FURNITURE": "Master degree", "MACHINERY": "PhD"}
_OCC_BY_NATION_MOD = ["Entrepreneur", "Managerial", "Salarial", "Unemployed", "Retired"]


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_FORMS: the web form of each customer, every field as text.

    Negative balances give a malformed income (``"—"``) so the parser's NULL
    path is exercised.
    """
    c = table(spark, sf_dir, "customer")
    edu = F.coalesce(F.create_map(*[x for k, v in _EDU_BY_SEGMENT.items() for x in (F.lit(k), F.lit(v))])
                     [F.col("c_mktsegment")], F.lower("c_mktsegment"))
    occ = F.element_at(F.array(*[F.lit(x) for x in _OCC_BY_NATION_MOD]),
                       (F.col("c_nationkey") % 5 + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("investor_id"),
        (F.lit(20) + F.col("c_nationkey") * 2).cast("string").alias("age"),
        edu.alias("education"),
        occ.alias("occupation"),
        (F.col("c_nationkey") % 4).cast("string").alias("kids"),
        F.when(F.col("c_acctbal") < 0, F.lit("—")).otherwise(F.col("c_acctbal").cast("string")).alias("income"),
        (F.col("c_acctbal") * 3).cast("string").alias("net_worth_income"),
        (F.col("c_custkey") % 4 + 1).cast("string").alias("risk"),
        (F.col("c_custkey") % 2).cast("string").alias("married"),
        (F.col("c_acctbal") / F.lit(100.0)).alias("TrueRiskTol"),
    )


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_GOALS: one goal per order of a customer.

    goal text from the order priority ('' for NOT SPECIFIED), initial =
    max(balance, 0), contribution = total / 1000 (annual for status F),
    target = total, horizon = order key mod 6 years (0 occurs), rate from
    the customer's risk bracket.
    """
    from marketflow.functions.finance import bracket_return
    from marketflow.operators.goals import to_monthly
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    g = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    period = F.when(F.col("o_orderstatus") == "F", F.lit("annual")).otherwise(F.lit("monthly"))
    contribution = F.col("o_totalprice") / F.lit(1000.0)
    return g.select(
        F.col("o_orderkey").alias("goal_id"),
        F.col("o_custkey").alias("investor_id"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
         .otherwise(F.lower(F.regexp_replace("o_orderpriority", r"^[0-9]+-", ""))).alias("goal"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("initial_investment"),
        contribution.alias("contribution"),
        period.alias("contribution_period"),
        to_monthly(contribution, period).alias("monthly_contribution"),
        bracket_return(F.col("c_acctbal") / F.lit(100.0)).alias("annual_return"),
        F.col("o_totalprice").alias("target_value"),
        (F.col("o_orderkey") % 6).cast("int").alias("time_horizon"),
    )


_INTENT_BY_EVENT = {"signup": "initialize", "purchase": "goal_achievable", "view": "goal_text",
                    "click": "preferences_confirmed", "error": "reset"}


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_SESSION: events of each user as chat intents; every third view asks
    something else."""
    ev = table(spark, sf_dir, "events")
    intent = F.create_map(*[x for k, v in _INTENT_BY_EVENT.items() for x in (F.lit(k), F.lit(v))])
    other = (F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)
    return ev.select(F.col("user_id").alias("conv_id"), "ts", "event_id", "event_type",
                     F.when(other, F.lit("smalltalk")).otherwise(intent[F.col("event_type")]).alias("intent"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_PREDICTIONS: three fixed scoring rules per customer against the
    risk tolerance label (label = balance / 100)."""
    c = table(spark, sf_dir, "customer")
    y = F.col("c_acctbal") / F.lit(100.0)
    models = F.array(
        F.struct(F.lit("scaled_balance").alias("model"), F.lit(0).alias("ordinal"),
                 (F.col("c_acctbal") * F.lit(0.009)).alias("prediction")),
        F.struct(F.lit("nation_level").alias("model"), F.lit(1).alias("ordinal"),
                 (F.col("c_nationkey") * F.lit(2.0)).alias("prediction")),
        F.struct(F.lit("constant").alias("model"), F.lit(2).alias("ordinal"),
                 F.lit(45.0).alias("prediction")),
    )
    return c.select(F.col("c_custkey").alias("investor_id"), y.alias("label"), F.inline(models))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_REGISTRY: model versions; name by priority class, stage by status."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("model_"), F.regexp_extract("o_orderpriority", r"^([0-9]+)", 1))
    return o.select(
        name.alias("model_name"),
        F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Production"))
         .when(F.col("o_orderstatus") == "O", F.lit("Staging")).otherwise(F.lit("Archived")).alias("stage"),
        F.concat(F.lit("models:/"), name, F.lit("/"), F.col("o_orderkey").cast("string")).alias("model_uri"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_MESSAGES: one envelope per event, ``data`` = JSON array text of its
    props; error events arrive as text that is not JSON."""
    ev = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_type").alias("type"),
                              F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("data")))
    value = F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), F.col("event_id").cast("string")))
    return ev.select("event_id", "ts", value.otherwise(good).alias("value"))


# Sector list used by the stock views: heavy then light (FIXED VALUES in constants).
def _sector_of(idx: "F.Column") -> "F.Column":
    from marketflow.constants import HEAVY_SECTORS, LIGHT_SECTORS
    return F.element_at(F.array(*[F.lit(s) for s in HEAVY_SECTORS + LIGHT_SECTORS]), (idx % 11 + 1).cast("int"))


def stock_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_STOCK_CELLS: a scraped stock screener row per supplier, cells as
    text in the screener's column order; the feed is the country."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "inner")
    cells = F.array(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")),
        F.col("s_name"),
        F.col("s_acctbal").cast("string"),
        (F.col("s_nationkey") - 12).cast("string"),
        F.concat((F.col("s_nationkey") - 12).cast("string"), F.lit("%")),
        (F.col("s_suppkey") * 1000).cast("string"),
        (F.col("s_suppkey") * 900).cast("string"),
        ((F.col("s_suppkey") + 1) * 1000003).cast("string"),
        F.when(F.col("s_acctbal") < 0, F.lit("—")).otherwise(F.col("s_nationkey").cast("string")),
        F.lit(""),
        _sector_of(F.col("s_suppkey")),
    )
    return j.select(F.col("s_suppkey").alias("row_id"), F.lower("n_name").alias("feed"), cells.alias("cells"))


def fund_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_FUND_CELLS: a scraped fund row per part in the column layout of its
    feed (one of the seven, by part key); other cells carry their column name."""
    from marketflow.constants import FEED_LAYOUTS, FUND_TYPES
    f = funds_raw(spark, sf_dir).distinct()
    feed = F.element_at(F.array(*[F.lit(t) for t in FUND_TYPES]), (F.col("symbol").cast("long") % 7 + 1).cast("int"))
    f = f.withColumn("fund_type", feed)

    def cell(name):
        return {"adjusted_expense_ratio": F.col("adjusted_expense_ratio"), "asset_under_management": F.col("asset_under_management"),
                "fund_size": F.col("asset_under_management")}.get(name, F.lit(name))
    cells = None
    for t, names in FEED_LAYOUTS.items():
        row = F.array(*[cell(n) for n in names])
        cells = F.when(F.col("fund_type") == t, row) if cells is None else cells.when(F.col("fund_type") == t, row)
    return f.select("name", "symbol", "category", "fund_type", cells.alias("cells"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")
