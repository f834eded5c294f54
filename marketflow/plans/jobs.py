"""End-to-end compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from marketflow.operators import silver
from marketflow.session import materialize
from marketflow.sources.prices import trailing_prices


def process_funds(raw_funds: DataFrame, prices: DataFrame, tiebreak: Sequence[str] = (),
                  period: str | None = "1 year", as_of=None, compat: bool = False,
                  risk_free: float = 0.0, reference_names: bool = False) -> DataFrame:
    """Raw fund records -> cleaned funds enriched with price metrics.

    clean (D1-D5) -> symbols (D6) -> trailing prices of those symbols (A9) ->
    per-symbol metrics (D7-D13) -> left join (D14).  The symbol set restricts
    the prices by a semi join.  The cleaned funds are written once, when
    called, and read twice; the newest price time is a scalar subquery, for
    which only the time column is read.
    """
    funds = materialize(silver.clean_funds(raw_funds, compat=compat), "clean-funds", partitions=None)
    symbols = silver.distinct_symbols(funds)
    hist = trailing_prices(prices, symbols, period=period, as_of=as_of)
    metrics = silver.symbol_metrics(hist, tiebreak=tiebreak, risk_free=risk_free)
    return silver.enrich(funds, metrics, reference_names=reference_names)


def profile_investors(forms: DataFrame, goals: DataFrame, scaler: DataFrame, model,
                      investor_key: str = "investor_id", goal_rate: str | None = "goal_return"):
    """Investor form -> risk estimate -> bracket -> allocation, and goals ->
    SMART evaluation with the goal's own rate or else the investor's bracket

    ``forms`` are text form rows (``encode_form`` input) with ``investor_key``;
    ``goals`` carry ``investor_key`` and the goal fields of ``evaluate_goals``
    (``annual_return`` may be absent; ``goal_rate`` names an optional own-rate
    column).  Returns ``(investors, allocations, evaluated_goals, rejected)``;
    ``rejected`` holds the investors with a field that doesn't parse and its
    names.  Their goals are still evaluated when they bring an own rate, and
    have no rate, hence no outcome by value, when they don't.

    The goal -> investor join is an equi-join on the investor key; the scored
    investor side has one row per investor, so AQE broadcasts it when small
    and splits a hot investor's goals otherwise.
    """
    from pyspark.sql import functions as F

    from marketflow.constants import FEATURE_COLUMNS
    from marketflow.operators import features as E
    from marketflow.operators import goals as G
    from marketflow.operators import models as M

    feats = E.feature_order(E.encode_form(forms), target=None, keep=(investor_key,))
    failed = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in FEATURE_COLUMNS])
    checked = feats.withColumn("failed_fields", failed)
    rejected = checked.filter("failed_fields <> ''").select(investor_key, "failed_fields")
    scored = M.predict(model, E.scale(checked.filter("failed_fields = ''").drop("failed_fields"), scaler),
                       "risk_aversion_estimate")
    investors = G.with_risk_bracket(scored.select(investor_key, "risk_aversion_estimate"), "risk_aversion_estimate")
    allocations = G.allocation_long(investors, "risk_aversion_estimate", keep=(investor_key,))
    rates = investors.select(investor_key, F.col("annual_return").alias("_bracket_return"))
    g = goals.drop("annual_return").join(rates, investor_key, "left")
    own = F.col(goal_rate) if goal_rate and goal_rate in goals.columns else F.lit(None).cast("double")
    g = g.withColumn("annual_return", F.coalesce(own, F.col("_bracket_return"))).drop("_bracket_return")
    return investors, allocations, G.evaluate_goals(g), rejected


def train_and_register(train: DataFrame, test: DataFrame, registry_path: str, model_path: str, label: str = "label",
                       params: dict | None = None, model_name: str = "risk_aversion", tune_trials: int = 0, patience: int = 10) -> DataFrame:
    """E9 -> E8 -> E10 -> E11 -> E12: fit the three kinds, compare them on the
    test rows, store and register each under its own name and the best one also
    as ``<model_name>_best``, which ``score_stream`` scores with.

    ``params`` maps a kind to its parameters; with ``tune_trials`` those of
    successive halving over that many trials come on top.  The boosted kinds stop
    after ``patience`` rounds without a lower error on a fifth of the training
    rows (by content hash).  Models are stored below ``model_path``, one folder
    a registration.  Returns ``model, ordinal, mse, rmse, n, best, version``
    (of the model's own name).
    """
    import uuid

    from pyspark.sql import functions as F

    from marketflow.constants import FEATURE_COLUMNS
    from marketflow.operators import features as E
    from marketflow.operators import models as M

    spark = train.sparkSession
    fitted, errors = {}, None
    for i, kind in enumerate(M.MODEL_KINDS):
        p = dict((params or {}).get(kind, {}))
        if tune_trials:
            p |= M.halving(train, kind, label=label, n_trials=tune_trials)[-1]["params"]
        if kind == "forest":
            fitted[kind] = (M.train(train, kind, label=label, params=p), p)
        else:
            model, rounds, _errors = M.train_with_patience(train, kind, label=label, params=p, patience=patience)
            fitted[kind] = (model, {**p, "rounds_kept": rounds})
        pred = M.predict(fitted[kind][0], test.dropna(subset=[*FEATURE_COLUMNS, label]))
        e = E.regression_error(pred.withColumns({"model": F.lit(kind), "ordinal": F.lit(i)}), label=label,
                               group=("model", "ordinal"))
        errors = e if errors is None else errors.unionByName(e)
    errors = materialize(errors, "model-errors", partitions=None)
    best = E.pick_best(errors).first()["best_model"]
    versions = []
    for row in errors.orderBy("ordinal").collect():          # three rows
        kind, uri = row["model"], f"{model_path}/{row['model']}-{uuid.uuid4().hex[:12]}"
        fitted[kind][0].write().save(uri)
        logged = E.log_run(spark, registry_path, f"{model_name}_{kind}", fitted[kind][1], row["mse"], uri).first()
        versions.append((kind, logged["version"]))
        if kind == best:
            E.log_run(spark, registry_path, f"{model_name}_best", {**fitted[kind][1], "kind": kind}, row["mse"], uri, "Production")
    own = spark.createDataFrame(versions, "model string, version long")
    return errors.join(F.broadcast(own), "model").withColumn("best", F.col("model") == best)     # three rows


def write_bronze_batch(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Decoded envelopes (``message_type``, ``data``) as a bronze table
    partitioned by message type (the batch twin of the bronze stream).

    The rebalance hint clusters rows by message type before the write, so a
    task writes few types instead of every task writing a file per type; AQE
    splits a type that holds much of the data into advisory-size pieces."""
    (messages.select("message_type", "data").hint("rebalance", "message_type")
             .write.mode(mode).partitionBy("message_type").json(path))


def read_bronze(spark, path: str, message_types=None) -> DataFrame:
    """Bronze rows of the given message types; the filter on the partition
    column prunes whole directories at planning time."""
    from pyspark.sql import functions as F
    df = spark.read.schema("data string, message_type string").json(path)
    if message_types is not None:
        df = df.filter(F.col("message_type").isin(list(message_types)))
    return df


def silver_from_bronze(spark, bronze_path: str, prices: DataFrame, message_types=None,
                       tiebreak: Sequence[str] = (), **kwargs) -> DataFrame:
    """D16 -> D15: unnest the fund feeds of bronze into raw fund records and
    run the silver job on them (the link upstream left out)."""
    from marketflow.schemas import RAW_FUND
    bronze = read_bronze(spark, bronze_path, message_types)
    raw = silver.unnest_bronze(bronze, None, RAW_FUND).drop("message_type")
    return process_funds(raw, prices, tiebreak=tiebreak, **kwargs)
