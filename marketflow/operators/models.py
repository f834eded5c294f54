"""Risk-aversion models with MLlib.

Forest -> ``RandomForestRegressor``; the two boosted models ->
``GBTRegressor``.  They are MLlib's distributed trainers, not the original
libraries, so scores are comparable in kind, not equal in value.  The boosted
models differ in their defaults: ``boosted_a`` takes large steps on all rows,
``boosted_b`` small steps on row samples, and stops early when given a
validation column.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketflow.constants import FEATURE_COLUMNS, N_TRIALS, SEARCH_RANGES, SPLIT_SEED
from marketflow.operators import features as E
from marketflow.operators import quality as C

MODEL_KINDS = ("forest", "boosted_a", "boosted_b")


# Defaults of each kind where a trial names no value.
_DEFAULTS = {
    "forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "boosted_a": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0},
    "boosted_b": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.03, "subsample": 0.8},
}
MAX_DEPTH = 30                 # MLlib's own limit


def _estimator(kind: str, label: str, seed: int, params: Mapping | None = None):
    """MLlib estimator of a model kind.

    ``max_depth`` None means as deep as MLlib goes (30); more than that is an
    error.  MLlib has no minimum for splitting a node, only for its children:
    a node of fewer than ``min_samples_split`` rows is kept whole by asking
    for at least half as many rows in each child.
    """
    p = {**_DEFAULTS[kind], **(params or {})}
    depth = MAX_DEPTH if p["max_depth"] is None else int(p["max_depth"])
    if depth > MAX_DEPTH:
        raise ValueError(f"max_depth {depth} is above MLlib's limit of {MAX_DEPTH}")
    if kind == "forest":
        leaf = max(int(p["min_samples_leaf"]), -(-int(p["min_samples_split"]) // 2))
        return RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, numTrees=int(p["n_estimators"]),
                                     maxDepth=depth, minInstancesPerNode=leaf)
    est = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=int(p["n_estimators"]), maxDepth=depth,
                       stepSize=float(p["learning_rate"]), subsamplingRate=float(p["subsample"]))
    if p.get("validation_col"):
        est = est.setValidationIndicatorCol(p["validation_col"])
        est.set(est.validationTol, float(p.get("validation_tol", 0.01)))
    return est


def train(df: DataFrame, kind: str = "forest", label: str = "label", features: Sequence[str] = FEATURE_COLUMNS,
          params: Mapping | None = None, seed: int = SPLIT_SEED) -> PipelineModel:
    """Fit assembler + regressor.  Rows with a NULL feature or label are
    left out; the input is persisted for the many passes tree training makes."""
    data = df.dropna(subset=[*features, label]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
        return Pipeline(stages=[asm, _estimator(kind, label, seed, params)]).fit(data)
    finally:
        data.unpersist()


def random_trials(kind: str, n: int = N_TRIALS, seed: int = SPLIT_SEED) -> list[dict]:
    """``n`` parameter draws from the search ranges of the model kind."""
    rng = random.Random(seed)
    r = SEARCH_RANGES["forest" if kind == "forest" else "boosted"]
    out = []
    for _ in range(n):
        if kind == "forest":
            out.append({"n_estimators": rng.randint(*r["n_estimators"]), "max_depth": rng.choice(r["max_depth"]),
                        "min_samples_split": rng.randint(*r["min_samples_split"]),
                        "min_samples_leaf": rng.randint(*r["min_samples_leaf"])})
        else:
            out.append({"n_estimators": rng.randint(*r["n_estimators"]), "max_depth": rng.randint(*r["max_depth"]),
                        "learning_rate": rng.uniform(*r["learning_rate"])})
    return out


def tune(df: DataFrame, kind: str = "forest", label: str = "label", features: Sequence[str] = FEATURE_COLUMNS,
         trials: Sequence[Mapping] | None = None, folds: int = 3, parallelism: int = 4,
         seed: int = SPLIT_SEED) -> tuple[PipelineModel, dict, float]:
    """K-fold cross-validated search minimising MSE on training folds only.

    Returns (best model refit on all of ``df``, its parameters, its mean CV MSE).
    """
    trials = list(trials) if trials is not None else random_trials(kind, seed=seed)
    data = df.dropna(subset=[*features, label]).persist(StorageLevel.MEMORY_AND_DISK)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    base = _estimator(kind, label, seed)
    maps = []
    for t in trials:
        e = _estimator(kind, label, seed, t)
        maps.append({base.getParam(p.name): e.getOrDefault(p) for p in e.params
                     if e.isDefined(p) and p.name in ("numTrees", "maxDepth", "minInstancesPerNode", "maxIter",
                                                       "stepSize", "subsamplingRate", "validationIndicatorCol",
                                                       "validationTol")})
    cv = CrossValidator(estimator=Pipeline(stages=[asm, base]), estimatorParamMaps=maps,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="mse"),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    try:
        m = cv.fit(data)
    finally:
        data.unpersist()
    best = min(range(len(trials)), key=lambda i: (m.avgMetrics[i], i))
    return m.bestModel, dict(trials[best]), float(m.avgMetrics[best])


def _guided(kind: str, finished: Sequence[tuple[float, Mapping]], rng: random.Random) -> dict:
    """A draw near one of the better half of the finished trials: numbers move
    by up to a quarter of their range, choices change one time in three."""
    better = sorted(finished, key=lambda t: t[0])[:max(1, len(finished) // 2)]
    near = dict(rng.choice(better)[1])
    for name, span in SEARCH_RANGES["forest" if kind == "forest" else "boosted"].items():
        if isinstance(span, list):
            near[name] = rng.choice(span) if rng.random() < 1 / 3 else near[name]
        else:
            moved = near[name] + rng.uniform(-0.25, 0.25) * (span[1] - span[0])
            moved = min(max(moved, span[0]), span[1])
            near[name] = round(moved) if isinstance(span[0], int) else moved
    return near


def halving(df: DataFrame, kind: str = "forest", label: str = "label", features: Sequence[str] = FEATURE_COLUMNS, n_trials: int = N_TRIALS,
            folds: int = 3, first_trees: int = 2, eta: int = 4, parallelism: int = 4, seed: int = SPLIT_SEED) -> list[dict]:
    """E9 by successive halving: the whole number of trials, few of them at full size.

    Every trial is fitted with ``first_trees`` trees and measured by k-fold MSE
    over all rows; the best ``1 / eta`` go on with ``eta`` times the trees, and so
    on until one is left or its own number of trees is reached.  The second
    half of the trials is drawn near the better ones of the first.  The rows
    are cached once, features assembled, with their fold (a hash of the row, so a
    re-run measures the same).  Returns one dict per trial and rung: ``rung``,
    ``trees``, ``params``, ``mse``, ``n`` (rows); the last one is the best.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    rng = random.Random(seed)
    rows = df.dropna(subset=[*features, label])
    fold = F.pmod(F.xxhash64(F.lit(seed), *features, label), F.lit(folds)).cast("int")
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.withColumn("_fold", fold)).select("features", label, "_fold")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    out: list[dict] = []
    try:
        sizes = {r["_fold"]: r["count"] for r in data.groupBy("_fold").count().collect()}         # `folds` rows
        total = sum(sizes.values())

        def squares(job):
            params, trees, k = job
            model = _estimator(kind, label, seed, {**params, "n_estimators": trees}).fit(data.filter(F.col("_fold") != k))
            return model.transform(data.filter(F.col("_fold") == k)).agg(F.sum(F.pow(F.col("prediction") - F.col(label), 2))).first()[0] or 0.0

        def measure(rung: int, trees: int, trials: list[dict]) -> None:
            trees_of = [min(trees, int(t["n_estimators"])) for t in trials]
            jobs = [(t, n, k) for t, n in zip(trials, trees_of) for k in sorted(sizes)]
            with ThreadPool(parallelism) as pool:
                got = pool.map(inheritable_thread_target(data.sparkSession)(squares), jobs, chunksize=1)
            for i, t in enumerate(trials):
                mse = sum(got[i * len(sizes):(i + 1) * len(sizes)]) / total
                out.append({"rung": rung, "trees": trees_of[i], "params": t, "mse": float(mse), "n": total})

        if total and len(sizes) > 1:
            free = random_trials(kind, -(-n_trials // 2), seed)
            measure(0, first_trees, free)
            measure(0, first_trees, [_guided(kind, [(o["mse"], o["params"]) for o in out], rng) for _ in range(n_trials - len(free))])
            rung, trees, held = 0, first_trees, list(out)
            while len(held) > 1:
                held = sorted(held, key=lambda o: o["mse"])[:max(1, len(held) // eta)]
                rung, trees, done = rung + 1, trees * eta, len(out)
                if len(held) > 1 or trees <= max(int(o["params"]["n_estimators"]) for o in held):
                    measure(rung, trees, [o["params"] for o in held])
                    held = out[done:]
            out.append(out.pop(out.index(min(held, key=lambda o: o["mse"]))))
    finally:
        data.unpersist()
    return out


def cut_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The first ``rounds`` trees of a boosted model as a model."""
    sc = SparkContext._active_spark_context
    trees, weights = model._call_java("trees"), model.treeWeights
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    scale = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept[i], scale[i] = trees[i], float(weights[i])
    java = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, kept, scale, int(model.numFeatures))
    cut = GBTRegressionModel(model._java_obj.copyValues(java, java.extractParamMap()))
    return cut.setPredictionCol(model.getPredictionCol()).setFeaturesCol(model.getFeaturesCol())


def best_round(errors: Sequence[float], patience: int) -> int:
    """How many rounds to keep: those up to the least error seen before
    ``patience`` rounds in a row brought nothing better."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_with_patience(df: DataFrame, kind: str = "boosted_a", label: str = "label", features: Sequence[str] = FEATURE_COLUMNS,
                        params: Mapping | None = None, patience: int = 10, validation: str | None = None,
                        seed: int = SPLIT_SEED) -> tuple[PipelineModel, int, list[float]]:
    """E8 for a boosted model that stops when ``patience`` rounds brought no
    lower error on the validation rows (boolean column ``validation``; by
    default a fifth of the rows by hash), and keeps the trees up to the best.

    Returns (model, rounds kept, validation error after each round)."""
    if kind == "forest":
        raise ValueError("a forest has no rounds")
    held = F.col(validation) if validation else F.pmod(F.xxhash64(*features, label), F.lit(5)) == 0
    data = df.dropna(subset=[*features, label]).withColumn("_held", F.coalesce(held, F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
        ready = asm.transform(data)
        model = _estimator(kind, label, seed, params).fit(ready.filter("NOT _held"))
        test = ready.filter("_held")
        errors = [float(x) for x in model.evaluateEachIteration(test, "squared")] if not test.isEmpty() else []
        rounds = best_round(errors, patience) if errors else model.getNumTrees
        return PipelineModel([asm, cut_rounds(model, rounds)]), rounds, errors
    finally:
        data.unpersist()


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    pred = model.transform(df)
    drop = [c for c in ("features",) if c in pred.columns]
    return pred.drop(*drop).withColumnRenamed("prediction", out) if out != "prediction" else pred.drop(*drop)


def score_payloads(payloads: DataFrame, scaler: DataFrame, model: PipelineModel, payload: str = "payload",
                   keep: Sequence[str] = (), features: Sequence[str] = FEATURE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """JSON feature payloads -> (scored rows, rejected rows).

    Key check (C2) -> feature order (E4) -> scale with the stored statistics
    (E6) -> model; the estimate is ``risk_aversion_estimate``.  Works on a
    batch table or on a streaming DataFrame.
    """
    ok, bad = C.split_keys(payloads, payload, features)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in features])
    parsed = ok.select(*keep, F.from_json(F.col(payload), schema).alias("_f")).select(*keep, "_f.*")
    ordered = E.feature_order(parsed, target=None, keep=keep, features=features)
    if payloads.isStreaming:
        # one-row fitted scaler (2 numbers per feature) applied as literals
        scaled = E.scale_with_values(ordered, scaler.first().asDict(), features)
    else:
        scaled = E.scale(ordered, scaler, features)
    return predict(model, scaled, "risk_aversion_estimate"), bad


def load_registered(spark: SparkSession, registry_path: str, model_name: str, stages: Sequence[str] | None = None) -> tuple[PipelineModel, int]:
    """The newest registered version of a model (among ``stages``) and its number."""
    newest = E.latest_version(E.read_registry(spark, registry_path).filter(F.col("model_name") == model_name), stages).first()
    if newest is None:
        raise LookupError(f"no model {model_name} in {registry_path}")
    return PipelineModel.load(newest["model_uri"]), int(newest["latest_version"])


def score_stream(payloads: DataFrame, registry_path: str, model_name: str, scaler: DataFrame, sink_path: str, checkpoint: str,
                 payload: str = "payload", keep: Sequence[str] = (), stages: Sequence[str] | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """E13 on a stream with the registry's newest model.

    Before each micro-batch the registry is asked for the newest version; a new
    one is loaded and takes over with that batch.  Scored rows go to
    ``sink_path`` with ``model_version``, rejected ones to ``sink_path`` +
    "-rejected", both per batch id, so a batch run again replaces itself."""
    held: dict[str, object] = {"version": None}

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = E.latest_version(E.read_registry(spark, registry_path).filter(F.col("model_name") == model_name), stages).first()
        if newest is None:
            raise LookupError(f"no model {model_name} in {registry_path}")
        if held["version"] != newest["latest_version"]:
            held.update(model=PipelineModel.load(newest["model_uri"]), version=newest["latest_version"])
        batch = batch.persist()
        try:
            scored, bad = score_payloads(batch, scaler, held["model"], payload, keep)
            scored.withColumn("model_version", F.lit(held["version"]).cast("long")).write.mode("overwrite").parquet(f"{sink_path}/_batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{sink_path}-rejected/_batch_id={batch_id}")
        finally:
            batch.unpersist()
    w = payloads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
