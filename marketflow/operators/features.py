"""Investor features, scaler, split and model-selection aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.constants import (EDUCATION_CODES, FEATURE_COLUMNS, FORM_FIELDS, OCCUPATION_CODES,
                                  SPLIT_SEED, SURVEY_DROP_COLUMNS, SURVEY_RENAMES, SURVEY_TARGET,
                                  TEST_FRACTION)
from marketflow.functions.util import as_col
from marketflow.session import create_exclusive, path_exists


def encode_label(c, mapping: Mapping[str, int], default: int = 0) -> Column:
    """Label -> code via a literal map; unknown (or NULL) -> ``default``."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(int(v))]
    return F.coalesce(F.create_map(*kv)[as_col(c)], F.lit(int(default)))


def encode_form(df: DataFrame, education: str = "education", occupation: str = "occupation",
                education_codes: Mapping[str, int] = EDUCATION_CODES,
                occupation_codes: Mapping[str, int] = OCCUPATION_CODES) -> DataFrame:
    """E1 + E2: the web form's text fields -> the typed feature row.

    Labels are encoded (unknown -> 0); numeric text is parsed with
    ``try_cast`` (malformed -> NULL instead of an error).
    """
    cols = {
        "education": encode_label(education, education_codes),
        "occupation": encode_label(occupation, occupation_codes),
    }
    for src, name, typ in FORM_FIELDS:
        cols[name] = F.col(src).try_cast(typ)
    return df.withColumns(cols)


def rename_survey(df: DataFrame, drop: Sequence[str] = SURVEY_DROP_COLUMNS,
                  renames: Mapping[str, str] = SURVEY_RENAMES) -> DataFrame:
    """Drop the unused survey columns and rename the eight features."""
    present = [c for c in drop if c in df.columns]
    return df.drop(*present).withColumnsRenamed(dict(renames))


def feature_order(df: DataFrame, target: str | None = SURVEY_TARGET, keep: Sequence[str] = (),
                  features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Fixed feature order, target last (when present)."""
    cols = [*keep, *features] + ([target] if target and target in df.columns else [])
    return df.select(*cols)


def split(df: DataFrame, id_col: str, test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
          buckets: int = 10000) -> tuple[DataFrame, DataFrame]:
    """E5: deterministic train/test split by a hash bucket of the row id (the
    first 32 bits of the MD5 of ``seed:id``, so any engine can repeat it).

    Stable under repartitioning and re-execution (unlike ``randomSplit``),
    which matters when an executor is lost and a stage is recomputed.
    """
    text = F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    b = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(buckets)
    is_test = b < F.lit(int(round(test_fraction * buckets)))
    return df.filter(~is_test), df.filter(is_test)


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """One-row table of mean and population deviation of each feature.

    A global aggregate: partial per task, one tiny final merge.
    """
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd")]
    return df.agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """``(x - mean) / sd`` with sd 0 (or undefined) treated as 1.

    The fitted row enters as a single scalar subquery (a one-row struct), so
    no join or cross product is planned.
    """
    stats = scaler.select(F.struct(*scaler.columns).alias("s")).scalar()
    # projected once as a column: the subquery is planned and run once,
    # every feature reads its fields
    cols = {}
    for c in features:
        m = F.col("_scaler").getField(f"{c}__mean")
        sd = F.col("_scaler").getField(f"{c}__sd")
        sd1 = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        cols[c] = (F.col(c).cast("double") - m) / sd1
    return df.withColumn("_scaler", stats).withColumns(cols).drop("_scaler")


def scale_with_values(df: DataFrame, stats: Mapping[str, float | None],
                      features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """E6 with the fitted statistics as literals (``{f"{c}__mean": .., f"{c}__sd": ..}``).

    For streaming plans, which cannot hold a batch scalar subquery: the
    fitted scaler is two numbers per feature, a fixed-size model parameter.
    """
    cols = {}
    for c in features:
        m = stats.get(f"{c}__mean")
        sd = stats.get(f"{c}__sd")
        sd1 = 1.0 if sd is None or sd == 0 else float(sd)
        cols[c] = (F.col(c).cast("double") - F.lit(m).cast("double")) / F.lit(sd1)
    return df.withColumns(cols)


def scaler_long(scaler: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Fitted scaler as ``(feature, mean, sd)`` rows for storage."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__sd").alias("sd")) for c in features])
    return scaler.select(F.inline(rows))


def scaler_wide(long: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """The stored long form back to the one-row wide form."""
    aggs = []
    for c in features:
        aggs += [F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"{c}__mean"),
                 F.max(F.when(F.col("feature") == c, F.col("sd"))).alias(f"{c}__sd")]
    return long.agg(*aggs)


def save_scaler(scaler: DataFrame, path: str, features: Sequence[str] = FEATURE_COLUMNS) -> None:
    """Write the fitted statistics as a parquet table."""
    scaler_long(scaler, features).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Read the statistics written by ``save_scaler``."""
    return scaler_wide(spark.read.parquet(path), features)


def regression_error(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     group: Sequence[str] = ("model",)) -> DataFrame:
    """MSE and RMSE per model."""
    err = F.pow(F.col(label) - F.col(prediction), 2)
    return (pred.groupBy(*group).agg(F.avg(err).alias("mse"), F.count(F.lit(1)).alias("n"))
                .withColumn("rmse", F.sqrt("mse")))


def pick_best(errors: DataFrame, model: str = "model", mse: str = "mse", ordinal: str = "ordinal") -> DataFrame:
    """The lowest-MSE model; the earlier model wins a tie."""
    return errors.agg(F.min_by(F.col(model), F.struct(F.col(mse), F.col(ordinal))).alias("best_model"),
                      F.min(F.col(mse)).alias("best_mse"))


def latest_version(registry: DataFrame, stages: Sequence[str] | None = None, name: str = "model_name",
                   version: str = "version", stage: str = "stage", uri: str = "model_uri") -> DataFrame:
    """Newest registered version of each model among the given stages."""
    df = registry if stages is None else registry.filter(F.col(stage).isin(list(stages)))
    return df.groupBy(name).agg(F.max(version).alias("latest_version"),
                                F.max_by(F.col(uri), F.col(version)).alias("model_uri"))


RUN_SCHEMA = ("run_id string, model_name string, version long, stage string, params string, mse double, "
              "rmse double, model_uri string")


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry's rows; none where only claims have been made so far."""
    return spark.read.schema(RUN_SCHEMA).parquet(registry_path)


def _newest_version(spark: SparkSession, registry_path: str, model_name: str) -> int:
    runs = read_registry(spark, registry_path).filter(F.col("model_name") == model_name)
    return int(runs.agg(F.max("version")).first()[0] or 0)


def log_run(spark: SparkSession, registry_path: str, model_name: str, params: Mapping, mse: float,
            model_uri: str, stage: str = "None", run_id: str | None = None) -> DataFrame:
    """Append one run to a registry table (parquet) with the next version
    number of the model; returns the appended row.

    The registry is an append-only table in shared storage; ``latest_version``
    reads it back.  A version is claimed by creating its file below
    ``_versions`` exclusively, the next one if another writer was faster, so
    two writers never register the same version of a model.  A claim whose
    writer ended before the row was written leaves a gap.  Only a missing table
    starts at version 1; a table that can't be read is an error.
    """
    import json
    import math
    import uuid
    version = 1
    if path_exists(spark, registry_path):
        version = _newest_version(spark, registry_path, model_name) + 1
    while not create_exclusive(spark, f"{registry_path}/_versions/{model_name.encode().hex()}/{version}"):
        version += 1
    rec = [(run_id or uuid.uuid4().hex, model_name, int(version), stage, json.dumps(dict(params), sort_keys=True),
            float(mse), math.sqrt(float(mse)), model_uri)]
    df = spark.createDataFrame(rec, RUN_SCHEMA)
    df.write.mode("append").parquet(registry_path)
    return df
