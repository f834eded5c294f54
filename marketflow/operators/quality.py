"""Schema conformance and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.constants import FEATURE_COLUMNS, FEED_LAYOUTS, OTHER_MESSAGE_TYPES, STOCK_COUNTRIES
from marketflow.schemas import MODELS


def conform(df: DataFrame, model: str | T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Cast every field of a typed record model and report failures.

    Each model field is ``try_cast`` from the column of the same name (text
    cells); all fields are required, so a missing column, a NULL cell or a
    cell that does not parse is listed in ``failed_fields`` (comma
    separated, model order) and ``is_valid`` is false.
    """
    schema = MODELS[model] if isinstance(model, str) else model
    cols, fails = [], []
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            typed = src if isinstance(f.dataType, T.StringType) else src.cast("string").try_cast(f.dataType)
        else:
            typed = F.lit(None).cast(f.dataType)
        cols.append(typed.alias(f.name))
        fails.append(F.when(typed.isNull(), F.lit(f.name)))
    failed = F.concat_ws(",", *fails)
    return df.select(*keep, *cols, failed.alias("failed_fields"), (failed == F.lit("")).alias("is_valid"))


def check_keys(df: DataFrame, payload: str = "payload", expected: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """A JSON object's key set must equal ``expected``.

    Adds ``missing`` and ``extra`` (sorted, comma separated) and
    ``accepted``; malformed JSON has no keys, so everything is missing.
    """
    keys = F.coalesce(F.json_object_keys(F.col(payload)), F.array().cast("array<string>"))
    exp = F.array(*[F.lit(k) for k in expected])
    missing = F.array_join(F.array_sort(F.array_except(exp, keys)), ",")
    extra = F.array_join(F.array_sort(F.array_except(keys, exp)), ",")
    return (df.withColumn("missing", missing).withColumn("extra", extra)
              .withColumn("accepted", (F.col("missing") == "") & (F.col("extra") == "")))


def split_keys(df: DataFrame, payload: str = "payload",
               expected: Sequence[str] = FEATURE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows."""
    checked = check_keys(df, payload, expected)
    return checked.filter("accepted"), checked.filter("NOT accepted")


def _fold(c, fold: str | None):
    if fold == "upper":
        return F.upper(c)
    if fold == "lower":
        return F.lower(c)
    return c


def member_flag(df: DataFrame, column: str, allowed: Sequence[str], fold: str | None = None,
                out: str = "accepted") -> DataFrame:
    """C3 as one pass: a boolean column for membership in a literal list
    (an ``IN`` expression inside the scan stage, no join); NULL -> false."""
    values = sorted({(v.upper() if fold == "upper" else v.lower() if fold == "lower" else v) for v in allowed})
    return df.withColumn(out, F.coalesce(_fold(F.col(column), fold).isin(values), F.lit(False)))


def check_member(spark: SparkSession, df: DataFrame, column: str, allowed: Sequence[str] | DataFrame,
                 fold: str | None = None, allowed_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by membership in an allowed set.

    A literal list is a fixed-size table and is broadcast; for an allowed-set
    DataFrame AQE chooses by its measured size.  ``fold`` applies
    ``upper``/``lower`` to both sides first.
    """
    if isinstance(allowed, DataFrame):
        aset = allowed.select(_fold(F.col(allowed_col), fold).alias("_member")).distinct()
    else:
        values = sorted({(v.upper() if fold == "upper" else v.lower() if fold == "lower" else v) for v in allowed})
        aset = F.broadcast(spark.createDataFrame([(v,) for v in values], "_member string"))
    key = _fold(F.col(column), fold)
    cond = key == aset["_member"]
    return df.join(aset, cond, "left_semi"), df.join(aset, cond, "left_anti")


def message_classes(spark: SparkSession) -> DataFrame:
    """Dimension ``message_type, asset_class``: a message is named after its
    country (stocks) or its feed (funds), or by a constant.  Fixed size."""
    rows = [(c, "stock") for c in STOCK_COUNTRIES] + [(f, "fund") for f in FEED_LAYOUTS] + list(OTHER_MESSAGE_TYPES.items())
    return F.broadcast(spark.createDataFrame(rows, "message_type string, asset_class string"))


def with_asset_class(df: DataFrame, message_type: str = "message_type") -> DataFrame:
    """Adds ``asset_class`` of each row's message type; NULL for unknown and NULL types."""
    m = message_classes(df.sparkSession).withColumnRenamed("message_type", "_type")
    return df.join(m, F.col(message_type) == F.col("_type"), "left").drop("_type")


def keep_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str],
             content: Sequence[str] | None = None, dedupe_batch: bool = True,
             keep_hash: bool = False) -> DataFrame:
    """C4 (batch): records whose (key, content hash) is not stored yet.

    A re-sent snapshot passes only changed or unseen records.  The content
    hash is ``xxhash64`` of the content columns; the anti join is a shuffle
    join on (keys, hash), which AQE splits when a key is hot.
    """
    cols = (list(content) if content is not None
            else [c for c in incoming.columns if c not in keys and c != "_content_hash"])
    h = F.xxhash64(*[F.col(c) for c in cols])
    inc = incoming.withColumn("_content_hash", h)
    if dedupe_batch:
        inc = inc.dropDuplicates([*keys, "_content_hash"])
    # a stored table that keeps the hash (``keep_new_stream``'s sink) is read
    # as keys + hash only
    seen = (existing.select(*keys, "_content_hash") if "_content_hash" in existing.columns
            else existing.select(*keys, h.alias("_content_hash")))
    out = inc.join(seen, [*keys, "_content_hash"], "left_anti")
    return out if keep_hash else out.drop("_content_hash")


def gold(enriched: DataFrame, metrics: Sequence[str] = ("total_return_pct", "std_dev", "sharpe_ratio"),
         required: Sequence[str] = ("symbol", "name", "adjusted_expense_ratio", "asset_under_management")) -> DataFrame:
    """Validated, metric-bearing instruments of the silver table.

    Keeps rows whose required fields and metrics are all present and
    finite, and whose amounts are not negative.
    """
    cond = F.lit(True)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    for c in metrics:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    cond = cond & (F.col("adjusted_expense_ratio") >= 0) & (F.col("asset_under_management") >= 0)
    return enriched.filter(cond)
