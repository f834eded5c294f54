"""Silver layer: fund cleaning, per-symbol price metrics, enrichment.

All operators are DataFrame -> DataFrame functions built from Spark SQL
expressions; none collects to the driver.  All are lazy but ``daily_returns``,
which counts the rows of each symbol when called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.text import percent_to_number, scale_amount
from marketflow.operators.series import DEFAULT_HOT_ROWS, DEFAULT_ROWS_PER_BUCKET, NULL_BUCKET, join_carry, plan_buckets, seconds

FUND_COLUMNS = ["adjusted_expense_ratio", "asset_under_management", "category", "fund_type", "name", "symbol"]
METRIC_COLUMNS = ["total_return_pct", "std_dev", "sharpe_ratio"]
# Column names the original pipeline published.
REFERENCE_METRIC_NAMES = {
    "total_return_pct": "Total Return (%)",
    "std_dev": "Standard Deviation",
    "sharpe_ratio": "Sharpe Ratio",
}
# Default bucketing of the per-symbol lag: buckets only for hot symbols
# (see ``_lagged`` and ``operators.series``).
DEFAULT_BUCKET_SECONDS = "auto"


# ---------------------------------------------------------------- D1-D5 ----

def percent_column(df: DataFrame, column: str = "adjusted_expense_ratio", compat: bool = False) -> DataFrame:
    """Strip ``%`` and cast to a number (malformed -> NULL)."""
    return df.withColumn(column, percent_to_number(column, compat=compat))


def require(df: DataFrame, columns: Sequence[str] = ("symbol", "adjusted_expense_ratio",
                                                     "asset_under_management")) -> DataFrame:
    """Drop rows NULL (or NaN, for numeric columns) in any of ``columns``."""
    return df.dropna(subset=list(columns))


def dedupe_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """D3: whole-row duplicates (or duplicates on ``keys``).

    A hash aggregate with map-side partial de-duplication, so a hot key is
    collapsed before the shuffle.
    """
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def amount_column(df: DataFrame, column: str = "asset_under_management", compat: bool = False) -> DataFrame:
    """Amount text with unit -> number (see ``scale_amount``)."""
    return df.withColumn(column, scale_amount(column, compat=compat))


def project_funds(df: DataFrame) -> DataFrame:
    """The six silver fund columns."""
    return df.select(*FUND_COLUMNS)


def clean_funds(raw: DataFrame, compat: bool = False, dedupe_keys: Sequence[str] | None = None) -> DataFrame:
    """D1 -> D5 in the original order: percent cast, require, de-duplicate,
    amount cast, project.  The amount is parsed after ``require`` so a bad
    amount stays as a NULL row, as upstream."""
    df = percent_column(raw, compat=compat)
    df = require(df)
    df = dedupe_rows(df, dedupe_keys)
    df = amount_column(df, compat=compat)
    return project_funds(df)


def distinct_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Non-null distinct symbols, kept as a DataFrame."""
    return df.select(column).dropna().distinct()


# ---------------------------------------------------------------- D7-D13 ---

def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def first_last(prices: DataFrame, key: str = "symbol", ts: str = "ts", price: str = "adj_close",
               tiebreak: Sequence[str] = ()) -> DataFrame:
    """First and last price of each symbol in time order.

    ``min_by``/``max_by`` over a (ts, tie-breakers) struct: a partial
    aggregate, safe for hot symbols.
    """
    order = _order_struct([ts, *tiebreak])
    return prices.groupBy(key).agg(
        F.min_by(price, order).alias("first_price"),
        F.max_by(price, order).alias("last_price"),
    )


def total_return(first, last) -> Column:
    """``(last - first) / first * 100``; NULL when first is 0."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return F.try_divide(last - first, first) * F.lit(100.0)


def _lagged(prices: DataFrame, key: str, order: Sequence[str], price: str,
            bucket_seconds, hot_rows: int = DEFAULT_HOT_ROWS,
            rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, fill: bool = False) -> DataFrame:
    """Every price row with ``prev_price`` and two flags: ``_sym_first``
    (first row of its symbol) and ``_sym_last`` (last row of its symbol).

    ``bucket_seconds=None``: one window partitioned by the symbol.
    ``"auto"`` (default): one aggregate finds symbols with more than
    ``hot_rows`` rows; without any, the plain plan runs, otherwise only those
    symbols are split into buckets (see ``operators.series``).  An int uses
    fixed-width time buckets for every symbol.  All forms give the same rows;
    rows with a NULL symbol are one series.

    ``fill=True`` carries the last known price of the symbol over NULL prices
    first.

    In the bucketed forms the lag runs in two levels, so a hot symbol is
    spread over many tasks: a window over (symbol, bucket) gives the lag
    inside the bucket; one row per bucket with its last price goes into a
    small table, where a window over the symbol finds what the previous
    buckets hand on (the ``carry``); the carry is joined back on (symbol,
    bucket), the key the big side is already partitioned by.
    """
    base = prices.select(key, *order, price)
    bucketed = plan_buckets(base, key, order, bucket_seconds, hot_rows, rows_per_bucket)
    parts = [key] if bucketed is None else [key, "_bucket"]
    w = Window.partitionBy(*parts).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base if bucketed is None else bucketed
    if fill:
        rows = rows.withColumn(price, F.last(price, ignorenulls=True).over(upto))
    rows = (rows.withColumn("_prev", F.lag(price).over(w))
                .withColumn("_first", F.row_number().over(w) == 1)
                .withColumn("_last", F.lead(F.lit(1)).over(w).isNull()))
    if bucketed is None:
        return rows.withColumnsRenamed({"_prev": "prev_price", "_first": "_sym_first", "_last": "_sym_last"})
    wb = Window.partitionBy(key).orderBy("_bucket")
    earlier = wb.rowsBetween(Window.unboundedPreceding, -1)
    handed = F.last("_blast", ignorenulls=True).over(earlier) if fill else F.lag("_blast").over(wb)
    carry = (rows.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_last"), F.col(price))).alias("_blast"))
                 .withColumn("_carry", handed)
                 .withColumn("_has_prev", F.lag(F.lit(1)).over(wb).isNotNull())
                 .withColumn("_last_bucket", F.lead(F.lit(1)).over(wb).isNull())
                 .select(key, "_bucket", "_carry", "_has_prev", "_last_bucket"))
    j = join_carry(rows, carry, key)
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    if fill:        # a bucket may start with NULL prices: the carry stands for them too
        prev = F.coalesce(prev, F.col("_carry"))
        j = j.withColumn(price, F.coalesce(F.col(price), F.col("_carry")))
    return (j.withColumn("prev_price", prev)
             .withColumn("_sym_first", F.col("_first") & ~F.col("_has_prev"))
             .withColumn("_sym_last", F.col("_last") & F.col("_last_bucket")))


def daily_returns(prices: DataFrame, key: str = "symbol", ts: str = "ts", price: str = "adj_close",
                  tiebreak: Sequence[str] = (), bucket_seconds=DEFAULT_BUCKET_SECONDS,
                  hot_rows: int = DEFAULT_HOT_ROWS, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                  fill: bool = False) -> DataFrame:
    """Change of each price against the previous row of its symbol.

    Output: key, ts, tie-breakers, price, ``prev_price``, ``daily_return``
    (``price / prev_price - 1``; NULL for a symbol's first row or a zero
    previous price).  ``fill=True`` carries the last price over gaps.  See
    ``_lagged`` for the plain and the bucketed plan; both give the same rows.
    """
    order = [ts, *tiebreak]
    out = _lagged(prices, key, order, price, bucket_seconds, hot_rows, rows_per_bucket, fill) \
        .select(key, *order, price, "prev_price")
    return out.withColumn("daily_return", F.try_divide(F.col(price), F.col("prev_price")) - F.lit(1.0))


# Width of the pieces that a symbol's series is cut into (seconds, or units of a numeric order column).
DEFAULT_PIECE = 30 * 86_400.0


def series_pieces(prices: DataFrame, key: str = "symbol", ts: str = "ts", price: str = "adj_close", tiebreak: Sequence[str] = (),
                  piece: float = DEFAULT_PIECE) -> DataFrame:
    """The mergeable summary of each piece of a symbol's series, one row per
    (symbol, ``_piece``): ``first`` and ``last`` price in order, and ``n``,
    ``mean`` and ``m2`` (sum of squared differences from the mean) of the
    returns between its rows.

    A piece is a fixed stretch of time, so a symbol of any size is spread over
    as many tasks as it has pieces, without counting rows first.  Rows without a
    time are a piece of their own, before all others."""
    order = [ts, *tiebreak]
    rows = prices.select(key, *order, price)
    rows = rows.withColumn("_piece", F.coalesce(F.floor(seconds(ts, rows) / F.lit(float(piece))), F.lit(NULL_BUCKET)))
    w = Window.partitionBy(key, "_piece").orderBy(*order)
    rows = rows.withColumn("_ret", F.try_divide(F.col(price), F.lag(price).over(w)) - F.lit(1.0)) \
               .withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    return rows.groupBy(key, "_piece").agg(
        F.max(F.when(F.col("_first"), F.col(price))).alias("first"), F.max(F.when(F.col("_last"), F.col(price))).alias("last"),
        F.count("_ret").alias("n"), F.coalesce(F.avg("_ret"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("_ret") * F.count("_ret"), F.lit(0.0)).alias("m2"))


def merged_pieces(pieces: DataFrame, key: str = "symbol") -> DataFrame:
    """Pieces of a symbol in order -> one summary: the return from each piece's
    last price to the next one's first joins that piece, then counts, means and
    squared differences are merged by Chan's formula around the common mean."""
    w = Window.partitionBy(key)
    step = F.try_divide(F.col("first"), F.lag("last").over(w.orderBy("_piece"))) - F.lit(1.0)
    p = pieces.withColumn("_step", step)
    n2 = F.col("n") + F.col("_step").isNotNull().cast("long")
    delta = F.coalesce(F.col("_step") - F.col("mean"), F.lit(0.0))
    p = p.select(key, "_piece", "first", "last", n2.alias("n"), (F.col("mean") + F.coalesce(F.try_divide(delta, n2), F.lit(0.0))).alias("mean"),
                 (F.col("m2") + F.coalesce(F.try_divide(delta * delta * F.col("n"), n2), F.lit(0.0))).alias("m2"))
    p = p.withColumn("_mean", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(w), F.sum("n").over(w)))
    off = F.col("mean") - F.col("_mean")
    return p.groupBy(key).agg(F.min_by("first", "_piece").alias("first"), F.max_by("last", "_piece").alias("last"), F.sum("n").alias("n"),
                              F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def symbol_metrics(prices: DataFrame, key: str = "symbol", ts: str = "ts", price: str = "adj_close",
                   tiebreak: Sequence[str] = (), risk_free: float = 0.0, piece: float = DEFAULT_PIECE) -> DataFrame:
    """D7-D13 in one read of the prices.

    Columns: key, first_price, last_price, total_return_pct (D8),
    mean_return (D11), std_dev (D10, sample deviation), sharpe_ratio (D12,
    ``(mean - rf) / sd``, NULL when sd is 0 or undefined), n_returns.

    Each symbol's series is summarised piece by piece (``series_pieces``) and
    the pieces are merged (``merged_pieces``), so the rows are shuffled once, by
    (symbol, piece), and only one row per piece goes on by symbol.  Any
    ``piece`` width gives the same metrics.
    """
    g = merged_pieces(series_pieces(prices, key, ts, price, tiebreak, piece), key)
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return (g.select(key, F.col("first").alias("first_price"), F.col("last").alias("last_price"), F.col("mean").alias("mean_return"),
                     sd.alias("std_dev"), F.col("n").alias("n_returns"))
             .withColumn("total_return_pct", total_return("first_price", "last_price"))
             .withColumn("sharpe_ratio", sharpe("mean_return", "std_dev", risk_free)))


def sharpe(mean_return, std_dev, risk_free: float = 0.0) -> Column:
    """D12 as an expression."""
    m = F.col(mean_return) if isinstance(mean_return, str) else mean_return
    s = F.col(std_dev) if isinstance(std_dev, str) else std_dev
    return F.when(s != 0, F.try_divide(m - F.lit(float(risk_free)), s))


# ---------------------------------------------------------------- D14-D16 --

def enrich(funds: DataFrame, metrics: DataFrame, key: str = "symbol", reference_names: bool = False) -> DataFrame:
    """Left join the per-symbol metrics onto the funds; nine columns.

    The metrics side has one row per symbol and grows with the data, so the
    join strategy is left to AQE (broadcast only when its measured size is
    below the threshold; skew join otherwise).
    """
    m = metrics.select(F.col(key).alias("_mkey"), *METRIC_COLUMNS)
    out = (funds.join(m, funds[key] == m["_mkey"], "left")
           .select(*[funds[c] for c in FUND_COLUMNS], *[m[c] for c in METRIC_COLUMNS]))
    if reference_names:
        out = out.withColumnsRenamed(REFERENCE_METRIC_NAMES)
    return out


_TEXTS = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _payload(data_col: str) -> Column:
    """The payload's elements as an array of variants, parsed once; NULL unless it is a JSON array."""
    return F.expr(f"try_variant_get(try_parse_json(CASE WHEN startswith(ltrim(`{data_col}`), '[') THEN `{data_col}` END), '$', 'array<variant>')")


def _field(f: T.StructField) -> tuple[Column, Column]:
    """(value, whether there is a value of another kind) of a record's field.

    JSON says of each value whether it is a text, a whole number or another
    number; a text is no number and 1.5 no whole number, as in ``from_json``."""
    part = f"try_variant_get(_v, '$[\\'{f.name}\\']', 'variant')"
    value, kind = F.expr(f"try_variant_get({part}, '$', '{f.dataType.simpleString()}')"), F.expr(f"schema_of_variant({part})")
    if isinstance(f.dataType, T.IntegralType):
        fits = kind == "BIGINT"
    elif isinstance(f.dataType, _TEXTS):
        fits = F.lit(True) if isinstance(f.dataType, T.StringType) else kind == "STRING"
    elif isinstance(f.dataType, T.BooleanType):
        fits = kind == "BOOLEAN"
    else:
        fits = ~kind.isin("STRING", "BOOLEAN")
    value = F.when(fits, value)
    return value, value.isNull() & F.expr(f"NOT coalesce(is_variant_null({part}), true) AND {part} IS NOT NULL")


def bronze_records(bronze: DataFrame, message_type: str | None, record_schema: T.StructType,
                   type_col: str = "message_type", data_col: str = "data", text: bool = False) -> DataFrame:
    """Every record of the JSON-array payloads with its typed fields and
    ``_failed`` (fields that have a value of another kind, comma separated; ``*``
    for an element that is no object).  ``text``: also ``_record``, its text.

    A payload is parsed once, into a variant; fields are read out of that.  An
    object with a key twice is no JSON for Spark's variants: the message is a
    reject (``bronze_rejects``)."""
    df = bronze if message_type is None else bronze.filter(F.col(type_col) == message_type)
    items = _payload(data_col)
    if text:                                   # the elements as they were written, for the quarantine
        items = _with_texts(items, data_col)
    df = df.select(F.col(type_col).alias(type_col), F.explode(items).alias("_e"))
    df = df.select(type_col, *([F.col("_e.v").alias("_v"), F.col("_e.t").alias("_record")] if text else [F.col("_e").alias("_v")]))
    values, bad = _judged(record_schema)
    return df.select(type_col, *values, *(["_record"] if text else []), bad.alias("_failed"))


def _with_texts(items: Column, data_col: str) -> Column:
    return F.arrays_zip(items.alias("v"), F.from_json(F.col(data_col), T.ArrayType(T.StringType())).alias("t"))


def _judged(record_schema: T.StructType) -> tuple[list[Column], Column]:
    """Typed fields of the variant ``_v``, and the names of those that have a value of another kind."""
    fields = [(f.name, *_field(f)) for f in record_schema.fields]
    is_object = F.coalesce(F.expr("startswith(schema_of_variant(_v), 'OBJECT')"), F.lit(False))
    bad = F.when(~is_object, F.lit("*")).otherwise(F.concat_ws(",", *[F.when(wrong, F.lit(n)) for n, _v, wrong in fields]))
    return [v.alias(n) for n, v, _w in fields], bad


def bronze_verdicts(bronze: DataFrame, message_type: str | None, record_schema: T.StructType,
                    type_col: str = "message_type", data_col: str = "data", out: str = "verdict") -> DataFrame:
    """Records and refused messages together, each message parsed once.

    Column ``out`` says ``accepted``, ``record`` or ``message``; ``_record`` has
    the text of what was refused, ``_failed`` the fields (``split_bronze`` writes them)."""
    df = bronze if message_type is None else bronze.filter(F.col(type_col) == message_type)
    df = df.select(F.col(type_col).alias(type_col), F.col(data_col).alias("_data"), _payload(data_col).alias("_items"))
    refused = F.col("_items").isNull()
    one = F.array(F.struct(F.lit(None).cast("variant").alias("v"), F.col("_data").alias("t")))
    items = F.when(refused, one).otherwise(_with_texts(F.col("_items"), "_data"))
    df = df.select(type_col, refused.alias("_refused"), F.explode(items).alias("_e"))
    df = df.select(type_col, "_refused", F.col("_e.v").alias("_v"), F.col("_e.t").alias("_record"))
    values, bad = _judged(record_schema)
    failed = F.when(~F.col("_refused"), bad)
    verdict = F.when(F.col("_refused"), "message").when(F.col("_failed") == "", "accepted").otherwise("record")
    return (df.select(type_col, *values, "_record", failed.alias("_failed"), "_refused")
              .select(type_col, *[f.name for f in record_schema.fields], F.when(verdict != "accepted", F.col("_record")).alias("_record"),
                      F.when(verdict == "record", F.col("_failed")).alias("_failed"), verdict.alias(out)))


def unnest_bronze(bronze: DataFrame, message_type: str | None, record_schema: T.StructType,
                  type_col: str = "message_type", data_col: str = "data") -> DataFrame:
    """One bronze message type -> typed record rows.

    Only payloads that are JSON arrays are expanded (an error object sent as
    data would otherwise parse as one all-NULL record), and only records all
    of whose fields parse; see ``bronze_rejects`` and ``record_rejects`` for
    the rest.
    """
    return bronze_records(bronze, message_type, record_schema, type_col, data_col).filter("_failed = ''").drop("_failed")


def record_rejects(bronze: DataFrame, message_type: str | None, record_schema: T.StructType,
                   type_col: str = "message_type", data_col: str = "data") -> DataFrame:
    """Records with a field that doesn't parse: type, ``record`` text, ``failed_fields`` (quarantine)."""
    got = bronze_records(bronze, message_type, record_schema, type_col, data_col, text=True).filter("_failed <> ''")
    return got.select(type_col, F.col("_record").alias("record"), F.col("_failed").alias("failed_fields"))


def bronze_rejects(bronze: DataFrame, record_schema: T.StructType, type_col: str = "message_type",
                   data_col: str = "data") -> DataFrame:
    """Messages whose payload is not a JSON array of records (quarantine)."""
    return bronze.filter(_payload(data_col).isNull())
