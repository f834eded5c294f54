"""Hot-key splitting for per-key ordered computations (lag, running state).

A window partitioned by a key puts all rows of that key into one task.  When
one key may hold a large share of the data, its rows are split into buckets
that follow each other in the key's order; every other key keeps a single
bucket, so the common case stays the plain one-window plan.  Rows with a NULL
key or NULL order values are rows like any other in both forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.session import materialize

# A key with more rows than this is split ...
DEFAULT_HOT_ROWS = 1_000_000
# ... into buckets of about this many rows each.
DEFAULT_ROWS_PER_BUCKET = 100_000
# Rows of hot keys that one task sorts and cuts into buckets.
ROWS_PER_TASK = 250_000
# At most N / hot_rows keys can be hot; beyond this many the join stays a shuffle join.
MAX_HOT_KEYS_BROADCAST = 200_000

_TIME_TYPES = ("timestamp", "timestamp_ntz", "date")
# Bucket of rows without an order value: before all others, as in the windows.
NULL_BUCKET = -(1 << 62)


def seconds(ts: str, df: DataFrame) -> Column:
    """Order position as a number: seconds for time columns, the value itself
    for numeric order columns (page numbers, turns)."""
    if dict(df.dtypes).get(ts) not in _TIME_TYPES:
        return F.col(ts).cast("double")
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def hot_keys(df: DataFrame, key: str, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame | None:
    """Keys (NULL included) with more than ``hot_rows`` rows and their counts
    ``_n``; ``None`` when there are none.

    One partial aggregate, a shuffle of one row per key and task; its result
    is written once below the checkpoint folder.  This runs a job when called.
    """
    found = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > F.lit(int(hot_rows))),
                        "hot-keys", partitions=None)
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, key: str, order: Sequence[str], hot: DataFrame,
              rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``_bucket``: 0 for cold keys; rows of hot keys are range-partitioned
    by (key, order) and sorted, and every ``rows_per_bucket`` rows of a range
    are a bucket.

    The ranges are quantiles of the whole order tuple, so a burst of events in
    one second is split by the tie-breakers.  The number of ranges follows the
    rows and the cores, not the size of a bucket, so small buckets cost no
    tasks.  A bucket's number is that of its first row (range, then place in
    it).  The hot rows are written once with their bucket, so all readers see
    the same cut, also of rows that are equal in key and every order column.
    """
    n = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    listed = hot.select(F.col(key).alias("_hot_key"))
    listed = F.broadcast(listed) if n[0] <= MAX_HOT_KEYS_BROADCAST else listed
    same = df[key].eqNullSafe(listed["_hot_key"])
    buckets = max(2, -(-int(n[1]) // int(rows_per_bucket)))
    ranges = min(buckets, max(df.sparkSession.sparkContext.defaultParallelism, -(-int(n[1]) // ROWS_PER_TASK)))
    place = F.monotonically_increasing_id()          # the range above 33 bits, the place in it below
    split = (df.join(listed, same, "left_semi").repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
               .withColumn("_bucket", place).withColumn("_bucket", F.col("_bucket") - F.col("_bucket").bitwiseAND(F.lit((1 << 33) - 1)) % int(rows_per_bucket)))
    split = materialize(split, "hot-rows", partitions=None)
    cold = df.join(listed, same, "left_anti").withColumn("_bucket", F.lit(0).cast("long"))
    return cold.unionByName(split)


def plan_buckets(df: DataFrame, key: str, order: Sequence[str], bucket_seconds, hot_rows: int = DEFAULT_HOT_ROWS,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame | None:
    """Resolve a ``bucket_seconds`` argument: ``None`` -> plain plan (returns
    None); an int -> fixed-width buckets of the first order column for every
    key; ``"auto"`` -> buckets only for hot keys, or the plain plan when there
    are none; a DataFrame -> hot keys found beforehand (``hot_keys``)."""
    if bucket_seconds is None:
        return None
    if isinstance(bucket_seconds, DataFrame):
        return split_hot(df, key, order, bucket_seconds, rows_per_bucket)
    if bucket_seconds == "auto":
        hot = hot_keys(df, key, hot_rows)
        return None if hot is None else split_hot(df, key, order, hot, rows_per_bucket)
    b = F.floor(seconds(order[0], df) / F.lit(float(bucket_seconds)))
    return df.withColumn("_bucket", F.coalesce(b, F.lit(NULL_BUCKET)))


def join_carry(rows: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    """``rows`` with the carried columns of their (key, bucket); NULL keys match."""
    c = carry.withColumnsRenamed({key: "_carry_key", "_bucket": "_carry_bucket"})
    on = rows[key].eqNullSafe(c["_carry_key"]) & (rows["_bucket"] == c["_carry_bucket"])
    return rows.join(c, on, "left").drop("_carry_key", "_carry_bucket")
