"""A cache table that survives the job (B13, stored form).

Every write makes a whole new snapshot, a Parquet table in a folder of its own
that is never changed again, and then one small version file that names it.
The newest version file is the pointer: readers take the snapshot it names and
keep that one, whatever is written meanwhile; a writer that dies before its
version file exists has changed nothing.  Version files are put in place whole
and never replaced, so of two writers on the same base only one gets the next
version; the other merges again on top of it.  This needs a file system whose
rename is atomic (HDFS, ABFS, a local disk); elsewhere let one job write.

    root/snapshots/<name>/*.parquet    key, value, written_at
    root/versions/0000000007           text: <name>
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.session import delete_path, file_times, put_new, read_small

CACHE_SCHEMA = "cache_key string, url string, written_at bigint"


def cache_version(spark: SparkSession, root: str) -> int:
    """The newest version of the cache; 0 if nothing was ever stored."""
    return max((int(name) for name in file_times(spark, f"{root}/versions") if name.isdigit()), default=0)


def _snapshot(spark: SparkSession, root: str, version: int) -> str:
    return f"{root}/snapshots/{read_small(spark, f'{root}/versions/{version:010d}')}"


def read_cache(spark: SparkSession, root: str, version: int | None = None, schema: str = CACHE_SCHEMA) -> DataFrame:
    """The cache as of a version (the newest by default), one row per key.

    What is returned reads one snapshot and doesn't change with later writes.
    A cache that nobody has written is empty."""
    version = cache_version(spark, root) if version is None else version
    if version == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_snapshot(spark, root, version))


def merge_cache(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """The newest write of each key; of writes at the same time the largest
    value, NULL the smallest.  One partial aggregate.  A NULL key is no key and isn't stored."""
    key, value, at = stored.columns
    both = stored.unionByName(writes.select(key, value, at)).filter(F.col(key).isNotNull())
    newest = F.max(F.struct(F.col(at), F.col(value)))
    return both.groupBy(key).agg(newest.alias("_new")).select(key, F.col(f"_new.{value}").alias(value), F.col(f"_new.{at}").alias(at))


def store_cache(writes: DataFrame, root: str, schema: str = CACHE_SCHEMA, tries: int = 20) -> int:
    """Merge a batch of writes (columns of ``schema``: key, value, time of
    writing) into the cache and return the new version.

    ``writes`` is computed again if another writer was faster, so it must give
    the same rows each time."""
    spark = writes.sparkSession
    for _ in range(tries):
        base = cache_version(spark, root)
        name = f"{base + 1:010d}-{uuid.uuid4().hex[:12]}"
        merged = merge_cache(read_cache(spark, root, base, schema), writes)
        merged.write.parquet(f"{root}/snapshots/{name}")
        if put_new(spark, f"{root}/versions/{base + 1:010d}", name):
            return base + 1
        delete_path(spark, f"{root}/snapshots/{name}")
    raise RuntimeError(f"the cache {root} was written by others {tries} times in a row")


def fill_cache(requests: DataFrame, root: str, generate: Callable[[DataFrame], DataFrame],
               schema: str = CACHE_SCHEMA) -> DataFrame:
    """Requests with their value and ``hit``: stored keys are looked up, the
    others are generated once per key, stored, and looked up then.

    ``generate`` gets the missing keys (one column, no NULL, no repeats) and
    returns key and value.  A NULL key is never a hit and has no value.  Rows
    are neither added nor dropped."""
    spark = requests.sparkSession
    before = cache_version(spark, root)
    old = read_cache(spark, root, before, schema)
    key, value, at = old.columns
    missing = requests.select(key).filter(F.col(key).isNotNull()).distinct().join(old.select(key), key, "left_anti")
    made = generate(missing).select(key, value, F.lit(before + 1).cast(old.schema[at].dataType).alias(at))
    after = store_cache(made, root, schema)
    known = read_cache(spark, root, after, schema).select(key, value)
    hits = old.select(key, F.lit(True).alias("_hit"))
    return (requests.join(known, key, "left").join(hits, key, "left")
            .withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def expire_cache(spark: SparkSession, root: str, keep: int = 2, min_age_seconds: int = 86_400) -> list[str]:
    """Delete snapshots that none of the ``keep`` newest versions names and
    return their names.

    Snapshots younger than ``min_age_seconds`` stay: a writer may be about to
    name them, a reader still on them.  Version files stay, so numbers are
    never given twice."""
    newest = cache_version(spark, root)
    named = {read_small(spark, f"{root}/versions/{v:010d}") for v in range(max(1, newest - keep + 1), newest + 1)}
    times = file_times(spark, f"{root}/snapshots")
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    old = sorted(n for n, t in times.items() if n not in named and now - t >= min_age_seconds * 1000)
    for name in old:
        delete_path(spark, f"{root}/snapshots/{name}")
    return old
