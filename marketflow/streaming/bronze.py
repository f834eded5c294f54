"""Bronze ingest as one Structured Streaming query (A1 -> A2 -> [C4] -> A3)."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketflow.operators.quality import keep_new
from marketflow.session import path_exists
from marketflow.sources.envelope import decode_envelope, read_envelope_stream


def write_bronze_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "json",
                        partition_by: Sequence[str] | None = ("message_type",),
                        available_now: bool = False, processing_time: str | None = None,
                        query_name: str | None = None) -> StreamingQuery:
    """A3: append-mode file sink with a checkpoint (exactly-once file commits).

    ``path`` and ``checkpoint`` are any Hadoop paths (credentials through
    ``spark.hadoop.*`` settings).  Partitioning by ``message_type`` lets a
    silver job read one feed with partition pruning.
    """
    w = df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    if query_name:
        w = w.queryName(query_name)
    return w.start(path)


def bronze_stream(spark: SparkSession, sink_path: str, checkpoint: str, source_fmt: str = "kafka",
                  source_path: str | None = None, topic: str | None = None, servers: str | None = None,
                  source_options: dict | None = None, available_now: bool = False,
                  sink_fmt: str = "json") -> StreamingQuery:
    """A1 + A2 + A3: envelopes from Kafka (or a file directory) to bronze files."""
    raw = read_envelope_stream(spark, source_fmt, path=source_path, topic=topic, servers=servers,
                               options=source_options)
    return write_bronze_stream(decode_envelope(raw), sink_path, checkpoint, fmt=sink_fmt,
                               available_now=available_now)


def keep_new_stream(df: DataFrame, sink_path: str, checkpoint: str, keys: Sequence[str],
                    content: Sequence[str] | None = None, fmt: str = "parquet",
                    available_now: bool = False, buckets: int | None = None) -> StreamingQuery:
    """C4 (stream, exact): pass only records not stored in the sink yet.

    Each micro-batch is anti-joined (key + content hash) against everything
    the sink holds from earlier batches - the sink keeps ``_content_hash``,
    so only keys and hashes are read back - and written to its own
    ``_batch_id`` partition with dynamic partition overwrite, so a batch
    re-run after a failure replaces its own output and never duplicates.
    State is the sink itself: exact, and not bounded by memory.

    ``buckets``: the sink is also partitioned by a hash of the keys
    (``_bucket``), and a batch reads back only the folders its own keys fall
    into, at most ``buckets`` of them.  Choose it well above the keys of a
    usual batch, and keep it for the life of the sink.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(buckets)).cast("int") if buckets else None
    folders = (["_bucket"] if buckets else []) + ["_batch_id"]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, sink_path):
            stored = spark.read.format(fmt).load(sink_path)
            missing = [c for c in (*keys, "_content_hash", *folders) if c not in stored.columns]
            if missing:
                raise ValueError(f"the sink {sink_path} has no column {missing}; it wasn't written by keep_new_stream")
            if not buckets and "_bucket" in stored.columns:
                raise ValueError(f"the sink {sink_path} was written with buckets; name the same number again")
            stored = stored.filter(F.col("_batch_id") < batch_id)
            if buckets:
                touched = [r["_bucket"] for r in batch.select(bucket.alias("_bucket")).distinct().collect()]
                stored = stored.filter(F.col("_bucket").isin(touched))
            stored = stored.select(*keys, "_content_hash")
        else:                      # the first batch
            stored = batch.limit(0)
        new = keep_new(batch, stored, keys, content, keep_hash=True)
        new = new.withColumn("_batch_id", F.lit(batch_id).cast("long"))
        (new.withColumn("_bucket", bucket) if buckets else new).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*folders).format(fmt).save(sink_path)

    w = df.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


# Spark's RocksDB state store: state on local disk of the executors with
# incremental checkpoints to the checkpoint folder, so it is not bounded by
# executor memory.
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession, provider: str | None = ROCKSDB_PROVIDER):
    """Start stateful queries inside this block with ``provider`` as their
    state store (``None`` keeps the session's); the session setting is
    restored afterwards.  A query keeps the provider it first ran with."""
    prev = spark.conf.get(_PROVIDER_CONF, None)
    if provider:
        spark.conf.set(_PROVIDER_CONF, provider)
    try:
        yield
    finally:
        if provider:
            if prev is None:
                spark.conf.unset(_PROVIDER_CONF)
            else:
                spark.conf.set(_PROVIDER_CONF, prev)


def keep_new_state(df: DataFrame, keys: Sequence[str], content: Sequence[str] | None = None) -> DataFrame:
    """C4 (stream, exact, keyed state): a record passes the first time its
    (key, content hash) is seen, in any micro-batch.

    Streaming ``dropDuplicates`` without a watermark: the state store keeps
    one entry per seen (key, hash) and each row costs one state lookup, so a
    micro-batch does not re-read what was stored before (``keep_new_stream``
    does).  The state is partitioned by the hash of (key, hash), so a hot key
    with many versions is spread too.
    """
    cols = list(content) if content is not None else [c for c in df.columns if c not in keys]
    return (df.withColumn("_content_hash", F.xxhash64(*[F.col(c) for c in cols]))
              .dropDuplicates([*keys, "_content_hash"]).drop("_content_hash"))


def keep_new_state_stream(df: DataFrame, sink_path: str, checkpoint: str, keys: Sequence[str],
                          content: Sequence[str] | None = None, fmt: str = "parquet",
                          available_now: bool = False, provider: str | None = ROCKSDB_PROVIDER) -> StreamingQuery:
    """``keep_new_state`` into an append file sink with a checkpoint.

    ``provider`` is the state store the query starts with (RocksDB by
    default; ``None`` keeps the session's).  A restart from the checkpoint
    resumes with the stored state and the file sink's commit log, so no
    record is written twice.
    """
    w = (keep_new_state(df, keys, content).writeStream.outputMode("append").format(fmt)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    with state_store(df.sparkSession, provider):
        return w.start(sink_path)


def keep_new_bounded(df: DataFrame, keys: Sequence[str], event_time: str, delay: str,
                     content: Sequence[str] | None = None) -> DataFrame:
    """C4 (stream, bounded state): ``dropDuplicatesWithinWatermark`` on key +
    content hash.  Keys are forgotten after ``delay``, so a snapshot re-sent
    later than that passes again; use ``keep_new_stream`` for exactness."""
    cols = list(content) if content is not None else [c for c in df.columns if c not in keys and c != event_time]
    d = (df.withColumn(event_time, F.col(event_time).cast("timestamp"))
           .withColumn("_content_hash", F.xxhash64(*[F.col(c) for c in cols]))
           .withWatermark(event_time, delay))
    return d.dropDuplicatesWithinWatermark([*keys, "_content_hash"]).drop("_content_hash")
