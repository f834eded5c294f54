"""Message envelope: stream source, decoding and packing (A1, A2, A5).

One message is the UTF-8 JSON ``{"type": ..., "data": ...}`` where ``data``
holds the JSON text of an array of records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.constants import MAX_MESSAGE_BYTES_PRODUCER
from marketflow.session import materialize

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
])
FILE_SOURCE_SCHEMA = T.StructType([T.StructField("value", T.StringType(), True)])


def read_envelope_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                         topic: str | None = None, servers: str | None = None,
                         options: Mapping[str, str] | None = None,
                         schema: T.StructType | None = None) -> DataFrame:
    """A1: endless stream of envelope records with a ``value`` column.

    ``fmt="kafka"`` subscribes to ``topic`` (needs the Kafka connector on the
    classpath; the starting offset is Spark's default, latest, unless given
    in ``options``).  Any file format (``text``, ``json``, ``parquet``) reads a
    directory instead, one envelope per line/row.
    """
    opts = dict(options or {})
    r = spark.readStream.format(fmt)
    if fmt == "kafka":
        r = r.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        return r.options(**opts).load()
    if fmt == "text":
        return r.options(**opts).load(path)
    return r.schema(schema or FILE_SOURCE_SCHEMA).options(**opts).load(path)


def decode_envelope(df: DataFrame, value_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A2: bytes/text -> ``message_type``, ``data``.

    Malformed JSON yields NULL fields and the row is kept (it is quarantined
    later by the unnest step).
    """
    env = F.from_json(F.col(value_col).cast("string"), ENVELOPE_SCHEMA)
    return df.select(*keep, env.getField("type").alias("message_type"), env.getField("data").alias("data"))


def publish_feed(records: DataFrame, type_col: str, record_cols: Sequence[str] | None = None,
                 max_bytes: int = MAX_MESSAGE_BYTES_PRODUCER, fill: float = 0.5, seed: int = 17) -> DataFrame:
    """A5: pack the records of each feed into envelopes below ``max_bytes``.

    Each record becomes its JSON text; equal records of a feed are counted
    first and numbered, so nothing depends on row order and a re-run makes the
    same envelopes.  An aggregate measures the bytes of every feed as they
    will stand in the envelope (escaped); from it every feed gets
    ``ceil(bytes / (fill * max_bytes))`` chunks, and each record a chunk by
    the hash of its text and number.  A chunk then holds about ``fill *
    max_bytes`` bytes, so no group collects more than one message's worth of
    rows even when one feed holds most of the data.

    Output: ``message_type``, ``chunk``, ``n_records``, ``n_bytes`` (escaped
    record bytes), ``value`` (the envelope text) and ``fits`` (value within
    the limit; a single record larger than the limit cannot fit).
    """
    cols = list(record_cols) if record_cols is not None else [c for c in records.columns if c != type_col]
    rec = (records.select(F.col(type_col).cast("string").alias("message_type"),
                          F.to_json(F.struct(*[F.col(c) for c in cols])).alias("_json"))
                  .groupBy("message_type", "_json").agg(F.count(F.lit(1)).alias("_copies")))
    escaped = F.octet_length(F.to_json(F.struct(F.col("_json").alias("d")))) - F.lit(8)     # without {"d":""}
    rec = rec.withColumn("_bytes", escaped)
    target = max(1, int(max_bytes * fill))
    totals = materialize(rec.groupBy("message_type").agg(F.sum(F.col("_bytes") * F.col("_copies")).alias("_total"))
                            .select(F.col("message_type").alias("_type"),
                                    F.greatest(F.lit(1), F.ceil(F.col("_total") / F.lit(target))).alias("_n_chunks")),
                         "feed-totals", partitions=None)
    each = rec.select("message_type", "_json", "_bytes", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_no"))
    chunk = F.pmod(F.xxhash64("_json", "_no", F.lit(seed)), F.col("_n_chunks"))
    packed = (each.join(totals, each["message_type"].eqNullSafe(totals["_type"]), "inner")
                  .select("message_type", chunk.alias("chunk"), "_json", "_bytes")
                  .groupBy("message_type", "chunk")
                  .agg(F.sort_array(F.collect_list("_json")).alias("_items"), F.count(F.lit(1)).alias("n_records"),
                       F.sum("_bytes").alias("n_bytes")))
    data = F.concat(F.lit("["), F.array_join("_items", ","), F.lit("]"))
    value = F.to_json(F.struct(F.col("message_type").alias("type"), data.alias("data")))
    return (packed.select("message_type", "chunk", "n_records", "n_bytes", value.alias("value"))
                  .withColumn("fits", F.octet_length("value") <= F.lit(int(max_bytes))))


def write_messages(packed: DataFrame, fmt: str = "kafka", path: str | None = None, topic: str | None = None,
                   servers: str | None = None, mode: str = "append",
                   max_bytes: int = MAX_MESSAGE_BYTES_PRODUCER) -> DataFrame:
    """A5 sink: send packed envelopes (``publish_feed`` output) to Kafka, or
    write them as text lines (one envelope per line) for a file-fed stream.

    The packed messages are written once to the shared folder, so packing runs
    once.  Those within ``max_bytes`` are sent; the others are returned
    (``message_type``, ``value``), never truncated.
    """
    packed = materialize(packed.select("message_type", "value"), "packed-messages", partitions=None)
    fits = F.octet_length("value") <= F.lit(int(max_bytes))
    out = packed.filter(fits).select(F.col("message_type").alias("key"), F.col("value"))
    if fmt == "kafka":
        (out.write.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).save())
    else:
        out.select("value").write.mode(mode).text(path)
    return packed.filter(~fits)
