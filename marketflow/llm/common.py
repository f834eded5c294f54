"""Helpers shared by the operators of this subpackage.

Conventions
-----------
* ``documents`` rows are never identified by ``doc_id`` alone: ids may be null
  or repeated.  ``stored_rows`` writes a table once to the shared checkpoint
  folder with a row number that is fixed from then on, also when an executor
  is lost and a task reads again.
* Input columns travel packed in one struct (``ROW``), so that extra columns
  whose names clash with an operator's own do no harm.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.session import materialize

ROW = "__row"
RID = "__rid"
WHITE = "\t\n\x0b\x0c\r"


def white_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null text: none)."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(flat, " "), "")


def white_word_count(text: Column) -> Column:
    """Number of words without keeping them (long)."""
    return F.size(white_words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` plus ``RID``, written once below spark.checkpoint.dir and read back."""
    return materialize(df.withColumn(RID, F.monotonically_increasing_id()), name, partitions=None)


def packed(df: DataFrame, *cols: Column) -> DataFrame:
    """The whole row as one struct column plus derived columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *cols)


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The packed columns again, then ``added``; a clashing input column gives way."""
    names = [f.name for f in df.schema[ROW].dataType.fields if f.name.lower() not in added]
    return df.select(*[F.col(ROW).getField(n).alias(n) for n in names], *[c.alias(n) for n, c in added.items()])


BROADCAST_RIDS = 1_000_000     # 8 MB of row numbers at most


def without_rids(rows: DataFrame, rids: DataFrame, name: str) -> DataFrame:
    """``rows`` whose ``RID`` isn't in ``rids``; the list is broadcast behind a
    check of its length, else both sides are joined on the unique number."""
    listed = materialize(rids.select(RID), name, partitions=None)
    small = listed.count() <= BROADCAST_RIDS
    return rows.join(F.broadcast(listed) if small else listed, RID, "left_anti")


def hash_bitmap(spark: SparkSession, table: DataFrame, column: str, min_bits: int = 16, max_bits: int = 27):
    """Test for membership of 64-bit hashes in ``table.column``, without false
    negatives: a bitmap over the hashes' top bits, at most 2**max_bits of them
    (16 MB) whatever the table's size, gathered in packed pieces of 16 KB and broadcast."""
    bits = min(max(int(table.count() * 32).bit_length(), min_bits), max_bits)
    slot = F.shiftrightunsigned(column, 64 - bits)
    found = (table.groupBy(F.shiftright(slot, 5).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 31 as int))")).alias("set")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 12, np.uint32)
        held[part["word"].to_numpy(np.int64) & 4095] = part["set"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"chunk": [int(part["word"].iloc[0]) >> 12], "bits": [held.tobytes()]})

    words = np.zeros(max(1 << (bits - 5), 1 << 12), np.uint32)
    for row in found.groupBy(F.shiftright("word", 12)).applyInPandas(pack, "chunk bigint, bits binary").collect():
        words[row["chunk"] << 12:(row["chunk"] + 1) << 12] = np.frombuffer(row["bits"], np.uint32)
    shared = spark.sparkContext.broadcast(words)

    def known(hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
        return (shared.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1
    return known


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans nobody holds any more; it does
    so when the driver's garbage is collected, which may else come much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_rids(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` whose ``RID`` is in ``listed`` (a stored table of row numbers)."""
    small = listed.count() <= BROADCAST_RIDS
    return rows.join(F.broadcast(listed) if small else listed, RID, "left_semi")
