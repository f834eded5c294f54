"""Sharding by histogram sort.

Rows are sorted by a key (hash of the text, then a hash of the row), so equal
texts are neighbours.  Splitters are found without moving a row: a histogram of
exact bytes over 4096 key ranges gives the bytes below every candidate
boundary; a splitter whose nearest boundary misses its share by more than the
tolerance is refined in the key range that holds it, until all meet the
tolerance.  Only a text group larger than the tolerance is cut (by the row
hash).  Then rows are exchanged once.

Within a shard, rows are numbered without a gap: rows of a shard and a key
prefix form a piece of bounded size, pieces get offsets from their counts, and
rows are numbered within pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, stored_rows

DIGIT = 12
LEVELS = 5                    # digits of each of the two 60-bit keys
TOLERANCE = 0.002             # of a shard's bytes
PIECE_ROWS = 10_000
BROADCAST_HOT = 100_000


def _digit(level: int) -> Column:
    """Digit ``level`` (0 to 9) of the key (k1, k2), highest first."""
    key, place = ("k1", level) if level < LEVELS else ("k2", level - LEVELS)
    return F.shiftrightunsigned(key, DIGIT * (LEVELS - 1 - place)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _inside(prefix: tuple[int, ...]) -> Column:
    """Rows whose key starts with these digits."""
    ok = F.lit(True)
    for name, part in (("k1", prefix[:LEVELS]), ("k2", prefix[LEVELS:])):
        if part:
            value = 0
            for d in part:
                value = value << DIGIT | d
            ok = ok & (F.shiftrightunsigned(name, DIGIT * (LEVELS - len(part))) == F.lit(value).cast("long"))
    return ok


def _bound(prefix: tuple[int, ...]) -> tuple[int, int]:
    """Smallest key (k1, k2) with these digits; a last digit of 4096 carries over."""
    value = 0
    for i in range(2 * LEVELS):
        value = (value << DIGIT) + (prefix[i] if i < len(prefix) else 0)
    return value >> DIGIT * LEVELS, value & (1 << DIGIT * LEVELS) - 1


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``keys(k1, k2, size)`` -> shards - 1 keys; a row belongs to the shard of
    the number of splitters that are not above its key.  Each round is one
    aggregate that returns at most 4096 rows per open splitter."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    allowed = max(1.0, tolerance * total / shards)
    open_ = {j: ((), 0) for j in range(1, shards)}        # splitter -> (digits so far, bytes below them)
    best: dict[int, tuple[float, tuple[int, int]]] = {}
    for level in range(2 * LEVELS):
        cells = sorted({at for at, _ in open_.values()})
        which = F.lit(None).cast("int")
        for i, at in enumerate(cells):
            which = F.when(_inside(at), i).otherwise(which) if at else F.lit(i)
        got = (keys.select(which.alias("cell"), _digit(level).cast("int").alias("digit"), "size").filter("cell is not null")
               .groupBy("cell", "digit").agg(F.sum("size").alias("bytes")).collect())
        counts: dict[tuple, dict[int, int]] = {}
        for r in got:
            counts.setdefault(cells[r["cell"]], {})[r["digit"]] = r["bytes"]
        still = {}
        for j, (at, below) in open_.items():
            goal, run, holds = j * total / shards, below, None
            for d, n in sorted(counts.get(at, {}).items()):
                for edge, have in ((d, run), (d + 1, run + n)):
                    miss = abs(have - goal)
                    if j not in best or miss < best[j][0]:
                        best[j] = (miss, _bound((*at, edge)))
                if run <= goal < run + n:
                    holds = ((*at, d), run)
                run += n
            if best[j][0] > allowed and holds:
                still[j] = holds
        open_ = still
        if not open_:
            break
    return [best[j][1] for j in range(1, shards)]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    n = F.lit(0)
    for k1, k2 in cuts:
        n = n + ((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int")
    return n


def histogram_shards(docs: DataFrame, size: Column, shards: int = 8, carry: list[Column] | None = None,
                     tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per input row: ``__row`` (``carry`` columns, all by default),
    ``size``, ``shard`` (0 to shards - 1, near equal bytes), ``slot`` (gapless
    from 0 within the shard).

    Null texts group with each other, apart from the empty text; repeated rows
    keep their own slots; an empty table gives no row; a row larger than a
    shard makes neighbours smaller or empty.
    """
    kept = F.struct(*(carry or [F.col(f"`{c}`") for c in docs.columns]))
    rows = stored_rows(docs.select(kept.alias(ROW), size.cast("long").alias("size"), F.col("doc_id").alias("__id"),
                                   F.shiftrightunsigned(F.xxhash64("text"), 4).alias("k1")), "shard-rows")
    rows = rows.select(ROW, RID, "size", "k1", F.shiftrightunsigned(F.xxhash64("__id", RID), 4).alias("k2"))
    keys = rows.select("k1", "k2", "size")
    marked = rows.withColumn("shard", shard_of(splitters(keys, shards, tolerance)))

    bits = max(0, math.ceil(math.log2(max(1, keys.count()) / piece_rows)))
    prefix = F.shiftrightunsigned("k1", 60 - bits) if bits else F.lit(0).cast("long")
    hot = (keys.select(prefix.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 4 * piece_rows)
           .select("p", F.ceil(F.log2(F.col("n") / piece_rows)).cast("int").alias("bits")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    marked = marked.withColumn("p", prefix).join(hot, "p", "left").withColumn(
        "q", F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(
            F.expr("shiftrightunsigned(k2, 60 - bits)"))).drop("bits")
    piece = ["shard", "p", "q"]
    offsets = (marked.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("p", "q")) - F.col("n")).drop("n"))
    within = F.row_number().over(Window.partitionBy(*piece).orderBy("k1", "k2", RID)) - 1
    return (marked.join(offsets, piece).withColumn("slot", (F.col("offset") + within).cast("long"))
            .select(ROW, "size", "shard", "slot"))
