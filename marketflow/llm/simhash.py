"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit set where over half of its word shingles' 64-bit
hashes have it.  Two texts link when their fingerprints differ in at most
``max_distance`` bits; components of links are the duplicate groups.

Candidates: the 64 bits are cut into ``m = max_distance + 1`` consecutive
segments on a ring.  If two fingerprints differ in at most t bits, then some
segment starts a chain whose every prefix of l segments differs in at most
``l * t / m`` bits (the pigeonring principle): none in the first segment, at
most one in the first two, and so on.  "None, then at most one" means that the
first segment and one half of the second are equal, so these bits are the join
key: 2 m keys of about 32 bits each.  Candidates of a bucket are first held
against the chain budgets, then against the full distance.

A bucket with more than ``BUCKET`` different fingerprints (a huge group of near
copies) isn't paired up.  Its members emit their 65 neighbours at distance 0
or 1; two fingerprints are within 2 bits exactly if they share such a
neighbour, at most 65 can, and each links to the smallest: as many links as
members, and none lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, stored_rows, unpacked, without_rids
from marketflow.llm.components import connected_components
from marketflow.session import materialize, ship_package

SHINGLE = 3
DISTANCE = 2
SEED = 42
BUCKET = 64
ALL = (1 << 64) - 1
PART = 1 << 16        # shingles counted at once


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as a signed 64-bit number; 0 for no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: lower and split know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), PART):
        piece = parts[at:at + PART]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in piece), "<u8", len(piece))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return run(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(m: int) -> list[int]:
    """Masks of m consecutive segments of near equal width."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(ALL >> (64 - cuts[i + 1])) & (ALL << cuts[i] & ALL) for i in range(m)]


def halves(mask: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    low = sum(1 << b for b in bits[:len(bits) // 2])
    return [low, mask ^ low]


def chain_keys(fp: Column, distance: int = DISTANCE) -> Column:
    """Array of (kind, key): a segment and one half of the next, for each start and half."""
    seg = segments(distance + 1)
    keys = []
    for i, mask in enumerate(seg):
        for h, half in enumerate(halves(seg[(i + 1) % len(seg)])):
            keys.append(F.struct(F.lit(2 * i + h).alias("kind"),
                                 fp.bitwiseAND(F.lit(_signed(mask | half))).alias("key")))
    return F.array(*keys)


def chain_holds(diff: Column, kind: Column, distance: int = DISTANCE) -> Column:
    """The chain that starts at the key's segment stays within its budgets."""
    seg = segments(distance + 1)
    m, held = len(seg), F.lit(False)
    for i in range(m):
        mask, ok = 0, F.floor(kind / 2) == i
        for n in range(1, m + 1):
            mask |= seg[(i + n - 1) % m]
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= n * distance // m)
        held = held | ok
    return held


def links(reps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``reps(fp)``, each once -> edges ``(u, v)`` that connect exactly the fingerprints
    reachable over pairs within ``distance`` (1 or 2) bits."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    keys = reps.select("fp", F.explode(chain_keys(F.col("fp"), distance)).alias("k")).select("fp", "k.kind", "k.key")
    sizes = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(keys.join(sizes, ["kind", "key"]), "simhash-buckets", partitions=None)
    small = (members.filter(F.col("n") <= bucket).groupBy("kind", "key")
             .agg(F.collect_list("fp").alias("fps"))              # at most `bucket` of them
             .select("kind", "fps", F.explode("fps").alias("u")))
    near = F.filter("fps", lambda x: (x < F.col("u")) & chain_holds(x.bitwiseXOR(F.col("u")), F.col("kind"), distance)
                    & (F.bit_count(x.bitwiseXOR(F.col("u"))) <= distance))
    pairs = small.select("u", F.explode(near).alias("v"))
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    balls = (members.filter(F.col("n") > bucket).select("fp").distinct()
             .select("fp", F.explode(around).alias("v")).groupBy("v")
             .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1))   # at most 65 share a neighbour
    if distance == 2:
        stars = balls.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    else:
        stars = balls.filter(F.array_contains("fps", F.col("v"))).select(F.explode("fps").alias("u"), "v")
    return pairs.union(stars.filter("u <> v"))


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per input row: ``__row`` (the ``carry`` columns, all by default),
    ``__rid``, ``fp``, ``component_id``, ``first`` (is the row the one that stays).

    Null and empty texts have fingerprint 0 and link like any other.
    ``component_id`` is the smallest doc_id of the component, null if it has
    none; the row that stays has the smallest doc_id (null last), then the
    smallest row number, so exactly one of repeated rows stays.
    """
    ship_package(docs.sparkSession)
    rows, of_fp = _grouped(docs, carry or docs.columns, shingle, distance)
    return rows.join(of_fp, "fp").select(ROW, RID, "fp", F.col("low.id").alias("component_id"),
                                         (F.col("low.rid") == F.col(RID)).alias("first"))


def _grouped(docs: DataFrame, carry: list[str], shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows with fingerprints, and each fingerprint's lowest row of its component."""
    kept = F.struct(*[F.col(f"`{c}`") for c in carry])
    rows = stored_rows(docs.select(kept.alias(ROW), F.col("doc_id").alias("__id"),
                                   fingerprint(F.col("text"), shingle).alias("fp")), "simhash-rows")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col(RID).alias("rid"))
    reps = materialize(rows.groupBy("fp").agg(F.min(order).alias("low")), "simhash-reps", partitions=None)
    roots = connected_components(links(reps.select("fp"), distance), "simhash-components")
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("low"))
    return rows, rooted.select("fp", "root").join(lows, "root").select("fp", "low")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component.  Components are found on narrow
    rows; whole rows only meet the list of dropped row numbers."""
    ship_package(docs.sparkSession)
    rows, of_fp = _grouped(docs, docs.columns, shingle, distance)
    dropped = rows.select(RID, "fp").join(of_fp, "fp").filter(F.col("low.rid") != F.col(RID))
    return unpacked(without_rids(rows.select(ROW, RID), dropped, "simhash-dropped"))
