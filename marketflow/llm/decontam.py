"""Benchmark decontamination by winnowing.

Texts are cut into words; every word gets a 64-bit hash and every ``K``
consecutive words a k-gram hash.  Of each ``WINDOW - K + 1`` consecutive k-grams
the smallest hash (leftmost of equals) is kept as a fingerprint.  Two texts
that share ``WINDOW`` consecutive words choose the same k-gram inside them, so
joining document and benchmark fingerprints finds every such span.  A hit is
extended in both directions: each window of ``WINDOW`` words around the shared
k-gram is compared word by word.

Items of fewer than ``WINDOW`` words are one window of all their words (k-gram
length and window length are then both the item's length).

The document side first asks a bitmap of the benchmark's hashes (bounded
whatever the benchmark's size; a false positive costs a candidate, nothing is
lost), so only words around possible hits are ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, hash_bitmap, stored_rows
from marketflow.session import materialize, ship_package

WINDOW = 10
K = 5
BROADCAST_ROWS = 50_000        # benchmark fingerprints of some 300 bytes: 15 MB at most
SALTS = 16

#: Bytes of words stay (A-Z lower-cased), all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "array<struct<hash:bigint,length:int,pos:int,at:int,words:array<string>>>"


def ascii_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hash of each k consecutive word hashes."""
    g = np.full(max(len(h) - k + 1, 0), np.uint64(k), np.uint64)
    for j in range(k):
        g = (g ^ h[j:j + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the leftmost minimum of every w consecutive hashes, each once."""
    if len(g) < w:
        return np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)
    return np.unique(least)


def prints(words: list[bytes], length: int, window: int, k: int):
    """(hashes, positions, reach) of the fingerprints for windows of ``length`` words."""
    if length < window:
        g = kgrams(_hashes(words), length)
        return g, np.arange(len(g)), 0
    g = kgrams(_hashes(words), k)
    pos = winnow(g, window - k + 1)
    return g[pos], pos, window - k


def _rows(words, length, window, k, keep=None):
    """Fingerprints as dicts; the words around each, as far as a window can reach."""
    g, pos, reach = prints(words, length, window, k)
    if keep is not None:
        ok = keep(g)
        g, pos = g[ok], pos[ok]
    out = []
    for h, p in zip(g.view(np.int64).tolist(), pos.tolist()):
        low = max(p - reach, 0)
        out.append({"hash": h, "length": length, "pos": p, "at": p - low,
                    "words": [w.decode("utf-8", "replace") for w in words[low:p + length]]})
    return out


def benchmark_prints(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``item_id`` and the fingerprint columns, one row per fingerprint of a text."""
    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = ascii_words(t)
            out.append(_rows(words, min(len(words), window), window, k) if words else [])
        return pd.Series(out)
    return (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(run("text")).alias("p"))
            .select("item_id", "p.*"))


def find_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None,
               window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, found): every input row as ``__row`` (``carry`` columns, all by
    default) with ``__rid`` and ``n_words``; and per contaminated row its
    ``__rid``, ``n_hit`` (words inside any occurring window) and ``items``
    (sorted item ids as strings).

    Null and empty texts have no words and are never contaminated.  A null
    item_id contaminates but isn't listed; repeated items count once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = materialize(benchmark_prints(benchmark, window, k), "benchmark-prints", partitions=None)
    n = items.count()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())    # at most `window` values
    known = hash_bitmap(spark, items, "hash")

    @F.pandas_udf(f"struct<n_words:bigint,hits:{HITS}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        counts, hits = [], []
        for t in texts:
            words = ascii_words(t)
            counts.append(len(words))
            hits.append([r for n in lengths if n <= len(words) for r in _rows(words, n, window, k, known)])
        return pd.DataFrame({"n_words": counts, "hits": hits})

    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    rows = stored_rows(docs.select(kept.alias(ROW), run("text").alias("__f"))
                       .select(ROW, "__f.n_words", "__f.hits"), "decontam-rows")
    return rows.select(ROW, RID, "n_words"), _matched(rows, items, n, window)


def _matched(rows: DataFrame, items: DataFrame, n_items: int, window: int) -> DataFrame:
    hits = rows.select(RID, F.explode("hits").alias("h")).select(RID, "h.*")
    it = items.select("item_id", "hash", "length", F.col("at").alias("i_at"), F.col("words").alias("i_words"))
    if n_items <= BROADCAST_ROWS:
        both = hits.join(F.broadcast(it), ["hash", "length"])
    else:              # a passage may stand in a third of all documents: its rows spread over the salts
        it = it.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = hits.withColumn("salt", F.pmod(F.col(RID), F.lit(SALTS)).cast("int")).join(it, ["hash", "length", "salt"])

    def same(r: Column) -> Column:
        def cut(words, at):
            return F.slice(words, F.col(at) + r + 1, F.col("length"))
        return (cut("words", "at") == cut("i_words", "i_at")) & (F.size(cut("words", "at")) == F.col("length"))

    starts = F.transform(F.filter(F.sequence(-F.least("at", "i_at"), F.lit(0)), same), lambda r: F.col("pos") + r)
    found = both.select(RID, "item_id", "length", F.explode(starts).alias("start"))
    per_row = found.groupBy(RID).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["length"]).alias("end"),
        (s["n"] + F.greatest(x["start"] + x["length"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n")),
        lambda s: s["n"])
    return per_row.select(RID, covered.alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None,
                  window: int = WINDOW, k: int = K) -> DataFrame:
    """Every row: ``__row``, ``n_words``, ``n_hit``, ``items``, ``contaminated``."""
    rows, found = find_spans(docs, benchmark, carry, window, k)
    return rows.join(found, RID, "left").select(
        ROW, RID, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
