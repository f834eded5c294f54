"""Line dedup by a log-template tree.

Each line descends a tree of fixed depth: its token count, then its first
``DEPTH`` tokens (a token with a digit counts as variable).  A leaf collects
lines of one shape.  In a leaf reached from at least ``min_docs`` different
texts, a token is constant at its position if it stands there at least
``min_docs`` * 2**j times, else variable; a line with its variable tokens
replaced by ``<*>`` is its template of level j.  All levels are asked, so a
template is found whatever its own and its leaf's size: at some level its
constants stay and its variables go if no value of them stands in over half of
its lines (a commoner value may stay and makes a template of its own).
Templates that recur in at least ``min_docs`` lines of different texts and are
constant in at least ``CONSTANT`` of their tokens are boilerplate, and their
lines are dropped from every document.

The tree is a pair of aggregations, not a structure in memory: leaves are
counted over all lines (as hashes); only lines of frequent leaves are then
split into tokens.  A bitmap of the frequent leaves (bounded, false positives
only cost time) keeps all others from being shuffled a second time.  Copies of
a text count once, so a document isn't boilerplate for being copied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import RID, ROW, hash_bitmap, stored_rows
from marketflow.session import materialize, ship_package

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 20
CONSTANT = 0.5
VARIABLE = "<*>"
_DIGITS = frozenset("0123456789")


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    lead = [VARIABLE if not _DIGITS.isdisjoint(t) else t for t in tokens[:depth]]
    return xxhash.xxh64_intdigest(f"{len(tokens)}\x00" + "\x00".join(lead))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def frequent_leaves(docs: DataFrame, min_docs: int, depth: int, min_tokens: int) -> DataFrame:
    """``leaf`` hashes reached from at least ``min_docs`` different texts."""
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            split = (line.split() for line in (t or "").split("\n"))
            out.append([_signed(h) for h in {leaf_of(x, depth) for x in split if len(x) >= min_tokens}])
        return pd.Series(out)
    seen = docs.select(F.xxhash64("text").alias("text_key"), F.explode(run("text")).alias("leaf")).distinct()
    return seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_docs).select("leaf")


def recurring_lines(docs: DataFrame, carry: list[str] | None = None, min_docs: int = MIN_DOCS, depth: int = DEPTH,
                    min_tokens: int = MIN_TOKENS, constant: float = CONSTANT) -> DataFrame:
    """Every row with ``__row`` (``carry`` columns, all by default), ``n_lines``
    and ``dropped`` (sorted numbers, from 0, of its boilerplate lines).

    Null texts have no line, the empty text one; lines of fewer than
    ``min_tokens`` tokens always stay; repeated rows get the same result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    leaves = materialize(frequent_leaves(docs, min_docs, depth, min_tokens), "line-leaves", partitions=None)
    known = hash_bitmap(spark, leaves, "leaf")

    @F.pandas_udf("struct<n_lines:bigint,lines:array<struct<no:int,leaf:bigint,line:bigint,tokens:array<string>>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        counts, found = [], []
        for t in texts:
            lines = [] if t is None else t.split("\n")
            counts.append(len(lines))
            split = [(no, x) for no, x in enumerate(line.split() for line in lines) if len(x) >= min_tokens]
            hashes = np.fromiter((leaf_of(x, depth) for _, x in split), np.uint64, len(split))
            found.append([{"no": no, "leaf": _signed(int(h)), "line": _signed(xxhash.xxh64_intdigest("\x00".join(x))), "tokens": x}
                          for (no, x), h, ok in zip(split, hashes, known(hashes)) if ok])
        return pd.DataFrame({"n_lines": counts, "lines": found})

    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    rows = stored_rows(docs.select(kept.alias(ROW), F.xxhash64("text").alias("text_key"), run("text").alias("__l"))
                       .select(ROW, "text_key", "__l.n_lines", "__l.lines"), "line-rows")
    lines = rows.select(RID, "text_key", F.explode("lines").alias("l")).select(RID, "text_key", "l.*").join(leaves, "leaf", "left_semi")

    # one row per different line of a leaf; copies of a text and repeats within it count once
    texts = lines.select("leaf", "line", "text_key").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    shapes = materialize(lines.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")).join(texts, ["leaf", "line"]),
                         "line-shapes", partitions=None)
    tokens = shapes.select("leaf", "line", "n", F.posexplode("tokens").alias("pos", "token"))
    doubled = F.floor(F.log2(F.col("times") / min_docs)).cast("int")
    common = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("times")).filter(F.col("times") >= min_docs).select(
        "leaf", "pos", "token", doubled.alias("level"))
    fixed = tokens.join(common, ["leaf", "pos", "token"]).groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "level"))).alias("fixed"))
    # a line has a template for each level of its tokens; at the levels between it is the next one's
    levels = F.array_distinct(F.transform("fixed", lambda x: x["level"]))
    shaped = (shapes.select("leaf", "line", "n", F.size("tokens").alias("length")).join(fixed, ["leaf", "line"])
              .filter(F.size("fixed") >= constant * F.col("length"))
              .select("leaf", "line", "n", "length", "fixed", F.explode(levels).alias("least"))
              .select("leaf", "line", "n", "length", F.filter("fixed", lambda x: x["level"] >= F.col("least")).alias("fixed"))
              .filter(F.size("fixed") >= constant * F.col("length"))
              .select("leaf", "line", "n", F.transform("fixed", lambda x: F.struct(x["pos"], x["token"])).alias("fixed")))
    frequent = shaped.groupBy("leaf", "fixed").agg(F.sum("n").alias("times")).filter(F.col("times") >= min_docs).drop("times")
    bad = materialize(shaped.join(frequent, ["leaf", "fixed"]).select("leaf", "line").distinct(), "line-templates", partitions=None)
    dropped = lines.select(RID, "no", "leaf", "line").join(bad, ["leaf", "line"]).groupBy(RID).agg(
        F.sort_array(F.collect_list("no")).alias("dropped"))
    return rows.select(ROW, RID, "n_lines").join(dropped, RID, "left").withColumn(
        "dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def drop_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text`` (null stays null)."""
    got = recurring_lines(docs, **options)

    @F.pandas_udf("string")
    def keep(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(gone) else
                          "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set_) for t, gone in zip(texts, dropped)
                          for set_ in [set(gone)]], dtype=object)
    text = keep(F.col(ROW).getField("text"), "dropped")
    return got.select(*[(text if c == "text" else F.col(ROW).getField(c)).alias(c) for c in docs.columns])
