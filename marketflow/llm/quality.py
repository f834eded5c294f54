"""Quality rules: base text statistics and a hashed n-gram likelihood ratio.

Every n-gram (n = 1, 2) of a text is hashed into one of ``buckets`` bins.  Two
multinomials over the bins are counted: one over all documents (the raw
corpus), one over trusted documents.  A document's score is the mean over its
n-grams of ``log p_trusted(bin) - log p_raw(bin)`` (both smoothed by the same
count a bin); length-normalised, so one fixed threshold decides every
document, with no randomness.

All steps are DataFrame expressions.  The counts aggregate map-side into at
most ``buckets`` rows a task, the weights reach the scoring scan as one
``buckets``-long array (a scalar subquery), and no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import ROW, let, packed, white_words

BUCKETS = 1 << 18
THRESHOLD = -0.15
SMOOTHING = 5.0
TRUSTED_ROWS = 20_000
SYMBOLS = "#*$%&|<>"


def word_hashes(text: Column) -> Column:
    return F.transform(white_words(text), lambda w: F.xxhash64(w))


def _pair_hashes(h: Column) -> Column:
    """Bigram hashes of an array of word hashes (empty below two words)."""
    return F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
                       lambda x, i: F.xxhash64(F.get(h, i), x))


def ngram_bins(text: Column, buckets: int = BUCKETS) -> Column:
    """Bins of all words and word pairs of a text, in order, repeats included."""
    return let(word_hashes(text), lambda h: F.transform(
        F.concat(h, _pair_hashes(h)), lambda x: F.pmod(x, F.lit(buckets)).cast("int")))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``bound`` doc_ids whose labels all say quality 1, by hash order.

    The bound is what makes the list safe to broadcast; a document without an
    id is never trusted."""
    one = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def bin_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                smoothing: float = SMOOTHING) -> DataFrame:
    """One row with array ``weights``: log p_trusted - log p_raw of each bin.

    With no trusted text at all every weight is 0 (nothing can be rejected).
    """
    marked = (docs.select("doc_id", "text")
              .join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left"))
    counts = (marked.select(F.explode(ngram_bins(F.col("text"), buckets)).alias("bin"),
                            F.coalesce("trusted", F.lit(0)).alias("trusted"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("good")))
    row = counts.agg(F.sort_array(F.collect_list(F.struct("bin", "raw", "good"))).alias("c"),
                     F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_all"),
                     F.coalesce(F.sum("good"), F.lit(0)).alias("good_all"))
    # raw counts are scaled to the trusted total first, so a rare bin weighs little on small corpora
    ratio = F.col("good_all") / F.col("raw_all")
    filled = F.map_from_entries(F.transform("c", lambda x: F.struct(x["bin"], F.when(
        F.col("good_all") > 0, F.log(x["good"] + smoothing) - F.log(x["raw"] * ratio + smoothing)).otherwise(0.0))))
    dense = (row.select(F.explode(filled).alias("bin", "weight"))
             .join(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin")), "bin", "right")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", F.coalesce("weight", F.lit(0.0)).alias("w")))),
                              lambda x: x["w"]).alias("weights")))
    return dense


def _mean_weight(h: Column, weights: Column, buckets: int) -> Column:
    """Mean bin weight over words and word pairs; 0 for no word.  ``weights``
    stands here once, so the optimizer puts the subquery in its place instead
    of copying the array into every row."""
    return let(F.concat(h, _pair_hashes(h)), lambda xs: F.when(F.size(xs) > 0, F.aggregate(
        xs, F.lit(0.0), lambda s, x: s + F.get(weights, F.pmod(x, F.lit(buckets)).cast("int"))) / F.size(xs)).otherwise(0.0))


def repeated_words(h: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are hashed to 64 bits; the high 32 bits with the position in the
    low 32 sort as plain longs.  Neighbours that share the high bits are
    candidates, and only those are sorted again by their full hash.  Equal
    full hashes are repeats; the covered words follow from the gaps between
    the sorted positions.
    """
    def windows(h):
        return F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))

    def neighbours(s, key):
        return F.filter(s, lambda x, i: (key(x) == key(F.get(s, i + 1))) | ((i > 0) & (key(x) == key(F.get(s, i - 1)))))

    def high(x):
        return F.shiftright(x, 32)

    def covered(p):
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(
            p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(x - s["last"], F.lit(3))).alias("n")),
            lambda s: s["n"]))

    def count(w):
        keyed = F.sort_array(F.transform(w, lambda x, i: F.shiftleft(high(x), 32).bitwiseOR(i.cast("long"))))
        near = let(keyed, lambda s: neighbours(s, high))
        pairs = F.sort_array(F.transform(near, lambda x: let(
            x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"),
            lambda i: F.struct(F.get(w, i).alias("h"), i.alias("i")))))
        same = let(pairs, lambda s: neighbours(s, lambda x: x["h"]))
        return covered(F.sort_array(F.transform(same, lambda x: x["i"])))

    # most texts repeat no window: a set tells so for less than the sorting
    return let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), count(w)).otherwise(F.lit(0))).cast("long")


def text_statistics(text: Column) -> dict[str, Column]:
    """The statistics that need no word array."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def score_quality(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``__row`` (all input columns) with statistics, ``llr``, ``base_failed``, ``kept``.

    ``docs`` needs ``doc_id`` and ``text``; null and empty texts have no word,
    score 0 and fail the base rule.  Equal texts get equal results, repeated
    rows stay repeated.
    """
    w = weights.select("weights").scalar()
    both = let(word_hashes(F.col("text")), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"),
        _mean_weight(h, F.col("__weights"), buckets).alias("llr")))
    stats = text_statistics(F.col("text"))
    got = packed(docs, F.col("text"), w.alias("__weights")).select(ROW, both.alias("__both"), *[c.alias(f"__{n}") for n, c in stats.items()])
    b = F.col("__both")
    failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
    return got.select(
        "__row", b["n_words"].alias("n_words"), *[F.col(f"__{n}").alias(n) for n in stats],
        b["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (b["llr"] >= F.lit(threshold))).alias("kept"), b["llr"].alias("llr"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """Count both multinomials, then score and decide every document."""
    return score_quality(docs, bin_weights(docs, trusted_ids(labels, trusted_rows), buckets), buckets, threshold)
