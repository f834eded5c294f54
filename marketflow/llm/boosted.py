"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` reduces a whole text to a fixed row of numbers (shares of
character classes, word lengths, repetition of words and lines).  MLlib's
boosted trees learn from them: every column is binned once, and each tree level
is grown from per-bin sums that the executors count.  The finished ensemble is
flattened into arrays of split columns, thresholds and children; scoring
walks all trees of a batch of documents together, one numpy step per level.

The trees learn from at most ``SAMPLE_ROWS`` labelled documents; every
document is scored over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import ROW
from marketflow.llm.toxicity import id_fold
from marketflow.session import materialize, ship_package

SAMPLE_ROWS = 20_000   # labelled documents to learn from, by hash order of their ids
TREES = 20
DEPTH = 4
BINS = 64
STEP = 0.3
FOLDS, TEST_FOLD = 3, 1
BLOCK = 1 << 20        # characters of a text worked at a time

# Byte classes of UTF-8 text; a character counts once, at its first byte.
CLASSES = ("upper", "lower", "digit", "blank", "newline", "symbol", "stop", "other", "beyond")
_SYMBOLS = b"#*$%&|<>"
NAMES = ("chars", "words", *(f"share_{c}" for c in CLASSES), "word_length", "long_words", "distinct_words", "top_word",
         "repeated_next", "lines", "distinct_lines", "line_words")


def _byte_classes() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            kind = "beyond" if b >= 0xC0 else None        # later bytes of a character don't count
        elif c.isalpha():
            kind = "upper" if c.isupper() else "lower"
        elif c.isdigit():
            kind = "digit"
        elif c in "\n\r":
            kind = "newline"
        elif c.isspace():
            kind = "blank"
        elif b in _SYMBOLS:
            kind = "symbol"
        else:
            kind = "stop" if c in ".,;:!?" else "other"
        if kind:
            out[b, CLASSES.index(kind)] = 1
    return out


BYTE_CLASSES = _byte_classes()


def blocks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut after white space
    where there is any in a part."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
        yield text[at:end]
        at = end


def statistics(text: str | None, block: int = BLOCK) -> list[float]:
    """The numbers ``NAMES`` of a whole text; all 0 for a null or empty one.

    Words and lines are counted block by block, so one very long text takes
    the memory of its distinct words and lines beside itself.
    """
    t = text or ""
    if not t:
        return [0.0] * len(NAMES)
    counts, words, lines = np.zeros(256, np.int64), Counter(), Counter()
    letters = repeats = 0
    last = None
    for part in blocks(t, block):
        counts += np.bincount(np.frombuffer(part.encode("utf-8"), np.uint8), minlength=256)
        w = part.split()
        words.update(w)
        letters += sum(map(len, w))
        repeats += sum(map(eq, w, w[1:])) + (bool(w) and w[0] == last)
        last = w[-1] if w else last
        lines.update(hash(x) for x in part.split("\n") if x and not x.isspace())
    shares = counts @ BYTE_CLASSES / len(t)
    n, n_lines = sum(words.values()), sum(lines.values())
    return [math.log1p(len(t)), math.log1p(n), *shares.tolist(), letters / n if n else 0.0,
            sum(c for w, c in words.items() if len(w) > 12) / n if n else 0.0, len(words) / n if n else 0.0,
            max(words.values(), default=0) / n if n else 0.0, repeats / n if n else 0.0,
            math.log1p(n_lines), len(lines) / n_lines if n_lines else 0.0, math.log1p(n / n_lines) if n_lines else 0.0]


def document_statistics(text: Column) -> Column:
    """``statistics`` as an array<double> column."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)
    return run(text)


@dataclass(frozen=True)
class Trees:
    """An ensemble as flat arrays; ``roots`` names each tree's first node.  A
    leaf is its own child, so every walk may take ``depth`` steps."""
    column: np.ndarray
    threshold: np.ndarray
    low: np.ndarray            # next node if value <= threshold
    high: np.ndarray
    value: np.ndarray          # tree weight times prediction, at leaves
    roots: np.ndarray
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for each row of a matrix."""
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[line, self.column[at]] <= self.threshold[at], self.low[at], self.high[at])
        return self.value[at].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-2.0 * np.clip(self.margin(rows), -30.0, 30.0)))


def constant(p: float) -> Trees:
    """An ensemble that gives every row the probability ``p``."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    zero = np.zeros(1, np.int64)
    return Trees(zero, np.full(1, np.inf), zero, zero, np.array([0.5 * math.log(p / (1 - p))]), zero, 0)


def flatten(model) -> Trees:
    """The arrays of a fitted ``GBTClassificationModel``."""
    columns, thresholds, low, high, values, roots, depth = [], [], [], [], [], [], 0

    def add(node, weight: float, level: int) -> int:
        nonlocal depth
        me, depth = len(columns), max(depth, level)
        columns.append(0), thresholds.append(math.inf), low.append(me), high.append(me)
        values.append(weight * node.prediction())
        if node.subtreeDepth() > 0:
            columns[me], thresholds[me] = node.split().featureIndex(), node.split().threshold()
            low[me] = add(node.leftChild(), weight, level + 1)
            high[me] = add(node.rightChild(), weight, level + 1)
        return me
    for tree, weight in zip(model.trees, model.treeWeights):
        roots.append(add(tree._call_java("rootNode"), float(weight), 0))
    return Trees(*(np.array(x) for x in (columns, thresholds, low, high, values, roots)), depth)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``(text, label)`` of at most ``bound`` labelled ids outside the test
    fold, by hash order.  Ids whose labels disagree, null ids and null labels
    teach nothing; copies of a text teach once a label."""
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(id_fold(F.col("doc_id"), FOLDS) != TEST_FOLD)
           .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most"))
           .filter("label = most").select("doc_id", F.col("label").cast("double").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")   # at most `bound` ids
            .groupBy(F.sha2("text", 256), "label").agg(F.first("text").alias("text")).select("text", "label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for ``label`` (0 or 1).  With labels of one kind only they are
    constant at it, without any label at one half."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, label, bound).select("label", document_statistics(F.col("text")).alias("x"))
    # one sorted file of at most `bound` short rows: the trees don't depend on how the texts were dealt out
    rows = materialize(rows.repartition(1).sortWithinPartitions("label", "x"), "quality-sample", partitions=None)
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return constant(0.5 if low is None else low)
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=BINS, stepSize=STEP,
                            minInstancesPerNode=5, seed=1, subsamplingRate=1.0, featureSubsetStrategy="all")
    return flatten(learner.fit(rows.select("label", array_to_vector("x").alias("features"))))


def score(text: Column, trees: Trees) -> Column:
    """Probability of label 1 of whole texts; batch by batch, all trees at once."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        rows = np.array([statistics(t) for t in texts])
        return pd.Series(np.concatenate([trees.probability(rows[i:i + 4096]) for i in range(0, len(rows), 4096)]))
    return run(text)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, label: str = "quality", bound: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with ``__row`` (its ``carry``
    columns, all by default), ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts score as a text without characters; equal texts score
    equally; repeated rows stay; an empty table gives no rows, empty labels give
    0.5 everywhere.  Only the text is read for a score.
    """
    trees = fit(docs, labels, label, bound)
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    got = docs.select(kept.alias(ROW), score(F.col("text"), trees).alias("score"))
    return got.select(ROW, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
