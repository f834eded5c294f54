"""Boosted trees: statistics by hand, the flat walk against MLlib, held-out labels."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marketflow.llm import boosted, queries
from marketflow.llm.queries import table

from .test_pipeline_operators import DOC, empty

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def corpus(n=400):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 90))]
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [w[0]] * len(w)
        out.append((i, " ".join(w) + ".", int(not bad)))
    return out


def frame(spark, texts, ids):
    return spark.createDataFrame([(i, t, None, None, None, "clash", "clash", "clash") for i, t in zip(ids, texts)], DOC)


def test_statistics_by_hand():
    got = dict(zip(boosted.NAMES, boosted.statistics("Aé 1 1\nfoo# foo.\n\nAé 1 1")))
    assert got["chars"] == math.log1p(24) and got["words"] == math.log1p(8)
    share = {"upper": 2, "lower": 6, "digit": 4, "blank": 5, "newline": 3, "symbol": 1, "stop": 1, "other": 0, "beyond": 2}
    for k, v in share.items():
        assert got[f"share_{k}"] == pytest.approx(v / 24)
    assert got["word_length"] == pytest.approx((2 + 1 + 1 + 4 + 4 + 2 + 1 + 1) / 8) and got["distinct_words"] == 4 / 8
    assert got["top_word"] == 4 / 8 and got["repeated_next"] == 2 / 8 and got["distinct_lines"] == 2 / 3
    assert boosted.statistics(None) == boosted.statistics("") == [0.0] * len(boosted.NAMES)
    assert all(math.isfinite(x) for t in (" \n\t", "\x00", "𝄞" * 9, "a" * 99) for x in boosted.statistics(t))


def test_blocks_do_not_change_the_counts():
    r = random.Random(1)
    t = " ".join("".join(r.choice("abé\n") for _ in range(r.randint(1, 4))) for _ in range(3_000))
    assert "".join(boosted.blocks(t, 50)) == t and max(map(len, boosted.blocks(t, 50))) <= 50
    whole, parts = (dict(zip(boosted.NAMES, boosted.statistics(t, b))) for b in (1 << 20, 50))
    lines = {"lines", "distinct_lines", "line_words"}                # a line may be cut
    assert all(whole[k] == pytest.approx(parts[k]) for k in boosted.NAMES if k not in lines)
    assert list(boosted.blocks("x" * 120, 50)) == ["x" * 50, "x" * 50, "x" * 20]
    assert len(boosted.statistics("word " * 2_000_000)) == len(boosted.NAMES)


def test_flat_walk_equals_the_fitted_model(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(df)
    flat = boosted.flatten(model)
    want = np.array([v.probability[1] for v in model.transform(df).select("probability").collect()])
    assert np.allclose(flat.probability(x), want) and len(flat.roots) == 5 and flat.depth == 3


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    df = frame(spark, [t for _, t, _ in rows] + [None, "", rows[0][1], rows[0][1], "x " * 100_000], [i for i, _, _ in rows] + [900, None, 0, None, 901])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1), (2, 0), (2, 1), (None, 1), (5, None)], "doc_id long, quality int")
    return rows, df, labels, boosted.fit(df, labels, trees=6)


def test_scores_of_held_out_and_odd_rows(spark, learned, monkeypatch):
    rows, df, labels, trees = learned
    monkeypatch.setattr(boosted, "fit", lambda *a, **k: trees)
    got = boosted.classify(df, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r["__row"].shard == "clash" for r in got)
    truth = {i: q for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = sum(truth[r["__row"].doc_id] != r.predicted for r in got if r["__row"].doc_id in truth)
    assert len(truth) > 100 and wrong <= 2
    same = {r.score for r in got if not r["__row"].text}
    assert len(same) == 1 and len({r.score for r in got if r["__row"].text == rows[0][1]}) == 1
    assert boosted.classify(empty(df), labels).count() == 0


def test_labels_of_one_kind_or_none(spark, learned):
    _, df, labels, _ = learned
    assert boosted.fit(df, empty(labels)).probability(np.zeros((2, len(boosted.NAMES)))).tolist() == [0.5, 0.5]
    ones = boosted.fit(df, labels.filter("quality = 1"))
    assert ones.probability(np.zeros((1, len(boosted.NAMES))))[0] > 0.99
    assert boosted.fit(empty(df), labels).depth == 0


def test_training_rows_leave_out_the_test_fold(spark, learned):
    rows, df, labels, _ = learned
    got = {r.text: r.label for r in boosted.training_rows(df, labels, "quality", 20_000).collect()}
    want = {t: q for i, t, q in rows if zlib.crc32(str(i).encode()) % 3 != 1 and i not in (2, 5)}
    want |= {t: q for i, t, q in rows if i == 5 and zlib.crc32(b"5") % 3 != 1}      # the null label beside it says nothing
    assert got == want
    assert boosted.training_rows(df, labels, "quality", 9).count() <= 9


@needs_data
def test_held_out_accuracy_on_the_given_tables(spark):
    got = queries.QUERIES["op11_quality_classifier"](spark, SF)
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    held = got.join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert got.count() == table(spark, SF, "documents").count() and len(held) > 50
    assert sum(r.quality == r.predicted for r in held) / len(held) >= 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
