"""Successive halving and early stopping with patience."""

import random

import pytest
from pyspark.ml import PipelineModel

from marketflow.constants import FEATURE_COLUMNS, SEARCH_RANGES
from marketflow.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(0)
    out = []
    for _ in range(240):
        x = [round(r.random(), 3) for _ in FEATURE_COLUMNS]
        out.append((*x, 10 * x[0] + 5 * (x[1] > 0.5) + r.gauss(0, 2)))
    out.append((None, *out[0][1:]))
    return spark.createDataFrame(out, ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", label double").repartition(2).cache()


def test_halving_measures_all_trials_and_drops_losers_early(rows):
    got = M.halving(rows, "boosted_a", n_trials=6, folds=2, first_trees=1, eta=3, seed=3)
    by = {r: [o for o in got if o["rung"] == r] for r in (0, 1)}
    assert [len(by[r]) for r in (0, 1)] == [6, 2] and all(o["n"] == 240 for o in got)
    assert {o["trees"] for o in by[0]} == {1} and {o["trees"] for o in by[1]} == {3}
    kept = sorted(by[0], key=lambda o: o["mse"])[:2]
    assert [o["params"] for o in by[1]] and all(o["params"] in [k["params"] for k in kept] for o in by[1])
    assert got[-1]["rung"] >= 1 and got[-1]["mse"] <= min(o["mse"] for o in by[1]) + 1e-9 or got[-1]["rung"] == 2
    for o in got:
        assert all(lo <= o["params"][k] <= hi for k, (lo, hi) in SEARCH_RANGES["boosted"].items())
    assert [(o["params"], o["mse"]) for o in M.halving(rows, "boosted_a", n_trials=2, folds=2, first_trees=1, eta=3, seed=3)][:1] == \
        [(o["params"], o["mse"]) for o in M.halving(rows, "boosted_a", n_trials=2, folds=2, first_trees=1, eta=3, seed=3)][:1]
    assert M.halving(rows.limit(0), "forest", n_trials=2) == []


def test_guided_draws_stay_near_the_better_half():
    good, bad = {"n_estimators": 60, "max_depth": 4, "learning_rate": 0.02}, {"n_estimators": 300, "max_depth": 10, "learning_rate": 0.3}
    rng = random.Random(1)
    for _ in range(50):
        p = M._guided("boosted_a", [(1.0, good), (9.0, bad)], rng)
        assert 50 <= p["n_estimators"] <= 60 + 63 and 3 <= p["max_depth"] <= 6 and p["learning_rate"] < 0.1
        assert isinstance(p["max_depth"], int)
    assert M._guided("forest", [(1.0, {"n_estimators": 99, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1})], rng)["n_estimators"] >= 50


def test_best_round_waits_for_its_patience():
    assert M.best_round([5, 4, 3, 4, 4, 2], 2) == 3
    assert M.best_round([5, 4, 3, 4, 4, 2], 3) == 6
    assert M.best_round([1.0], 10) == 1 and M.best_round([1, 2, 3], 1) == 1


def test_boosting_keeps_the_rounds_up_to_the_best(spark, rows, scratch):
    model, rounds, errors = M.train_with_patience(rows, params={"n_estimators": 30, "max_depth": 5, "learning_rate": 0.5}, patience=4)
    assert rounds == M.best_round(errors, 4) < 30 == len(errors)
    assert model.stages[-1].getNumTrees == rounds
    model.write().overwrite().save(f"{scratch}/m")
    back = PipelineModel.load(f"{scratch}/m")
    ready = rows.dropna()
    assert [r.prediction for r in M.predict(back, ready).collect()] == [r.prediction for r in M.predict(model, ready).collect()]
    plain = M.train(rows.withColumn("_v", rows.label.isNull()), "boosted_a", params={"n_estimators": 2, "max_depth": 3})
    assert M.cut_rounds(plain.stages[-1], 1).getNumTrees == 1
    with pytest.raises(ValueError):
        M.train_with_patience(rows, "forest")


def test_two_writers_get_two_versions(spark, scratch, monkeypatch):
    from marketflow.operators import features as E
    path = f"{scratch}/reg"
    assert [E.log_run(spark, path, "m", {}, 1.0, f"u{i}").first().version for i in (1, 2)] == [1, 2]
    monkeypatch.setattr(E, "_newest_version", lambda *a: 1)         # a writer that has not seen version 2
    assert E.log_run(spark, path, "m", {}, 1.0, "u3").first().version == 3
    monkeypatch.undo()
    assert E.log_run(spark, path, "n/..", {"a": 1}, 4.0, "v").first().version == 1
    got = {r.model_name: (r.latest_version, r.model_uri) for r in E.latest_version(E.read_registry(spark, path)).collect()}
    assert got == {"m": (3, "u3"), "n/..": (1, "v")}


def test_models_load_back_by_name_and_a_new_one_takes_over_mid_stream(spark, rows, scratch):
    import os

    from marketflow.operators import features as E
    from marketflow.plans.jobs import train_and_register
    reg, store, src, sink, ck = (os.path.join(scratch, d) for d in ("reg", "store", "src", "sink", "ck"))
    small = {"forest": {"n_estimators": 2, "max_depth": 3}, "boosted_a": {"n_estimators": 2, "max_depth": 2}, "boosted_b": {"n_estimators": 2, "max_depth": 2}}
    scaler = E.fit_scaler(rows)
    data = E.scale(rows, scaler)
    got = train_and_register(data, data, reg, store, params=small).collect()
    best = [r for r in got if r.best]
    assert len(got) == 3 and len(best) == 1 and best[0].mse == min(r.mse for r in got) and all(r.version == 1 for r in got)
    for kind in M.MODEL_KINDS:
        assert M.load_registered(spark, reg, f"risk_aversion_{kind}")[1] == 1
    model, version = M.load_registered(spark, reg, "risk_aversion_best")
    assert version == 1
    body = "{" + ", ".join(f'"{c}": 0.5' for c in FEATURE_COLUMNS) + "}"
    for i in range(2):
        spark.createDataFrame([(i, body), (i + 10, "{}")], "id long, payload string").coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
        stream = spark.readStream.schema("id long, payload string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
        M.score_stream(stream, reg, "risk_aversion_best", scaler, sink, ck, keep=("id",), available_now=True).awaitTermination()
        other = M.load_registered(spark, reg, "risk_aversion_forest" if best[0].model != "forest" else "risk_aversion_boosted_a")[0]
        other.write().overwrite().save(f"{store}/next")
        E.log_run(spark, reg, "risk_aversion_best", {}, 1.0, f"{store}/next", "Production")
    out = {r.id: r for r in spark.read.parquet(sink).collect()}
    assert {i: r.model_version for i, r in out.items()} == {0: 1, 1: 2} and out[0].risk_aversion_estimate != out[1].risk_aversion_estimate
    assert sorted(r.id for r in spark.read.parquet(sink + "-rejected").collect()) == [10, 11]
    with pytest.raises(LookupError):
        M.load_registered(spark, reg, "nobody")
