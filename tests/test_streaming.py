import json
import os

import pytest
from pyspark.sql import functions as F

from marketflow.operators import sessions as S
from marketflow.sources.envelope import decode_envelope
from marketflow.streaming.bronze import bronze_stream, keep_new_state_stream, keep_new_stream, state_store
from marketflow.streaming.sessions import (apply_events, apply_intent, session_state_batches,
                                           session_state_stream)


def _write_lines(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _envelopes(start, n):
    out = []
    for i in range(start, start + n):
        if i % 7 == 0:
            out.append(f"garbage {i}")
        else:
            out.append(json.dumps({"type": ["bonds", "usa", "commodity"][i % 3], "data": json.dumps([{"i": i}])}))
    return out


def test_bronze_stream_equals_batch_and_restarts(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, d) for d in ("src", "bronze", "ckpt"))
    os.makedirs(src)
    for k in range(4):
        _write_lines(os.path.join(src, f"part-{k}.txt"), _envelopes(k * 50, 50))
    q = bronze_stream(spark, sink, ckpt, source_fmt="text", source_path=src,
                      source_options={"maxFilesPerTrigger": "1"}, available_now=True)
    q.awaitTermination()
    got = spark.read.json(sink)
    batch = decode_envelope(spark.read.text(src))
    assert got.count() == 200
    cols = ["message_type", "data"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == \
        sorted(map(tuple, batch.select(*cols).collect()), key=str)
    # restart from the checkpoint with one new file: no row twice
    _write_lines(os.path.join(src, "part-9.txt"), _envelopes(1000, 25))
    q = bronze_stream(spark, sink, ckpt, source_fmt="text", source_path=src, available_now=True)
    q.awaitTermination()
    assert spark.read.json(sink).count() == 225


def test_keep_new_stream_exact(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, d) for d in ("src", "sink", "ckpt"))
    os.makedirs(src)
    snap1 = [(i, f"v{i}") for i in range(20)]
    snap2 = [(i, f"v{i}" if i != 3 else "changed") for i in range(25)]     # re-sent snapshot
    spark.createDataFrame(snap1, "k long, v string").coalesce(1).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame(snap2, "k long, v string").coalesce(1).write.parquet(os.path.join(src, "b2"))
    stream = (spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    keep_new_stream(stream, sink, ckpt, keys=["k"], available_now=True).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 26                     # 20 + 5 new keys + 1 changed record
    assert out.filter("k = 3").count() == 2


def test_keep_new_stream_in_buckets_gives_the_same_rows(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, d) for d in ("src", "sink", "ckpt"))
    schema = "k long, part string, v string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, name))

    def run(buckets):
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
        keep_new_stream(stream, sink, ckpt, keys=["k", "part"], available_now=True, buckets=buckets).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(sink).select("k", "part", "v").collect()))

    first = [(i, "ab"[i % 2], f"v{i}") for i in range(40)]
    put("b1", first * 2)
    assert run(16) == sorted(first)
    folders = {d for d in os.listdir(sink) if d.startswith("_bucket=")}
    assert 8 < len(folders) <= 16
    put("b2", [(3, "b", "v3"), (3, "b", "changed"), (3, "a", "v3"), (99, "a", "v99")])     # resent, changed, new, new
    assert run(16) == sorted([*first, (3, "b", "changed"), (3, "a", "v3"), (99, "a", "v99")])
    stored = spark.read.parquet(sink).filter("_batch_id = 1")
    assert 1 <= stored.select("_bucket").distinct().count() <= 3
    put("b3", [(5, "b", "v5")])
    with pytest.raises(Exception, match="written with buckets"):
        run(None)


def test_keep_new_state_exact_and_restarts(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, d) for d in ("src-st", "sink-st", "ckpt-st"))
    schema = "k long, v string"
    snap1 = [(i, f"v{i}") for i in range(20)] * 2                      # duplicates inside one batch
    snap2 = [(i, f"v{i}" if i != 3 else "changed") for i in range(25)]     # re-sent snapshot
    spark.createDataFrame(snap1, schema).coalesce(1).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame(snap2, schema).coalesce(1).write.parquet(os.path.join(src, "b2"))

    def run():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
        keep_new_state_stream(stream, sink, ckpt, keys=["k"], available_now=True).awaitTermination()

    run()
    out = spark.read.parquet(sink)
    assert out.count() == 26                     # 20 + 5 new keys + 1 changed record
    assert out.filter("k = 3").count() == 2
    # restart from the checkpoint: the same snapshot again plus one new key
    spark.createDataFrame(snap2 + [(99, "new")], schema).coalesce(1).write.parquet(os.path.join(src, "b3"))
    run()
    assert spark.read.parquet(sink).count() == 27


def _to_memory(spark, out, name, checkpoint):
    with state_store(spark):          # typed state variables need RocksDB
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return progress


def test_session_stream_equals_batch(spark, scratch):
    src = os.path.join(scratch, "events")
    intents = ["initialize", "goal_text", "goal_achievable", "goal_achievable", "preferences_confirmed",
               "reset", "goal_text", "preferences_confirmed"]
    rows = [(c, t * 10 + c, t * 100 + c, intents[(t + c) % len(intents)]) for c in range(6) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string")
    for k in range(3):   # three files in time order -> three micro-batches
        df.filter((F.col("ts") >= k * 40) & (F.col("ts") < (k + 1) * 40)).coalesce(1).write \
          .parquet(os.path.join(src, f"f{k}"))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    _to_memory(spark, session_state_stream(stream), "sess_out", os.path.join(scratch, "ck"))
    cols = ["conv_id", "event_id", "introduction_state", "profiling_state", "preferences_state", "route"]
    got = sorted(map(tuple, spark.sql("SELECT * FROM sess_out").select(*cols).collect()))
    want = sorted(map(tuple, S.session_state(df, order=("ts", "event_id")).select(*cols).collect()))
    assert got == want


def test_session_batches_equals_batch_with_hot_keys_and_restart(spark, scratch):
    src, sink, state, ck = (os.path.join(scratch, d) for d in ("sb-src", "sb-out", "sb-state", "sb-ck"))
    intents = ["goal_text", "initialize", "preferences_confirmed", "goal_achievable", "reset", "goal_text",
               "preferences_confirmed", "goal_achievable", "reset"]
    rows = [(c, t, t * 10 + c, intents[(t * (c + 2)) % len(intents)]) for c in range(4) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string") \
              .withColumn("ts", F.timestamp_seconds("ts"))

    def run():
        stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
        session_state_batches(stream, sink, state, ck, available_now=True, hot_rows=5,
                              rows_per_bucket=3).awaitTermination()

    cuts = [0, 7, 19, 30]
    for k in range(3):   # three time slices -> three micro-batches
        df.filter((F.col("event_id") >= cuts[k] * 10) & (F.col("event_id") < cuts[k + 1] * 10)) \
          .coalesce(1).write.parquet(os.path.join(src, f"f{k}"))
    run()
    df.filter(F.col("event_id") >= 300).coalesce(1).write.parquet(os.path.join(src, "f3"))
    run()                # restart from the checkpoint with the last slice
    cols = ["conv_id", "event_id", "introduction_state", "profiling_state", "preferences_state", "route"]
    got = sorted(map(tuple, spark.read.parquet(sink).select(*cols).collect()))
    want = sorted(map(tuple, S.session_state(df, order=("ts", "event_id"), bucket_seconds=None)
                                  .select(*cols).collect()))
    assert len(got) == 160
    assert got == want
    assert spark.read.parquet(os.path.join(state, "changes", "_batch_id=3")).count() == 4


def _session_run(spark, src, sink, state, ck, **options):
    stream = (spark.readStream.schema("conv_id long, ts long, event_id long, intent string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    session_state_batches(stream, sink, state, ck, available_now=True, **options).awaitTermination()


def _slice(spark, src, name, rows):
    spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string").coalesce(1).write.parquet(os.path.join(src, name))


def test_session_batches_survive_an_empty_batch_and_compact(spark, scratch):
    src, sink, state, ck = (os.path.join(scratch, d) for d in ("e-src", "e-out", "e-state", "e-ck"))
    intents = [S.INITIALIZE, S.GOAL_ACHIEVABLE, S.GOAL_TEXT, S.PREFERENCES, "smalltalk"]
    rows = [(c, t, t * 10 + c, intents[(t + c) % 5]) for t in range(12) for c in range(3)]
    _slice(spark, src, "f0", [])
    _session_run(spark, src, sink, state, ck, compact_every=2)
    for k in range(4):
        _slice(spark, src, f"f{k + 1}", rows[k * 9:(k + 1) * 9])
        _session_run(spark, src, sink, state, ck, compact_every=2)
        _slice(spark, src, f"g{k}", [])
        _session_run(spark, src, sink, state, ck, compact_every=2)
    cols = ["conv_id", "event_id", "introduction_state", "profiling_state", "preferences_state", "route"]
    df = spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string")
    got = sorted((tuple(r) for r in spark.read.parquet(sink).select(*cols).collect()), key=str)
    assert got == sorted((tuple(r) for r in S.session_state(df, order=("ts", "event_id")).select(*cols).collect()), key=str)


def test_session_batches_fail_on_a_lost_snapshot(spark, scratch):
    import pytest
    src, sink, state, ck = (os.path.join(scratch, d) for d in ("l-src", "l-out", "l-state", "l-ck"))
    _slice(spark, src, "f0", [(1, 1, 1, S.INITIALIZE)])
    _session_run(spark, src, sink, state, ck)
    os.rename(os.path.join(state, "done", "0"), os.path.join(scratch, "lost"))
    _slice(spark, src, "f1", [(1, 2, 2, S.GOAL_TEXT)])
    with pytest.raises(Exception, match="reset conversations"):
        _session_run(spark, src, sink, state, ck)


def test_late_events_change_nothing_and_are_kept_apart(spark, scratch):
    src, sink, state, ck = (os.path.join(scratch, d) for d in ("a-src", "a-out", "a-state", "a-ck"))
    _slice(spark, src, "f0", [(1, 5, 50, S.GOAL_ACHIEVABLE), (2, 5, 51, S.GOAL_TEXT)])
    _session_run(spark, src, sink, state, ck)
    _slice(spark, src, "f1", [(1, 3, 30, S.PREFERENCES), (1, 6, 60, S.GOAL_TEXT), (2, 6, 61, S.INITIALIZE)])
    _session_run(spark, src, sink, state, ck)
    got = {r.event_id: r for r in spark.read.parquet(sink).collect()}
    assert set(got) == {50, 51, 60, 61} and got[60].route == S.ROUTE_FALLBACK and not got[60].preferences_state
    assert [r.event_id for r in spark.read.parquet(sink + "-late").collect()] == [30]

    stream = (spark.readStream.schema("conv_id long, ts long, event_id long, intent string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    _to_memory(spark, session_state_stream(stream), "late_out", os.path.join(scratch, "ck2"))
    rows = {r.event_id: r for r in spark.sql("SELECT * FROM late_out").collect()}
    if rows[30].late:       # files of equal age may come in either order
        assert rows[30].route is None and not rows[60].preferences_state
    assert not rows[60].late and not rows[61].late


def test_keep_new_stream_refuses_a_foreign_sink(spark, scratch):
    import pytest
    src, sink, ck = (os.path.join(scratch, d) for d in ("r-src", "r-sink", "r-ck"))
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    df.write.parquet(sink)
    df.write.parquet(src)
    stream = spark.readStream.schema("k long, v string").parquet(src)
    with pytest.raises(Exception, match="_content_hash"):
        keep_new_stream(stream, sink, ck, keys=["k"], available_now=True).awaitTermination()


def test_apply_intent_table():
    s = (False, False, False)
    s, r = apply_intent(s, S.INITIALIZE)
    assert s == (True, False, False) and r == S.ROUTE_INITIALIZE
    s, r = apply_intent(s, S.GOAL_ACHIEVABLE)
    assert s == (True, True, False) and r == S.ROUTE_CHECK_SMART
    s, r = apply_intent(s, S.GOAL_TEXT)
    assert r == S.ROUTE_FALLBACK


def test_apply_events_equals_step_by_step():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    names = [S.INITIALIZE, S.GOAL_ACHIEVABLE, S.GOAL_TEXT, S.PREFERENCES, S.RESET, "other"]

    @settings(max_examples=200, deadline=None)
    @given(st.tuples(st.booleans(), st.booleans(), st.booleans()), st.lists(st.sampled_from(names), max_size=30))
    def check(start, intents):
        s, routes, states = start, [], []
        for i in intents:
            s, r = apply_intent(s, i)
            routes.append(r)
            states.append(s)
        last, cols = apply_events(start, intents)
        assert last == s
        assert list(cols["route"]) == routes
        got = list(zip(*(map(bool, cols[c]) for c in ("introduction_state", "profiling_state",
                                                      "preferences_state"))))
        assert got == states

    check()


def test_session_stream_hot_key_chunks_out_of_order(spark, scratch):
    """A key with more events than an Arrow chunk holds, stored newest first:
    the chunks reach the state function out of time order."""
    src = os.path.join(scratch, "hot-events")
    intents = ["goal_text", "initialize", "preferences_confirmed", "goal_achievable", "reset", "goal_text",
               "preferences_confirmed", "goal_achievable"]
    rows = [(c, t, t * 10 + c, intents[(t * 3 + c) % len(intents)]) for c in range(2) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, ts long, event_id long, intent string")
    for k in range(2):
        df.filter((F.col("ts") >= k * 30) & (F.col("ts") < (k + 1) * 30)).orderBy(F.col("ts").desc()) \
          .coalesce(1).write.parquet(os.path.join(src, f"f{k}"))
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
        _to_memory(spark, session_state_stream(stream), "sess_hot", os.path.join(scratch, "ck-hot"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    cols = ["conv_id", "event_id", "introduction_state", "profiling_state", "preferences_state", "route"]
    got = sorted(map(tuple, spark.sql("SELECT * FROM sess_hot").select(*cols).collect()))
    want = sorted(map(tuple, S.session_state(df, order=("ts", "event_id")).select(*cols).collect()))
    assert len(got) == 120
    assert got == want


def test_score_payloads_stream_equals_batch(spark, scratch):
    from marketflow.constants import FEATURE_COLUMNS
    from marketflow.operators import features as E
    from marketflow.operators import models as M
    rows = [(i, *[float((i * (k + 3)) % 17) for k in range(8)], float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", *FEATURE_COLUMNS, "label"])
    sc = E.fit_scaler(df)
    model = M.train(E.scale(df, sc), "forest", params={"n_estimators": 5, "max_depth": 3})
    payload = F.to_json(F.struct(*[F.col(c) for c in FEATURE_COLUMNS]))
    pay = df.select("id", payload.alias("payload"))
    pay = pay.unionByName(spark.createDataFrame([(999, '{"age": 1}')], "id long, payload string"))
    batch, bad = M.score_payloads(pay, sc, model, keep=("id",))
    assert bad.count() == 1
    src = os.path.join(scratch, "pay")
    pay.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(pay.schema).parquet(src)
    scored, _ = M.score_payloads(stream, sc, model, keep=("id",))
    sink = os.path.join(scratch, "scored")
    q = (scored.select("id", "risk_aversion_estimate").writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    got = {r.id: r.risk_aversion_estimate for r in spark.read.parquet(sink).collect()}
    want = {r.id: r.risk_aversion_estimate for r in batch.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_keep_new_bounded_stream(spark, scratch):
    from marketflow.streaming.bronze import keep_new_bounded
    src = os.path.join(scratch, "kb")
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    snap = [(k, f"v{k}", t0 + timedelta(minutes=k)) for k in range(10)]
    spark.createDataFrame(snap, "k long, v string, ts timestamp").coalesce(1).write.parquet(src + "/a")
    spark.createDataFrame(snap + [(3, "changed", t0 + timedelta(minutes=30))],
                          "k long, v string, ts timestamp").coalesce(1).write.parquet(src + "/b")
    stream = (spark.readStream.schema("k long, v string, ts timestamp").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))
    out = keep_new_bounded(stream, ["k"], "ts", "1 day", content=["v"])
    sink = os.path.join(scratch, "kb_out")
    q = (out.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "kb_ck"))
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == 11     # the re-sent copies are dropped within the delay


def test_state_store_restores_session_setting(spark):
    from marketflow.streaming.bronze import ROCKSDB_PROVIDER
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    with state_store(spark):
        assert spark.conf.get(conf) == ROCKSDB_PROVIDER
    assert spark.conf.get(conf, None) == before
    with state_store(spark, None):
        assert spark.conf.get(conf, None) == before


def _events_in_files(spark, src, files, schema):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src))


@pytest.mark.parametrize("kind, values", [("string", ["a", None, "", "=", "ü b"]), ("long", [1, None, -5]), ("binary", [b"\xff", None, b""]),
                                          ("struct<a:int,b:string>", [(1, "x"), None, (None, None)])])
def test_session_stream_takes_any_key(spark, scratch, kind, values):
    schema = f"conv_id {kind}, ts long, event_id string, intent string"
    intents = ["goal_text", "goal_achievable", "goal_text", "preferences_confirmed", "reset", None, "hello"]
    rows = [(k, t // 2, None if t == 3 else f"e{t}", intents[(t + i) % 7]) for i, k in enumerate(values) for t in range(12)]
    src, ck, name = os.path.join(scratch, "k"), os.path.join(scratch, "ck"), "keys_" + kind[:4]
    for i, part in enumerate(([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3])):
        spark.createDataFrame(part, schema).write.parquet(os.path.join(src, f"f{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
        sink = os.path.join(scratch, "out")
        with state_store(spark):
            session_state_stream(stream).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(sink).awaitTermination()
    cols = ["conv_id", "event_id", "intent", "introduction_state", "profiling_state", "preferences_state", "route"]
    got = sorted((str(tuple(r)) for r in spark.read.parquet(sink).filter("NOT late").select(*cols).collect()))
    want = sorted((str(tuple(r)) for r in S.session_state(spark.createDataFrame(rows, schema), order=("ts", "event_id")).select(*cols).collect()))
    assert got == want


@pytest.mark.parametrize("piece, fan", [(1, 2), (3, 2), (5, 16)])
def test_a_long_burst_is_merged_from_bounded_pieces(spark, scratch, piece, fan):
    import random
    r = random.Random(piece)
    names = [S.INITIALIZE, S.GOAL_ACHIEVABLE, S.GOAL_TEXT, S.PREFERENCES, S.RESET, "other", None]
    rows = [(c, r.choice([None, *range(20)]), i, r.choice(names)) for c in (1, 2, None) for i in range(67)]
    r.shuffle(rows)
    schema = "conv_id long, ts long, event_id long, intent string"
    stream = _events_in_files(spark, os.path.join(scratch, "b"), [rows], schema)
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        _to_memory(spark, session_state_stream(stream, piece=piece, fan=fan), f"burst_{piece}", os.path.join(scratch, "ck"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    cols = ["conv_id", "event_id", "intent", "introduction_state", "profiling_state", "preferences_state", "route"]
    got = sorted(str(tuple(x)) for x in spark.sql(f"SELECT * FROM burst_{piece}").select(*cols).collect())
    want = sorted(str(tuple(x)) for x in S.session_state(spark.createDataFrame(rows, schema), order=("ts", "event_id")).select(*cols).collect())
    assert got == want


def test_merge_holds_one_piece_of_each_run():
    import numpy as np
    import pandas as pd
    from marketflow.streaming.sessions import SessionProcessor
    p, stored, held = SessionProcessor("long", 4, 3), {}, [0]

    class Runs:
        def updateValue(self, k, v):
            assert len(v[0]) <= 4
            stored[k] = v

        def getValue(self, k):
            return stored[k]

        def removeKey(self, k):
            del stored[k]
    p.runs = Runs()
    r = np.random.default_rng(0)
    frames = [pd.DataFrame({"at": r.integers(0, 9, 11), "known": r.integers(0, 2, 11), "eid": r.integers(0, 5, 11), "intent": "x"}) for _ in range(20)]
    got = list(p._in_order(iter(frames)))
    assert max(map(len, got)) <= 3 * 4 and not stored and held
    want = pd.concat(frames).sort_values(["at", "known", "eid"], ignore_index=True)
    assert pd.concat(got, ignore_index=True).equals(want)


def _at(day):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def test_silent_conversations_expire(spark, scratch):
    schema = "conv_id string, ts timestamp, event_id long, intent string"
    one = [("a", _at(0), 1, "goal_achievable"), ("b", _at(0), 2, "goal_achievable"), ("b", _at(0.5), 3, "goal_text")]
    two = [("c", _at(9), 4, "initialize")]                              # time passes: a and b are over
    three = [("b", _at(9), 5, "goal_text"), ("c", _at(9.5), 6, "goal_text"), ("c", _at(30), 7, "goal_text"), (None, _at(30), 8, "reset")]
    src, ck, sink = (os.path.join(scratch, d) for d in ("src", "ck", "sink"))
    left = []
    for i, rows in enumerate((one, two, three)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
        out = session_state_stream(stream.withWatermark("ts", "1 hour"), idle_seconds=3 * 86_400)
        with state_store(spark):
            q = out.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(sink)
        q.awaitTermination()
        held = spark.read.format("statestore").option("path", ck).option("stateVarName", "session").load()
        left.append({r["key"].key_text for r in held.collect()})
    cols = ["conv_id", "event_id", "profiling_state", "route"]
    got = sorted((tuple(r) for r in spark.read.parquet(sink).select(*cols).collect()), key=lambda r: r[1])
    df = spark.createDataFrame(one + two + three, schema)
    want = sorted((tuple(r) for r in S.session_state(df, order=("ts", "event_id"), idle_seconds=3 * 86_400).select(*cols).collect()), key=lambda r: r[1])
    assert got == want and dict((r[1], r[3]) for r in got)[5] == S.ROUTE_CHECK_SMART
    assert left[0] == {"=a", "=b"} and "=a" not in left[2], left           # a is over and left the state store
    split = S.session_state(df, order=("ts", "event_id"), idle_seconds=3 * 86_400, hot_rows=1, rows_per_bucket=1)
    assert sorted((tuple(r) for r in split.select(*cols).collect()), key=lambda r: r[1]) == want


def test_state_untouched_by_the_clock_expires(spark, scratch):
    import time
    schema = "conv_id string, ts long, event_id long, intent string"
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
    with state_store(spark):
        q = session_state_stream(stream, ttl_seconds=1).writeStream.format("memory").queryName("ttl_out").option("checkpointLocation", os.path.join(scratch, "ck")).start()
    try:
        for i in range(2):
            spark.createDataFrame([("a", i, i, "goal_achievable")], schema).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
            until = time.time() + 40
            while spark.table("ttl_out").count() <= i and time.time() < until and q.isActive:
                time.sleep(0.5)
            time.sleep(1.5)
    finally:
        q.stop()
    assert {r.event_id: r.route for r in spark.table("ttl_out").collect()} == {0: S.ROUTE_CHECK_SMART, 1: S.ROUTE_CHECK_SMART}
    with pytest.raises(ValueError):
        session_state_stream(stream, ttl_seconds=1, idle_seconds=1)


def test_session_batches_keep_the_null_and_text_conversations(spark, scratch):
    schema = "conv_id string, ts long, event_id long, intent string"
    src, sink, state, ck = (os.path.join(scratch, d) for d in ("src", "sink", "state", "ck"))
    rows = []
    for i, part in enumerate(([(None, 0, 0, "goal_achievable"), ("a", 0, 1, "goal_achievable")], [(None, 1, 2, "goal_text"), ("a", 1, 3, "goal_text"), ("b", 1, 4, "x")],
                              [(None, 0, 5, "goal_text"), (None, 2, 6, "hello")])):
        spark.createDataFrame(part, schema).write.parquet(os.path.join(src, f"f{i}"))
        rows += part
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
        session_state_batches(stream, sink, state, ck, available_now=True, compact_every=2).awaitTermination()
    got = {r.event_id: r.route for r in spark.read.parquet(sink).collect()}
    assert got == {0: "check_smart", 1: "check_smart", 2: "fallback", 3: "fallback", 4: "fallback", 6: None}
    assert [r.event_id for r in spark.read.parquet(sink + "-late").collect()] == [5]
