import math

from pyspark.sql import functions as F

from marketflow.constants import RISK_BRACKETS
from marketflow.operators import goals as G
from marketflow.operators import sessions as S


def _goals(spark, data):
    return spark.createDataFrame(data, "goal string, initial_investment double, monthly_contribution double, "
                                       "annual_return double, target_value double, time_horizon int")


def test_golden_future_values(spark):
    df = _goals(spark, [("buy a car", 6000.0, 100.0, 0.02, 10000.0, 3),
                        ("buy a car", 6000.0, 100.0, 0.02, 15000.0, 3),
                        ("retirement", 50000.0, 1000.0, 0.04, 0.0, 3),
                        ("buy a house", 800000.0, 1000.0, 0.05, 1000000.0, 0),
                        ("any", 100.0, 10.0, 0.0, 200.0, 1)])
    out = G.evaluate_goals(df).collect()
    assert out[0].achievable_text == "Achievable: True, Future Value: 10077.71" and out[0].outcome == "smart"
    assert out[1].outcome == "not_smart" and out[1].failed_criterion == "achievable"
    assert (out[2].is_measurable, out[2].outcome, out[2].failed_criterion) == (False, "not_smart", "measurable")
    assert (out[3].is_time, out[3].failed_criterion) == (False, "time")
    assert math.isclose(out[4].future_value, 220.0) and out[4].outcome == "smart"


def test_future_value_monotone(spark):
    from marketflow.functions.finance import future_value
    base = (1000.0, 50.0, 0.05, 3)
    df = spark.createDataFrame([base, (2000.0, 50.0, 0.05, 3), (1000.0, 80.0, 0.05, 3), (1000.0, 50.0, 0.07, 3),
                                (1000.0, 50.0, 0.05, 5)], "p double, c double, r double, t int")
    v = [r.fv for r in df.select(future_value("p", "c", "r", "t").alias("fv")).collect()]
    assert all(x >= v[0] for x in v[1:])


def test_bracket_edges_and_nan(spark):
    vals = [0.5, 1.0, 1.0001, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0, 50.01, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "risk_aversion double")
    out = G.with_risk_bracket(df).collect()
    got = [(r.bracket, r.annual_return) for r in out]
    assert got[:10] == [(1, 0.08), (1, 0.08), (2, 0.07), (2, 0.07), (3, 0.06), (4, 0.05), (5, 0.04), (6, 0.03),
                        (7, 0.02), (8, 0.01)]
    assert got[10:] == [(None, 0.05), (None, 0.05)]


def test_allocation_weights(spark):
    df = spark.createDataFrame([(i, float(r)) for i, r in enumerate([0, 3, 7, 12, 18, 25, 40, 60])] +
                               [(99, float("nan"))], "investor_id long, risk_aversion double")
    long = G.allocation_long(df)
    sums = {r.bracket: round(r.s, 9) for r in long.groupBy("bracket").agg(F.sum("weight").alias("s")).collect()}
    expect = {b: round(sum(w), 9) for b, _lo, _hi, _r, w in RISK_BRACKETS}
    assert sums == expect and sums[5] == 0.9 and sums[6] == 0.8 and sums[7] == 0.8
    assert long.filter("investor_id = 99").count() == 0
    resc = G.allocation_long(df, rescale=True).groupBy("investor_id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in resc)


def test_transcript_orders_turns(spark):
    t = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 0, "assistant", "a"), (1, 1, "user", "x"),
                               (2, 5, "assistant", "z")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.history for r in G.transcript(t).collect()}
    assert out[1] == G.HISTORY_PREFIX + "ab" and out[2] == G.HISTORY_PREFIX + "z"
    parts = sorted((r.conv_id, r.part, r.text) for r in G.transcript_parts(t, turns_per_part=1).collect())
    assert parts == [(1, 0, "a"), (1, 2, "b"), (2, 5, "z")]


def test_transcript_same_for_any_part_size(spark):
    rows = [(c, t, "assistant" if t % 3 else "user", f"<{c}.{t}>") for c in range(3) for t in range(25)]
    t = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    want = {c: G.HISTORY_PREFIX + "".join(f"<{c}.{k}>" for k in range(25) if k % 3) for c in range(3)}
    for size in (1, 4, 1000):
        out = {r.conv_id: (r.history, r.n_answers) for r in G.transcript(t, turns_per_part=size).collect()}
        assert out == {c: (h, 16) for c, h in want.items()}


def test_session_transitions(spark):
    ev = [(1, i, intent) for i, intent in enumerate(
        ["initialize", "goal_text", "goal_achievable", "goal_achievable", "preferences_confirmed", "reset",
         "preferences_confirmed"])]
    df = spark.createDataFrame(ev, "conv_id long, ts long, intent string")
    out = S.session_state(df, bucket_seconds=None).orderBy("ts").collect()
    assert [r.route for r in out] == ["initialize", "check_smart", "check_smart", "fallback",
                                      "preferences_confirmation", "reset_preferences", "preferences_confirmation"]
    assert [r.profiling_state for r in out] == [False, False, True, True, True, True, True]
    assert [r.preferences_state for r in out] == [False, False, False, False, True, False, True]
    assert all(r.introduction_state for r in out)
    fin = S.final_state(S.session_state(df, bucket_seconds=None)).collect()[0]
    assert (fin.introduction_state, fin.profiling_state, fin.preferences_state, fin.n_events) == (True, True, True, 7)


def test_needs_confirmation(spark):
    df = spark.createDataFrame([("Do you CONFIRM these preferences [x]",), ("no",), (None,)], "text string")
    assert [r.needs_confirmation for r in G.needs_confirmation(df).collect()] == [True, False, False]


def test_session_bucketed_equals_plain(spark):
    import random
    from datetime import datetime, timedelta
    rnd = random.Random(5)
    intents = ["initialize", "goal_text", "goal_achievable", "preferences_confirmed", "reset", None]
    base = datetime(2024, 1, 1)
    rows = [(c, base + timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), e, rnd.choice(intents))
            for c in range(8) for e in range(c * 1000, c * 1000 + rnd.randint(1, 150))]
    df = spark.createDataFrame(rows, "conv_id long, ts timestamp, event_id long, intent string")
    cols = ["conv_id", "event_id", "introduction_state", "profiling_state", "preferences_state", "route"]
    want = sorted(map(tuple, S.session_state(df, order=("ts", "event_id"), bucket_seconds=None)
                  .select(*cols).collect()))
    for b in (3600, 86400, 7 * 86400, "auto"):
        got = sorted(map(tuple, S.session_state(df, order=("ts", "event_id"), bucket_seconds=b, hot_rows=60,
                                                rows_per_bucket=20).select(*cols).collect()))
        assert got == want
