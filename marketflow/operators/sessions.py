"""Per-conversation chat session state (F10), batch form.

The transition table is shared with the streaming form
(``marketflow.streaming.sessions``):

=====================  ==============  =========  ===========
intent                 introduction    profiling  preferences
=====================  ==============  =========  ===========
initialize             true            -          -
goal, achievable       -               true       -
goal, profiling true   - (fallback)    -          -
preferences confirmed  -               -          true
reset                  -               -          false
any other              -               -          -
=====================  ==============  =========  ===========

"-" keeps the value.  Every flag starts false.  Any other intent is answered
by the fallback route while profiling is false and by no route (NULL) after;
a NULL intent has no route.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.operators.series import DEFAULT_HOT_ROWS, DEFAULT_ROWS_PER_BUCKET, join_carry, plan_buckets

INITIALIZE = "initialize"
GOAL_ACHIEVABLE = "goal_achievable"
GOAL_TEXT = "goal_text"
PREFERENCES = "preferences_confirmed"
RESET = "reset"

# Route taken for each intent (goal intents depend on the profiling flag).
ROUTE_FALLBACK = "fallback"
ROUTE_CHECK_SMART = "check_smart"
ROUTE_PREFERENCES = "preferences_confirmation"
ROUTE_INITIALIZE = "initialize"
ROUTE_RESET = "reset_preferences"


DEFAULT_BUCKET_SECONDS = "auto"


def with_visits(events: DataFrame, key: str, order: Sequence[str], idle_seconds: float, bucket_seconds=DEFAULT_BUCKET_SECONDS,
                hot_rows: int = DEFAULT_HOT_ROWS, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """``events`` with ``_visit``: how many silences of more than
    ``idle_seconds`` (of the first ``order`` column) lie before the event.

    Hot conversations are cut into buckets: gaps and counts run within a bucket,
    a table of one row per bucket carries the time before it and the count on."""
    at = (F.unix_micros(F.col(order[0]).cast("timestamp"))).cast("long")
    idle = int(idle_seconds * 1_000_000)
    rows = plan_buckets(events, key, order, bucket_seconds, hot_rows, rows_per_bucket)
    cut = rows is not None
    rows = (rows if cut else events).withColumn("_at", at)
    w = Window.partitionBy(key, *(["_bucket"] if cut else [])).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce(F.col("_at") - F.lag("_at").over(w) > idle, F.lit(False)).cast("long")
    rows = rows.withColumn("_gap", gap).withColumn("_visit", F.sum("_gap").over(upto))
    if not cut:
        return rows.drop("_at", "_gap")
    wb = Window.partitionBy(key).orderBy("_bucket")
    carry = (rows.groupBy(key, "_bucket").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.max("_visit").alias("_n"))
             .withColumn("_jump", F.coalesce(F.col("_first") - F.lag("_last").over(wb) > idle, F.lit(False)).cast("long"))
             .withColumn("_c_visit", F.sum(F.col("_jump") + F.col("_n")).over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
             .select(key, "_bucket", "_c_visit"))
    return (join_carry(rows, carry, key).withColumn("_visit", F.col("_visit") + F.col("_c_visit"))
            .drop("_at", "_gap", "_bucket", "_c_visit"))


def session_state(events: DataFrame, key: str = "conv_id", order: Sequence[str] = ("ts",),
                  intent: str = "intent", bucket_seconds=DEFAULT_BUCKET_SECONDS,
                  hot_rows: int = DEFAULT_HOT_ROWS, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                  idle_seconds: float | None = None) -> DataFrame:
    """flags after every event of each conversation, and the route taken.

    With ``idle_seconds`` a conversation that was silent for longer (time of
    the first ``order`` column; events without a time come first and don't
    count as silence) starts anew.

    A flag set once stays set (running max); the preferences flag is the
    last explicit set/clear (``last(..., ignorenulls)``).

    ``bucket_seconds=None`` runs the running windows over the whole
    conversation (one exchange).  ``"auto"`` (default) splits only
    conversations with more than ``hot_rows`` events into time buckets (plain
    plan when there are none); an int uses fixed-width buckets.  In the
    bucketed form (first ``order`` column is the event time) the windows run
    per (conversation, time bucket), so a very long conversation is spread
    over many tasks; the state
    at the end of every bucket goes into a small per-bucket table, a window
    over the conversation carries it into the next buckets, and a join on
    (conversation, bucket) - the partitioning the big side already has -
    combines both.  Both forms give the same rows.
    """
    if idle_seconds is not None:
        rows = with_visits(events, key, order, idle_seconds, bucket_seconds, hot_rows, rows_per_bucket)
        rows = rows.withColumn("_visit_key", F.struct(F.col(key).alias("key"), F.col("_visit").alias("visit"))).drop("_visit")
        return session_state(rows, "_visit_key", order, intent, bucket_seconds, hot_rows, rows_per_bucket).drop("_visit_key")
    i = F.col(intent)
    pref_set = F.when(i == PREFERENCES, F.lit(True)).when(i == RESET, F.lit(False))
    goal = (i == GOAL_ACHIEVABLE) | (i == GOAL_TEXT)
    bucketed = plan_buckets(events, key, order, bucket_seconds, hot_rows, rows_per_bucket)
    if bucketed is None:
        w = Window.partitionBy(key).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        df = (events
              .withColumn("introduction_state", F.coalesce(F.max(i == INITIALIZE).over(upto), F.lit(False)))
              .withColumn("profiling_state", F.coalesce(F.max(i == GOAL_ACHIEVABLE).over(upto), F.lit(False)))
              .withColumn("preferences_state",
                          F.coalesce(F.last(pref_set, ignorenulls=True).over(upto), F.lit(False)))
              .withColumn("_prof_before", F.coalesce(F.max(i == GOAL_ACHIEVABLE).over(before), F.lit(False))))
    else:
        base = bucketed
        w1 = Window.partitionBy(key, "_bucket").orderBy(*order)
        upto = w1.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w1.rowsBetween(Window.unboundedPreceding, -1)
        rows = (base.withColumn("_intro", F.max(i == INITIALIZE).over(upto))
                    .withColumn("_prof", F.max(i == GOAL_ACHIEVABLE).over(upto))
                    .withColumn("_prof_b", F.max(i == GOAL_ACHIEVABLE).over(before))
                    .withColumn("_pref", F.last(pref_set, ignorenulls=True).over(upto))
                    .withColumn("_is_last", F.lead(F.lit(1)).over(w1).isNull()))
        wb = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = (rows.groupBy(key, "_bucket").agg(
                     F.max(F.when(F.col("_is_last"), F.col("_intro"))).alias("_b_intro"),
                     F.max(F.when(F.col("_is_last"), F.col("_prof"))).alias("_b_prof"),
                     F.max(F.when(F.col("_is_last"), F.col("_pref"))).alias("_b_pref"))
                 .withColumn("_c_intro", F.max("_b_intro").over(wb))
                 .withColumn("_c_prof", F.max("_b_prof").over(wb))
                 .withColumn("_c_pref", F.last("_b_pref", ignorenulls=True).over(wb))
                 .select(key, "_bucket", "_c_intro", "_c_prof", "_c_pref"))
        j = join_carry(rows, carry, key)
        c_intro = F.coalesce(F.col("_c_intro"), F.lit(False))
        c_prof = F.coalesce(F.col("_c_prof"), F.lit(False))
        df = (j.withColumn("introduction_state", c_intro | F.coalesce(F.col("_intro"), F.lit(False)))
               .withColumn("profiling_state", c_prof | F.coalesce(F.col("_prof"), F.lit(False)))
               .withColumn("preferences_state", F.coalesce(F.col("_pref"), F.col("_c_pref"), F.lit(False)))
               .withColumn("_prof_before", c_prof | F.coalesce(F.col("_prof_b"), F.lit(False)))
               .drop("_bucket", "_intro", "_prof", "_prof_b", "_pref", "_is_last", "_c_intro", "_c_prof", "_c_pref"))
    return (df.withColumn("route",
                          F.when(i == INITIALIZE, F.lit(ROUTE_INITIALIZE))
                           .when(goal & F.col("_prof_before"), F.lit(ROUTE_FALLBACK))
                           .when(goal, F.lit(ROUTE_CHECK_SMART))
                           .when(i == PREFERENCES, F.lit(ROUTE_PREFERENCES))
                           .when(i == RESET, F.lit(ROUTE_RESET))
                           .when(i.isNotNull() & ~F.col("_prof_before"), F.lit(ROUTE_FALLBACK)))
              .drop("_prof_before"))


def final_state(states: DataFrame, key: str = "conv_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last state of each conversation (``max_by`` on the event order)."""
    o = F.struct(*[F.col(c) for c in order])
    return states.groupBy(key).agg(
        F.max_by(F.struct("introduction_state", "profiling_state", "preferences_state"), o).alias("s"),
        F.count(F.lit(1)).alias("n_events")).select(key, "s.*", "n_events")
