"""Chat session state as keyed streaming state (F10, stream form).

``session_state_stream`` runs a stateful processor (``transformWithState``):
one typed state row per conversation holds its flags and last event.  A
micro-batch's events of a conversation are sorted by time and applied with the
same transition table as the batch operator (``marketflow.operators.sessions``).
Events that fit one Arrow chunk are sorted in memory.  A longer burst is
written to the state store as sorted runs of bounded pieces and merged from
there, so memory per conversation is a few pieces however long the burst.
Idle conversations expire by event-time timers or by a processing-time TTL.

``session_state_batches`` is the form without per-key Python: every
micro-batch runs the batch operator (skew-safe time buckets), seeded with
the carried state table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DatetimeType, IntegralType

from marketflow.functions.keys import key_text, key_value
from marketflow.operators import sessions as S
from marketflow.session import path_exists, touch

def apply_intent(state: tuple[bool, bool, bool], intent: str) -> tuple[tuple[bool, bool, bool], str | None]:
    """One transition: (introduction, profiling, preferences), intent -> new state, route."""
    intro, prof, pref = state
    if intent == S.INITIALIZE:
        return (True, prof, pref), S.ROUTE_INITIALIZE
    if intent in (S.GOAL_ACHIEVABLE, S.GOAL_TEXT):
        if prof:
            return (intro, prof, pref), S.ROUTE_FALLBACK
        return (intro, prof or intent == S.GOAL_ACHIEVABLE, pref), S.ROUTE_CHECK_SMART
    if intent == S.PREFERENCES:
        return (intro, prof, True), S.ROUTE_PREFERENCES
    if intent == S.RESET:
        return (intro, prof, False), S.ROUTE_RESET
    return (intro, prof, pref), None if prof or intent is None else S.ROUTE_FALLBACK


def apply_events(state: tuple[bool, bool, bool], intents) -> tuple[tuple[bool, bool, bool], dict]:
    """``apply_intent`` over a time-ordered sequence of intents, vectorised.

    Flags set once stay set (running OR), preferences follow the last set or
    clear, and a goal intent routes to fallback when profiling was set before
    it.  Returns the state after the last event and the per-event columns.
    """
    intro0, prof0, pref0 = (bool(x) for x in state)
    it = pd.Series(intents, dtype=object)
    init = (it == S.INITIALIZE).to_numpy()
    ach = (it == S.GOAL_ACHIEVABLE).to_numpy()
    goal = ach | (it == S.GOAL_TEXT).to_numpy()
    pref_on = (it == S.PREFERENCES).to_numpy()
    reset = (it == S.RESET).to_numpy()
    intro = np.logical_or.accumulate(init) | intro0 if len(it) else init
    prof = np.logical_or.accumulate(ach) | prof0 if len(it) else ach
    prof_before = np.concatenate([[prof0], prof[:-1]]) if len(it) else prof
    pref = (pd.Series(np.where(pref_on, 1.0, np.where(reset, 0.0, np.nan))).ffill()
              .fillna(1.0 if pref0 else 0.0).to_numpy() == 1.0)
    other = it.notna().to_numpy() & ~prof_before.astype(bool)
    route = np.select([init, goal & prof_before, goal, pref_on, reset, other],
                      [S.ROUTE_INITIALIZE, S.ROUTE_FALLBACK, S.ROUTE_CHECK_SMART, S.ROUTE_PREFERENCES,
                       S.ROUTE_RESET, S.ROUTE_FALLBACK], default=None).astype(object)
    last = (bool(intro[-1]), bool(prof[-1]), bool(pref[-1])) if len(it) else (intro0, prof0, pref0)
    return last, {"introduction_state": intro, "profiling_state": prof, "preferences_state": pref,
                  "route": route}


FLAGS = ("introduction", "profiling", "preferences")
_STATES = tuple(f"{f}_state" for f in FLAGS)
_EVENT = ["at", "known", "eid"]              # order of a conversation's events


class SessionProcessor(StatefulProcessor):
    """Flags of one conversation, event after event.

    ``eid``: type of the event ids (long or string).  ``piece``: rows of a
    stored piece.  ``fan``: runs merged at once, so ``fan`` pieces are held.
    ``idle``: microseconds after which a conversation starts anew.
    """

    def __init__(self, eid: str, piece: int, fan: int, idle: int | None = None, ttl_ms: int | None = None):
        self.eid, self.piece, self.fan, self.idle, self.ttl_ms = eid, piece, fan, idle, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        flags = ", ".join(f"{f} boolean" for f in FLAGS)
        self.handle = handle
        self.state = handle.getValueState("session", f"{flags}, at long, known int, eid {self.eid}, timer long", self.ttl_ms)
        self.runs = handle.getMapState("runs", "run int, piece int",
                                       f"at array<long>, known array<int>, eid array<{self.eid}>, intent array<string>")

    # -- sorted runs in the state store

    def _put(self, run: int, number: int, frame: pd.DataFrame) -> None:
        self.runs.updateValue((run, number), tuple(frame[c].tolist() for c in (*_EVENT, "intent")))

    def _take(self, run: int, number: int) -> pd.DataFrame:
        got = self.runs.getValue((run, number))
        self.runs.removeKey((run, number))
        return pd.DataFrame({c: list(v) for c, v in zip((*_EVENT, "intent"), got)}).astype({"intent": object})

    def _store(self, run: int, blocks: Iterator[pd.DataFrame]) -> int:
        """Write sorted blocks as a run; the number of its pieces."""
        n = 0
        for block in blocks:
            for start in range(0, len(block), self.piece):
                self._put(run, n, block.iloc[start:start + self.piece])
                n += 1
        return n

    def _merged(self, runs: dict[int, int]) -> Iterator[pd.DataFrame]:
        """Blocks of the runs' rows in order; one piece of each run is held.

        All rows up to the least last row of the held pieces are complete."""
        held = {r: (self._take(r, 0), 1) for r, n in runs.items() if n}
        while held:
            lasts = {r: tuple(frame[_EVENT].iloc[-1]) for r, (frame, _) in held.items()}
            bound, ready = min(lasts.values()), []
            for r, (frame, at) in list(held.items()):
                n = len(frame) if lasts[r] == bound else int(np.count_nonzero([k <= bound for k in zip(*(frame[c] for c in _EVENT))]))
                ready.append(frame.iloc[:n])
                if n < len(frame):
                    held[r] = (frame.iloc[n:], at)
                elif at < runs[r]:
                    held[r] = (self._take(r, at), at + 1)
                else:
                    del held[r]
            yield pd.concat(ready, ignore_index=True).sort_values(_EVENT, kind="stable", ignore_index=True)

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The micro-batch's rows of the conversation in order, in blocks."""
        frames = (f.sort_values(_EVENT, kind="stable", ignore_index=True) for f in frames if len(f))
        first, second = next(frames, None), next(frames, None)
        if second is None:
            if first is not None:
                yield first
            return
        runs: dict[int, int] = {}
        for i, f in enumerate(itertools.chain([first, second], frames)):
            runs[i] = self._store(i, iter([f]))
        del first, second
        while len(runs) > self.fan:
            some = dict(itertools.islice(runs.items(), self.fan))
            new = max(runs) + 1
            runs = {r: n for r, n in runs.items() if r not in some} | {new: self._store(new, self._merged(some))}
        yield from self._merged(runs)

    # -- transitions

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        flags, last, timer = (tuple(held[:3]), tuple(held[3:6]), held[6]) if held else ((False,) * 3, None, None)
        for block in self._in_order(rows):
            places = list(zip(*(block[c] for c in _EVENT)))
            n_late = 0 if last is None else int(np.count_nonzero([p < last for p in places]))   # they come first
            if n_late:
                yield self._rows(key, block.iloc[:n_late], {**dict(zip(_STATES, flags)), "route": None}, True)
            block = block.iloc[n_late:]
            if not len(block):
                continue
            at = block["at"].to_numpy()
            cuts = [0, len(block)]
            if self.idle is not None:
                gaps = np.diff(at, prepend=at[:1] if last is None else last[0])
                cuts = sorted({0, *np.flatnonzero(gaps > self.idle).tolist(), len(block)})
                if gaps[0] > self.idle:
                    flags = (False,) * 3
            for start, stop in itertools.pairwise(cuts):
                part = block.iloc[start:stop]
                flags, cols = apply_events(flags if not start else (False,) * 3, part["intent"].to_numpy(object))
                yield self._rows(key, part, cols, False)
            last = tuple(x.item() if hasattr(x, "item") else x for x in places[-1])
        if last is not None:
            if self.idle is not None and (timer is None or timer <= last[0] // 1000 + self.idle // 1000):
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = last[0] // 1000 + self.idle // 1000 + 1
                self.handle.registerTimer(timer)
            self.state.update((*flags, *last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The conversation is over: an event after this would start anew anyway."""
        self.state.clear()
        yield from ()

    def _rows(self, key, events: pd.DataFrame, cols: dict, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"key_text": key[0], "eid": events["eid"].to_numpy(), "known": events["known"].to_numpy(),
                             "intent": events["intent"].to_numpy(object), **cols, "late": late}, index=range(len(events)))

    def close(self) -> None:
        pass


_LEAST = -(1 << 63)
PIECE, FAN = 2_000, 16


def session_state_stream(events: DataFrame, key: str = "conv_id", idle_seconds: float | None = None, ttl_seconds: float | None = None,
                         piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """F10 on a stream of ``(key, ts, event_id, intent)`` rows (append mode).

    The key may be of any groupable type; the NULL conversation is one like
    any other.  Within a micro-batch events are applied by (ts, event_id), NULLs
    first.  The state keeps the last event of each conversation; an event that
    arrives in a later micro-batch but lies before it comes out with ``late``
    true, the flags of that moment and no route, and changes nothing: replay
    those rows through the batch operator.

    ``idle_seconds``: a conversation that is silent for longer starts anew with
    its next event, as ``operators.sessions.session_state(idle_seconds=...)``
    has it.  ``events`` then need a watermark on ``ts``: once it has passed the
    end of the silence, a timer removes the state.  Rows older than the watermark
    are Spark's late rows and don't reach the processor.
    ``ttl_seconds``: state untouched for that long by the clock is removed.
    Spark then looks at the clock batch after batch, with or without data, so
    such a query runs until it is stopped (an ``availableNow`` trigger never ends).
    """
    from marketflow.session import ship_package
    if idle_seconds is not None and ttl_seconds is not None:
        raise ValueError("either event-time expiry (idle_seconds) or a processing-time TTL (ttl_seconds)")
    ship_package(events.sparkSession)
    kind, id_kind, ts_kind = (events.schema[c].dataType for c in (key, "event_id", "ts"))
    eid = "long" if isinstance(id_kind, IntegralType) else "string"
    time = F.unix_micros(F.col("ts").cast("timestamp")) if isinstance(ts_kind, DatetimeType) else F.col("ts").cast("long")
    if idle_seconds is not None and not isinstance(ts_kind, DatetimeType):
        raise ValueError("idle_seconds needs a time column ts")
    ev = events.select(key_text(F.col(key), kind).alias("key_text"), F.coalesce(time, F.lit(_LEAST)).alias("at"), F.col("event_id").isNotNull().cast("int").alias("known"),
                       F.coalesce(F.col("event_id").cast(eid), F.lit(0 if eid == "long" else "").cast(eid)).alias("eid"), "intent",
                       *(["ts"] if idle_seconds is not None else []))
    processor = SessionProcessor(eid, piece, fan, None if idle_seconds is None else int(idle_seconds * 1_000_000),
                                 None if ttl_seconds is None else int(ttl_seconds * 1_000))
    out = ev.groupBy("key_text").transformWithStateInPandas(
        processor, f"key_text string, eid {eid}, known int, intent string, {', '.join(f'{c} boolean' for c in _STATES)}, route string, late boolean",
        "append", "eventTime" if idle_seconds is not None else "processingTime" if ttl_seconds is not None else "none")
    return out.select(key_value(F.col("key_text"), kind).alias(key), F.when(F.col("known") == 1, F.col("eid")).cast(id_kind).alias("event_id"),
                      "intent", *_STATES, "route", "late")


def _seed_events(prior: DataFrame, types: dict, key: str, order, intent: str) -> DataFrame:
    """The carried state of each conversation as at most three leading events
    (NULL order values sort first in the windows).  Their own order does not
    matter: each only sets a flag."""
    arr = F.array_compact(F.array(F.when(F.col("introduction"), F.lit(S.INITIALIZE)),
                                  F.when(F.col("profiling"), F.lit(S.GOAL_ACHIEVABLE)),
                                  F.when(F.col("preferences"), F.lit(S.PREFERENCES))))
    return prior.select(key, F.explode(arr).alias(intent)).select(
        key, *[F.lit(None).cast(types[c]).alias(c) for c in order], intent, F.lit(False).alias("_real"))


def _stored(spark, state_path: str, base: int, upto: int) -> DataFrame | None:
    """State rows of the snapshot before batch ``base`` and of the changes of
    the batches ``base`` to ``upto - 1`` (an empty batch has none)."""
    names = [f"changes/_batch_id={b}" for b in range(base, upto)]
    names = [n for n in names if path_exists(spark, f"{state_path}/{n}")]
    if base and path_exists(spark, f"{state_path}/full/_batch_id={base - 1}"):
        names.append(f"full/_batch_id={base - 1}")
    out = None
    for n in names:
        part = spark.read.parquet(f"{state_path}/{n}").withColumn("_batch_id", F.lit(int(n.split("=")[1])).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def _newest(state: DataFrame, key: str) -> DataFrame:
    cols = [c for c in state.columns if c not in (key, "_batch_id")]
    return state.groupBy(key).agg(F.max_by(F.struct(*cols), "_batch_id").alias("s")).select(key, "s.*")


def _prior_state(spark, state_path: str, batch_id: int, keys: DataFrame, key: str, compact_every: int) -> DataFrame | None:
    """The state before ``batch_id`` of the conversations in ``keys``; ``None``
    if no batch before it stored any."""
    stored = _stored(spark, state_path, (batch_id // compact_every) * compact_every, batch_id)
    return None if stored is None else _newest(stored.join(keys, stored[key].eqNullSafe(keys[key]), "left_semi"), key)


def _check_gap(spark, state_path: str, batch_id: int, compact_every: int) -> None:
    """Fail when a batch before ``batch_id`` that its state depends on was not stored."""
    base = (batch_id // compact_every) * compact_every
    missing = [f"done/{b}" for b in range(base, batch_id) if not path_exists(spark, f"{state_path}/done/{b}")]
    if base and not any(path_exists(spark, f"{state_path}/{m}") for m in (f"full/_batch_id={base - 1}", f"done/none-{base - 1}")):
        missing.append(f"full/_batch_id={base - 1}")
    if missing:
        raise FileNotFoundError(f"{missing} missing below {state_path}; going on would reset conversations")


def session_state_batches(events: DataFrame, sink_path: str, state_path: str, checkpoint: str,
                          key: str = "conv_id", order=("ts", "event_id"), intent: str = "intent",
                          available_now: bool = False, bucket_seconds=S.DEFAULT_BUCKET_SECONDS,
                          hot_rows: int = S.DEFAULT_HOT_ROWS,
                          rows_per_bucket: int = S.DEFAULT_ROWS_PER_BUCKET,
                          compact_every: int = 50) -> StreamingQuery:
    """F10 on a stream with every micro-batch run by the batch operator.

    No conversation is handled by one task: a micro-batch goes through
    ``operators.sessions.session_state`` (buckets for hot conversations),
    seeded with the state each of its conversations had after the previous
    batch.  Below ``state_path``:

    * ``changes/_batch_id=N``: flags and last event of the conversations that
      batch N touched;
    * ``full/_batch_id=N``: the state of all conversations, written every
      ``compact_every`` batches, so a batch reads one snapshot and the changes
      after it, and writes only what changed;
    * ``done/N``: marks that batch N is stored.  A batch whose predecessor has
      no mark fails instead of resetting conversations.

    Output rows go to ``sink_path`` per batch id; a batch re-run after a
    failure replaces its own output and reads the same previous state.  Rows
    before their conversation's last stored event go to ``sink_path`` + "-late".
    An empty batch stores nothing but its mark.
    """
    order = list(order)

    def put(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(key, *order, intent).persist()
        try:
            _check_gap(spark, state_path, batch_id, compact_every)
            if not batch.isEmpty():
                run(spark, batch, batch_id)
            if (batch_id + 1) % compact_every == 0:
                stored = _stored(spark, state_path, batch_id + 1 - compact_every, batch_id + 1)
                if stored is None:                # no conversation so far
                    touch(spark, f"{state_path}/done/none-{batch_id}")
                else:
                    put(_newest(stored, key), f"{state_path}/full/_batch_id={batch_id}")
            touch(spark, f"{state_path}/done/{batch_id}")
        finally:
            batch.unpersist()

    def run(spark, batch: DataFrame, batch_id: int) -> None:
        ev = batch.withColumn("_real", F.lit(True))
        types = {c: ev.schema[c].dataType for c in order}
        prior = _prior_state(spark, state_path, batch_id, ev.select(key).distinct(), key, compact_every)
        if prior is not None:
            last = prior.select(F.col(key).alias("_last_key"), F.col("last").alias("_last"))
            ev = ev.join(last, ev[key].eqNullSafe(last["_last_key"]), "left").drop("_last_key")
            late = F.coalesce(F.struct(*order) < F.col("_last"), F.lit(False))
            put(ev.filter(late).drop("_last", "_real"), f"{sink_path}-late/_batch_id={batch_id}")
            ev = ev.filter(~late).drop("_last").unionByName(_seed_events(prior, types, key, order, intent))
        out = (S.session_state(ev, key, order, intent, bucket_seconds, hot_rows, rows_per_bucket)
                .filter(F.col("_real")).drop("_real"))
        put(out, f"{sink_path}/_batch_id={batch_id}")
        written = spark.read.parquet(f"{sink_path}/_batch_id={batch_id}")
        at = F.struct(*order)
        flags = F.struct("introduction_state", "profiling_state", "preferences_state")
        changed = written.groupBy(key).agg(F.max_by(flags, at).alias("s"), F.max(at).alias("last")).select(
            key, *[F.col(f"s.{f}_state").alias(f) for f in FLAGS], "last")
        put(changed, f"{state_path}/changes/_batch_id={batch_id}")

    w = events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
