"""Task queues on streams: a machine that moves by event time, and deliveries that are joined with their acknowledgements.

``transitions`` works on a table and on a stream and gives the same rows. On a stream each task's events wait in its state until the watermark
has passed them, so that they are taken in order of time however they arrive, and event-time timers fire where a task is due
without an event of its own: a retry comes back to the queue when its wait is over, and an attempt that nobody ends is taken back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import in_order

TERMINAL = ("succeeded", "failed", "cancelled")
TRANSITIONS = "task_id string, at timestamp, event string, state string, attempt long"


class Machine:
    """One task. Events: start, success, failure, cancel; deadlines of its own: promote (a retry is due), reclaim (an attempt is stale).

    ``retries`` attempts may fail before the last one; the wait after attempt n is ``base * 2 ** (n - 1)`` seconds; an
    attempt is stale ``visible`` seconds after its start and then counts as failed.
    """

    def __init__(self, retries: int, base: float, visible: float, state: str = "queued", attempt: int = 0, deadline: float | None = None):
        self.retries, self.base, self.visible = retries, base, visible
        self.state, self.attempt, self.deadline = state, attempt, deadline

    def _end_attempt(self, t: float) -> None:
        if self.attempt > self.retries:
            self.state, self.deadline = "failed", None
        else:
            self.state, self.deadline = "retrying", t + self.base * 2 ** (self.attempt - 1)

    def due(self, until: float) -> Iterator[tuple[float, str]]:
        """The deadlines that come at ``until`` or before, each after it has been acted on."""
        while self.deadline is not None and self.deadline <= until:
            t = self.deadline
            if self.state == "retrying":
                self.state, self.deadline = "queued", None
                yield t, "promote"
            else:
                self._end_attempt(t)
                yield t, "reclaim"

    def take(self, t: float, event: str) -> bool:
        """Whether an event changes the task; one that does not fit its state is ignored."""
        if self.state in TERMINAL:
            return False
        if event == "cancel":
            self.state, self.deadline = "cancelled", None
        elif event == "start" and self.state == "queued":
            self.state, self.attempt, self.deadline = "running", self.attempt + 1, t + self.visible
        elif event == "success" and self.state == "running":
            self.state, self.deadline = "succeeded", None
        elif event == "failure" and self.state == "running":
            self._end_attempt(t)
        else:
            return False
        return True

    def step(self, t: float, event: str) -> list[tuple[float, str, str, int]]:
        """Transitions (time, event, state, attempt) of the deadlines up to an event, and of the event."""
        out = [(at, name, self.state, self.attempt) for at, name in self.due(t)]
        return [*out, (t, event, self.state, self.attempt)] if self.take(t, event) else out

    def run(self, events: list[tuple[float, str]], until: float | None = None) -> list[tuple[float, str, str, int]]:
        """Transitions (time, event, state, attempt) of events in order, and of deadlines up to ``until``."""
        out = []
        for t, event in sorted(events):
            out += self.step(t, event)
        if until is not None:
            out += [(at, name, self.state, self.attempt) for at, name in self.due(until)]
        return out


def _rows(task: str, found: list[tuple[float, str, str, int]]) -> pd.DataFrame:
    text = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({
        "task_id": text([task] * len(found)), "at": pd.Series(pd.to_datetime([round(f[0] * 1e6) for f in found], unit="us")),
        "event": text([f[1] for f in found]), "state": text([f[2] for f in found]), "attempt": pd.Series([f[3] for f in found], dtype="int64"),
    })


class _OnTable:
    """A task whose events come in order of time, in microseconds."""

    def __init__(self, retries: int, base: float, visible: float, until: float | None):
        self.machine, self.until = Machine(retries, base, visible), until

    def take(self, at: int | None, event: str) -> list[tuple]:
        return self._micros(self.machine.step(float("nan") if at is None else at / 1e6, event))

    def end(self) -> list[tuple]:
        return [] if self.until is None else self._micros([(at, name, self.machine.state, self.machine.attempt) for at, name in self.machine.due(self.until)])

    @staticmethod
    def _micros(found: list[tuple[float, str, str, int]]) -> list[tuple]:
        return [(None if at != at else round(at * 1e6), *rest) for at, *rest in found]


class _OnStream(StatefulProcessor):
    def __init__(self, retries: int, base: float, visible: float):
        self.options = (retries, base, visible)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "state string, attempt bigint, deadline double")
        self.waiting = handle.getListState("waiting", "t double, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList([(t.timestamp(), e) for t, e in zip(pdf["ts"], pdf["event"], strict=True)])
        self._wake()
        yield _rows(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        events = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        machine = self._machine()
        found = machine.run([e for e in events if e[0] <= passed], passed)
        self.task.update((machine.state, machine.attempt, machine.deadline))
        left = [e for e in events if e[0] > passed]
        self.waiting.put(left) if left else self.waiting.clear()
        self._wake()
        yield _rows(key[0], found)

    def close(self) -> None:
        pass

    def _machine(self) -> Machine:
        return Machine(*self.options, *self.task.get()) if self.task.exists() else Machine(*self.options)

    def _wake(self) -> None:
        """One timer: at the first waiting event or the deadline."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        deadline = self._machine().deadline
        times = [*times, deadline] if deadline is not None else times
        if times:
            self.handle.registerTimer(int(-(-min(times) * 1000 // 1)))


def transitions(events: DataFrame, retries: int = 2, base: float = 1.0, visible: float = 960.0, until: float | None = None, late: str = "1 hour") -> DataFrame:
    """(task_id, at, event, state, attempt): every change of every task, of events (task_id, ts timestamp, event).

    On a table deadlines are acted on up to ``until`` (seconds since 1970; by default up to a task's last event). On a stream,
    which asks for the RocksDB state store, up to the watermark, ``late`` behind the newest event; later arrivals are left out.
    """
    rows = events.select("task_id", "ts", "event")
    if rows.isStreaming:
        stateful = rows.withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(_OnStream(retries, base, visible), TRANSITIONS, "Append", "EventTime")
        return stateful

    timed = rows.select(F.col("task_id").cast("string").alias("task_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event")
    out = pa.schema([("task_id", pa.string()), ("at", pa.int64()), ("event", pa.string()), ("state", pa.string()), ("attempt", pa.int64())])
    moved = in_order(timed, ["at", "event"], functools.partial(_OnTable, retries, base, visible, until), out, "task_id string, at long, event string, state string, attempt long")
    return moved.withColumn("at", F.timestamp_micros("at"))


# deliveries


def lease_outcomes(claims: DataFrame, acks: DataFrame, lease: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(id, claimed_at, acked_at, outcome) of claims (id, claimed_at) and acknowledgements (id, acked_at, ok).

    An acknowledgement counts for a claim of its id from then until the lease ends, both included: published, or retry where it is not ok.
    A claim without one is expired. Two acknowledgements of a claim are two rows. On streams both sides have a
    watermark, and an expired claim comes out once it has passed the lease's end.
    """
    if claims.isStreaming:
        claims, acks = claims.withWatermark("claimed_at", late), acks.withWatermark("acked_at", late)
    a = acks.select(F.col("id").alias("ack_id"), "acked_at", "ok")
    meets = (F.col("id") == F.col("ack_id")) & (F.col("acked_at") >= F.col("claimed_at")) & (F.col("acked_at") <= F.col("claimed_at") + F.expr(f"interval {lease}"))
    outcome = F.when(F.col("ack_id").isNull(), "expired").when(F.col("ok"), "published").otherwise("retry")
    return claims.select("id", "claimed_at").join(a, meets, "left_outer").select("id", "claimed_at", "acked_at", outcome.alias("outcome"))


# rate limit of hot keys


def runs(events: DataFrame, seconds: float) -> DataFrame:
    """``events`` (event_id, key, ts) with ``run``: a key's events between two gaps of ``seconds`` or more, from 0 in order of time.

    Whatever was accepted before such a gap has left the window after it, so runs are independent. Two events with a gap between them lie in
    different cells of ``seconds``; only a key's cells, with their first and last times, are put in order, never its events.
    """
    from pyspark.sql import Window

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    width = int(round(seconds * 1_000_000))
    own = events.select("event_id", "key", "ts").withColumn("cell", F.floor(micros("ts") / width))
    cells = own.groupBy("key", "cell").agg(F.min(micros("ts")).alias("first"), F.max(micros("ts")).alias("last"))
    w = Window.partitionBy("key").orderBy("cell")
    begins = F.coalesce((F.col("first") - F.lag("last").over(w) >= width).cast("long"), F.lit(0))
    numbered = cells.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w)).select(F.col("key").alias("k"), F.col("cell").alias("c"), "run")
    return own.join(numbered, F.col("key").eqNullSafe(F.col("k")) & (F.col("cell") == F.col("c"))).select("event_id", "key", "ts", "run")
