"""Keyed stream state: rate limits, idempotent queues, task machines, windowed counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import in_order

STATES = ["queued", "running", "retrying", "succeeded", "failed", "cancelled"]
TERMINAL = ["succeeded", "failed", "cancelled"]


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, time: str = "ts") -> DataFrame:
    """A stream of a folder's Parquet files; event times get a time zone, which watermarks ask for."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling_counts(events: DataFrame, label: str, value: str, width: str = "1 hour", late: str | None = "1 hour", time: str = "ts") -> DataFrame:
    """(start, label, n, total) of every window; works on a stream and on a table alike."""
    rows = events.withWatermark(time, late) if events.isStreaming and late else events
    out = rows.groupBy(F.window(time, width), label).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), label, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def enqueue_once(tasks: DataFrame, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Each task_id once: in a stream the first within the watermark, in a table the first by time."""
    if tasks.isStreaming:
        return tasks.withWatermark(time, late).dropDuplicatesWithinWatermark(["task_id"])
    return tasks.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy(time, "payload"))).filter("_n = 1").drop("_n")


def enqueue_conflicts(tasks: DataFrame) -> DataFrame:
    """task_ids that came with different payloads."""
    return tasks.groupBy("task_id").agg(F.count_distinct("payload").alias("payloads")).filter("payloads > 1")


# rate limit


def _limit(times: list[float], accepted: list[float], limit: int, seconds: float) -> list[tuple[bool, float]]:
    """Decisions on times in order, given accepted times so far (changed in place): those at or before ``t - seconds`` have left the window."""
    out = []
    for t in times:
        while accepted and accepted[0] <= t - seconds:
            accepted.pop(0)
        ok = len(accepted) < limit
        out.append((ok, 0.0 if ok else accepted[0] + seconds - t))
        if ok:
            accepted.append(t)
    return out


_LIMITED = "event_id long, key long, ts timestamp, accepted boolean, retry_after double"


def _fold_runs(batches: Iterator[pa.RecordBatch], limit: int, seconds: float) -> Iterator[pa.RecordBatch]:
    """Decisions on rows (event_id, key, ts, run, at in microseconds) that come run by run, each run in order of time."""
    now, accepted = None, []
    for batch in batches:
        got = []
        for run, at in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "run")), strict=True), batch.column("at").to_pylist(), strict=True):
            if run != now:
                now, accepted = run, []
            got += _limit([at / 1e6], accepted, limit, seconds)
        kept = [batch.column(c) for c in ("event_id", "key", "ts")]
        decided = [pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.float64())]
        yield pa.RecordBatch.from_arrays(kept + decided, ["event_id", "key", "ts", "accepted", "retry_after"])


def rate_limit(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(event_id, key, ts, accepted, retry_after): at most ``limit`` accepted events of a key in any window.

    Rejected events do not enter the window, so the decision is a fold in order of time. On a stream the
    state is a key's accepted times, ``limit`` at most. A table is folded run by run: a key's events between gaps of a whole
    window are independent of what is before them, so a hot key is spread over as many tasks as it has runs. A task passes
    over its runs in order and holds the accepted times of one.
    """
    rows = events.select("event_id", "key", "ts")

    def decide(pdf: pd.DataFrame, accepted: list[float]) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        got = _limit([t.timestamp() for t in pdf["ts"]], accepted, limit, seconds)
        return pdf.assign(accepted=[g[0] for g in got], retry_after=[g[1] for g in got])

    if not events.isStreaming:
        from .tasks import runs

        own = runs(rows, seconds).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
        ordered = own.repartition("key", "run").sortWithinPartitions("key", "run", "ts", "event_id")
        return ordered.mapInArrow(functools.partial(_fold_runs, limit=limit, seconds=seconds), _LIMITED)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        out = decide(pd.concat(list(parts)), accepted)
        state.update((accepted,))
        yield out

    return rows.groupBy("key").applyInPandasWithState(step, _LIMITED, "accepted array<double>", "append", "NoTimeout")


# task machine


def _advance(row: dict, event: str, t: float, most: int, base: float) -> dict:
    state, attempt = row["state"], row["attempt"]
    if state in TERMINAL:
        return row
    if event == "cancel":
        return row | {"state": "cancelled"}
    if event == "start" and state in ("queued", "retrying") and t >= row["due"]:
        return row | {"state": "running", "attempt": attempt + 1, "since": t}
    if event == "success" and state == "running":
        return row | {"state": "succeeded"}
    if event in ("failure", "timeout") and state == "running":
        if attempt >= most:
            return row | {"state": "failed"}
        return row | {"state": "retrying", "due": t + base * 2 ** (attempt - 1)}
    return row


class _Task:
    """One task's state after its events so far."""

    def __init__(self, most: int, base: float, visible: float):
        self.options, self.visible = (most, base), visible
        self.row = {"state": "queued", "attempt": 0, "due": 0.0, "since": 0.0}

    def take(self, at: int | None, event: str) -> list[tuple]:
        t = float("nan") if at is None else at / 1e6
        if self.row["state"] == "running" and t - self.row["since"] > self.visible:
            self.row = _advance(self.row, "timeout", self.row["since"] + self.visible, *self.options)
        self.row = _advance(self.row, event, t, *self.options)
        return []

    def end(self) -> list[tuple]:
        return [(self.row["state"], self.row["attempt"], self.row["due"])]


def task_states(events: DataFrame, most: int = 3, base: float = 1.0, visible: float = 960.0) -> DataFrame:
    """(task_id, state, attempt, due): each task after its events (task_id, ts, event) in order of time.

    Events: start, success, failure, timeout, cancel. A task that runs longer than ``visible`` seconds when its
    next event comes has timed out before it. A failed attempt waits ``base * 2 ** (attempt - 1)`` seconds.
    """
    rows = events.select(F.col("task_id").cast("string").alias("task_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event")
    out = pa.schema([("task_id", pa.string()), ("state", pa.string()), ("attempt", pa.int64()), ("due", pa.float64())])
    return in_order(rows, ["at", "event"], functools.partial(_Task, most, base, visible), out, "task_id string, state string, attempt long, due double")


# research phases, fixed order
PHASES = ["init", "planning", "researching", "analyzing", "writing", "reviewing", "completed"]


class _Session:
    """One session's phase after its events so far."""

    def __init__(self, iterations: int):
        self.iterations, self.phase, self.turns = iterations, "init", 0

    def take(self, n: int, event: str) -> list[tuple]:
        if self.phase in ("completed", "cancelled"):
            return []
        if event == "cancel":
            self.phase = "cancelled"
        elif event in ("revise", "research") and self.phase == "reviewing":
            self.turns += 1
            self.phase = "completed" if self.turns >= self.iterations else {"revise": "writing", "research": "researching"}[event]
        elif event == "next":
            self.phase = PHASES[PHASES.index(self.phase) + 1]
        return []

    def end(self) -> list[tuple]:
        return [(self.phase, self.turns)]


def phase_machine(events: DataFrame, iterations: int = 3) -> DataFrame:
    """(session_id, phase, iteration): sessions after their events (session_id, n, event: next, revise, research, cancel).

    revise and research go back from reviewing to writing or researching, ``iterations`` times at most.
    """
    rows = events.select(F.col("session_id").cast("long").alias("session_id"), "n", "event")
    out = pa.schema([("session_id", pa.int64()), ("phase", pa.string()), ("iteration", pa.int64())])
    return in_order(rows, ["n"], functools.partial(_Session, iterations), out, "session_id long, phase string, iteration long")


def into_table(stream: DataFrame, key: list[str], path: str, checkpoint: str, late: str = "1 day", time: str = "ts"):
    """Writes each key of a stream once to a Parquet folder. What has been written is the stream's own state, as far back as ``late``; the folder is never read."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_table(counts: DataFrame, path: str) -> DataFrame:
    """Runs an aggregation over all that its stream has and gives its last complete result, from a Parquet folder under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(f"{path}/table")
