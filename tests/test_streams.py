"""Streams against the table rules: task machines with timers, leases, split rate limits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.streaming import events, tasks

BASE = datetime(2024, 1, 1)


def _at(s):
    return BASE + timedelta(seconds=s)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_machine_acts_on_deadlines_alone():
    m = tasks.Machine(1, 10.0, 100.0)
    assert m.run([(0.0, "start")], 1000.0) == [(0.0, "start", "running", 1), (100.0, "reclaim", "retrying", 1), (110.0, "promote", "queued", 1)]
    assert m.run([(120.0, "start"), (121.0, "failure"), (122.0, "start")]) == [(120.0, "start", "running", 2), (121.0, "failure", "failed", 2)]
    assert tasks.Machine(1, 1.0, 1.0).run([(0.0, "cancel"), (1.0, "start")]) == [(0.0, "cancel", "cancelled", 0)]
    assert tasks.Machine(0, 1.0, 5.0).run([(0.0, "success"), (1.0, "start")], 9.0) == [(1.0, "start", "running", 1), (6.0, "reclaim", "failed", 1)]


def test_task_stream_equals_the_table(rocks, tmp_path):
    """Events out of order within the watermark, a task whose last event is a start, a retry that only a timer brings back."""
    rng = random.Random(2)
    rows = [("stale", _at(5), "start"), ("waits", _at(1), "start"), ("waits", _at(2), "failure"), ("done", _at(1), "start"), ("done", _at(3), "success")]
    rows += [(f"t{rng.randrange(6)}", _at(rng.randrange(4000)), rng.choice(["start", "start", "success", "failure", "cancel"])) for _ in range(80)]
    rows = sorted(set(rows), key=lambda r: r[1] + timedelta(seconds=rng.randrange(60)))  # arrive up to a minute late
    schema, path = "task_id string, ts timestamp, event string", str(tmp_path / "in")
    for part in (rows[:30], rows[30:60], [*rows[60:], ("clock", _at(20_000), "cancel")]):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = tasks.transitions(rocks.readStream.schema(schema).parquet(path), 2, 10.0, 300.0, late="2 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    until = _at(20_000 - 120)
    want = tasks.transitions(rocks.createDataFrame(rows, schema), 2, 10.0, 300.0, until=until.timestamp())
    key = lambda df: sorted((r["task_id"], r["at"], r["event"], r["state"], r["attempt"]) for r in df.collect() if r["task_id"] != "clock")
    got = key(rocks.read.parquet(str(tmp_path / "out")))
    assert got == key(want)
    assert ("stale", _at(305), "reclaim", "retrying", 1) in got and ("stale", _at(315), "promote", "queued", 1) in got and ("waits", _at(12), "promote", "queued", 1) in got


def test_leases_on_streams_equal_the_table(spark, tmp_path):
    claims = [(1, _at(0)), (2, _at(10)), (3, _at(20)), (4, _at(30)), (5, _at(40)), (1, _at(2000))]
    acks = [(1, _at(60), True), (2, _at(311), True), (3, _at(320), False), (5, _at(39), True), (6, _at(50), True), (1, _at(2000), True), (1, _at(2001), False)]
    far = 100_000
    c, a = spark.createDataFrame(claims, "id long, claimed_at timestamp"), spark.createDataFrame(acks, "id long, acked_at timestamp, ok boolean")
    want = sorted(((r["id"], r["claimed_at"], r["acked_at"], r["outcome"]) for r in tasks.lease_outcomes(c, a).collect()), key=str)
    assert {(r[0], r[1]): r[3] for r in want if r[1] < _at(100)} == {(1, _at(0)): "published", (2, _at(10)): "expired", (3, _at(20)): "retry", (4, _at(30)): "expired", (5, _at(40)): "expired"}
    assert [r[3] for r in want if r[1] == _at(2000)] == ["published", "retry"]
    out = str(tmp_path / "out")
    for part in range(2):  # acknowledgements of the second file come after all claims
        c.union(spark.createDataFrame([(99, _at(far + part))], c.schema)).filter(F.lit(part == 0) | (F.col("id") == 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "claims"))
        a.filter((F.col("id") == 1) == (part == 0)).union(spark.createDataFrame([(98, _at(far + part if part else 1500), True)], a.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "acks"))
        stream = tasks.lease_outcomes(spark.readStream.schema(c.schema).parquet(str(tmp_path / "claims")), spark.readStream.schema(a.schema).parquet(str(tmp_path / "acks")), late="1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r["id"], r["claimed_at"], r["acked_at"], r["outcome"]) for r in spark.read.parquet(out).collect() if r["id"] != 99), key=str)
    assert got == want


@pytest.mark.parametrize("limit", [1, 3])
def test_split_rate_limit_equals_the_fold(spark, limit):
    """Gaps just under, at and just over the window, in one hot key and others; runs are what a task gets at most."""
    rng = random.Random(limit)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.choice([0.0, 0.5, 20.0, 59.999999, 60.0, 60.000001, 300.0])
        rows.append((i, 7 if rng.random() < 0.7 else rng.choice([1, None]), BASE + timedelta(microseconds=round(t * 1e6))))
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp")
    want = {}
    for k in (7, 1, None):
        accepted = []
        for i, _, ts in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            accepted = [x for x in accepted if x > ts - timedelta(seconds=60)]
            want[i] = len(accepted) < limit
            accepted += [ts] if want[i] else []
    assert {r["event_id"]: r["accepted"] for r in events.rate_limit(df, limit, 60.0).collect()} == want
    sizes = [r["count"] for r in tasks.runs(df, 60.0).groupBy("key", "run").count().collect()]
    assert max(sizes) < 60 and len(sizes) > 50  # the hot key alone has 280 events


@pytest.mark.parametrize("fold", [lambda e: tasks.transitions(e, 1, 5.0, 60.0), lambda e: events.task_states(e, 2, 5.0, 60.0)])
def test_tasks_are_folded_in_one_pass(spark, fold):
    rng = random.Random(11)
    base = datetime(2024, 1, 1)
    rows = [(f"t{rng.randrange(60)}" if i % 40 else None, base + timedelta(seconds=rng.randrange(600)), rng.choice(["start", "start", "failure", "success", "cancel"])) for i in range(400)]
    rows += [("hot", base + timedelta(seconds=i), rng.choice(["start", "failure"])) for i in range(300)]
    df = spark.createDataFrame(rows, "task_id string, ts timestamp, event string")
    got = fold(df)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a Python call for each task took over an hour for six million events
    alone = [sorted(map(str, fold(df.filter(F.col("task_id").eqNullSafe(F.lit(t)))).collect())) for t in ("t1", "t2", "hot", None)]
    all_rows = [r for r in got.collect()]
    assert alone == [sorted(str(r) for r in all_rows if r["task_id"] == t) for t in ("t1", "t2", "hot", None)]
    assert {r["task_id"] for r in fold(df).collect()} <= {r[0] for r in rows}
