"""The state machine of tasks: batch and stream against a fold in Python, with late and repeated events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import tasks
from tidemark.streaming import lifecycle
from tidemark.streaming import tasks as sink

HOUR = datetime.timedelta(hours=1)
T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "task_id string, at timestamp, seq long, status string, progress int, message string"
STATUS = [*model.TRANSITIONS, "unknown"]


def fold(rows, now=None):
    """By task: status, progress, message, at, seq, accepted, refused."""
    stale, out = model.STALE_HOURS * HOUR, {}
    for task in {r[0] for r in rows}:
        own = {}
        for r in rows:
            if r[0] == task:
                key = lambda r: tuple((x is not None, x or 0) for x in r[3:])
                own[r[1:3]] = min(own.get(r[1:3], r), r, key=key)
        state, good, bad = None, 0, 0
        for _, at, seq, status, progress, message in sorted(own.values(), key=lambda r: r[1:3]):
            may = model.TRANSITIONS[state[0] if state else None]
            if status in may and state and state[0] in model.OPEN_STATUS and at > state[3] + stale:
                state, may = ("error", 0, model.INTERRUPTED, state[3] + stale, state[4]), ()
            if status in may:
                state, good = (status, progress, message, at, seq), good + 1
            else:
                bad += 1
        if state and now and state[0] in model.OPEN_STATUS and now > state[3] + stale:
            state = ("error", 0, model.INTERRUPTED, state[3] + stale, state[4])
        out[task] = (*(state or (None,) * 5), good, bad)
    return out


def history(seed, n=40, gap=10.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + datetime.timedelta(minutes=rnd.randrange(300))
        plan = [rnd.choice(["pending", "downloading"]), "processing", "processing", rnd.choice(["completed", "error"])]
        for k, status in enumerate(plan[: rnd.randrange(1, 5)]):
            at += datetime.timedelta(minutes=rnd.randrange(1, 40) if rnd.random() > 0.06 else 60 * 30)
            status = rnd.choice(STATUS) if rnd.random() < 0.25 else status
            rows.append((f"t{i}", at, k, status, rnd.choice([None, 10 * k]), rnd.choice([None, f"m{k}"])))
    return rows + rnd.sample(rows, len(rows) // 4)


def found(rows):
    return {r.task_id: (r.status, r.progress, r.message, r["at"], r.seq, r.accepted, r.refused) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_batch(spark, seed):
    rows = history(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(tasks.lifecycle(table, "task_id").collect()) == fold(rows)
    now = T0 + 40 * HOUR
    assert found(tasks.lifecycle(table, "task_id", F.lit(now)).collect()) == fold(rows, now)
    assert any(r[0] == "error" and r[2] == model.INTERRUPTED for r in fold(rows, now).values())


def test_odd_batches(spark):
    assert tasks.lifecycle(spark.createDataFrame([], SCHEMA), "task_id").count() == 0
    rows = [("a", T0, 1, "completed", 1, None), ("a", T0, 2, None, None, None), ("b", T0, 1, "pending", 0, "x"), ("b", T0, 1, "pending", 0, "x"), ("b", T0 + HOUR, 2, "downloading", 5, None)]
    assert found(tasks.lifecycle(spark.createDataFrame(rows, SCHEMA), "task_id").collect()) == {"a": (None,) * 5 + (0, 2), "b": ("pending", 0, "x", T0, 1, 1, 1)}


@pytest.fixture
def rocks(spark):
    with lifecycle.state_store(spark):
        yield spark


def run(spark, source, tmp, wait="100 hours"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    return found(sink.run_available(lifecycle.states(stream, "task_id", wait), "task_id", f"file://{tmp}/state").collect())


def test_stream_equals_batch(rocks, tmp_path):
    """Events dealt at random over four batches, so that many are late; then a restart with one more file."""
    rows = history(7)
    random.Random(1).shuffle(rows)
    source = f"file://{tmp_path}/events"
    quarter = len(rows) // 4 + 1
    for k in range(0, len(rows), quarter):
        rocks.createDataFrame(rows[k : k + quarter], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run(rocks, source, tmp_path) == fold(rows)
    last = ("clock", T0 + 400 * HOUR, 0, "pending", 0, None)  # moves the watermark: all settles, and open tasks are swept
    rocks.createDataFrame([last], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run(rocks, source, tmp_path) == fold(rows, T0 + 300 * HOUR) | fold([last])


def test_settled_events_are_forgotten(rocks, tmp_path):
    """What comes behind the watermark is dropped; a repeated event behind it is not counted."""
    source = f"file://{tmp_path}/events"
    batches = [[("a", T0, 0, "pending", 0, None), ("clock", T0 + 10 * HOUR, 0, "pending", 0, None)], [("a", T0 + 9.5 * HOUR, 1, "processing", 10, None), ("a", T0, 0, "pending", 0, None)], [("a", T0 + 9.8 * HOUR, 2, "completed", 100, None)]]
    for rows in batches:
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = run(rocks, source, tmp_path, "1 hour")
    assert out["a"] == ("completed", 100, None, T0 + 9.8 * HOUR, 2, 3, 0)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_groups_of_tasks(rocks, tmp_path, zone):
    """State is kept by group: many tasks take few entries. Numbers beyond 2^53 beside a null, late and repeated events, in any time zone."""
    rows = [(None if r[0] == "t0" else 2**60 + int(r[0][1:]), *r[1:]) for r in history(11, 300)]
    random.Random(2).shuffle(rows)
    schema, source, out = SCHEMA.replace("task_id string", "task_id long"), f"file://{tmp_path}/events", f"file://{tmp_path}/states"
    before = rocks.conf.get("spark.sql.session.timeZone")
    rocks.conf.set("spark.sql.session.timeZone", zone)
    try:
        for part in (rows[::2], rows[1::2]):
            rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = lifecycle.states(stream, "task_id", "100 hours", groups=8).writeStream.outputMode("update").foreachBatch(lambda batch, epoch: sink.upsert(batch, epoch, out))
        query = writer.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        assert found(sink.read_upserts(rocks, out, "task_id").collect()) == fold(rows)
        # a value and a timer with its index for each group, and for the tasks without a name
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 9
    finally:
        rocks.conf.set("spark.sql.session.timeZone", before)


def test_groups_settle_as_time_passes(rocks, tmp_path):
    """Tasks of two groups over batches in order of time: each batch settles some, and timers sweep others."""
    rows = sorted(history(13, 60), key=lambda r: r[1])
    source, size = f"file://{tmp_path}/events", len(rows) // 6 + 1
    for k in range(0, len(rows), size):
        rocks.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    back = sink.run_available(lifecycle.states(stream, "task_id", "1 hour", groups=2), "task_id", f"file://{tmp_path}/state").collect()
    wanted = fold(rows, rows[-1][1] - HOUR)
    assert found(back) == wanted and wanted != fold(rows)
