"""Calls within a rate that many tasks share, and a job's progress as events."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs, recognize, tasks


def test_many_tasks_share_a_rate(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(24).select(F.lit("a").alias("series_id"), F.col("id").cast("int").alias("seg"), F.col("id").cast("double").alias("start_s"), F.array(F.lit(1.0).cast("float")).alias("samples"))

    def recognizer(samples, start):
        with open(f"{folder}/{int(start)}", "w") as out:
            out.write(repr(time.time()))
        return {"n": len(samples)}

    spark.range(4).repartition(4).mapInArrow(lambda b: b, "id long").count()  # workers are up
    assert recognize.recognize(rows, recognizer, per_second=10, tasks=4).where("response is not null").count() == 24
    calls = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert len(calls) == 24
    for a, b in zip(calls, calls[10:], strict=False):
        assert b - a > 0.7  # ten calls apart: a second, but for when tasks began
    assert calls[-1] - calls[0] < 24 / 10 * 3  # and not one task after another


def test_no_rate(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, [1.0]), ("a", 1, 1.0, None)], "series_id string, seg int, start_s double, samples array<float>")

    def recognizer(samples, start):
        return {"n": len(samples)}

    assert sorted((r.seg, r.response) for r in recognize.recognize(rows, recognizer).collect()) == [(0, '{"n": 1}'), (1, None)]


def test_events_match_counts(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    job = jobs.Job(spark, "t1", log)
    job.tell("upload")
    job.step("features", spark.range(1000).where("id % 3 = 0"), lambda f: f.write.parquet(out))
    assert job.step("segments", spark.read.parquet(out).groupBy((F.col("id") % 7).alias("k")).count(), lambda f: f.collect())
    job.tell("done")
    with pytest.raises(Exception, match="no"):
        jobs.Job(spark, "t2", log).step("load", spark.range(3).select(F.raise_error(F.lit("no"))), lambda f: f.collect())
    events = spark.read.parquet(log)
    assert [(r.kind, r.status, r.progress, r.rows) for r in events.where("task_id = 't1'").orderBy("seq").collect()] == [("upload", "processing", 0, None), ("features", "processing", 16, 334), ("segments", "processing", 23, 7), ("done", "completed", 100, None)]
    last = {r.task_id: (r.status, r.progress) for r in tasks.latest(events, "task_id", ["seq"], ["status", "progress"]).collect()}
    assert last == {"t1": ("completed", 100), "t2": ("error", 0)}


def test_stream_progress(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for n in (5, 8):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
    listener = jobs.Progress(jobs.Job(spark, "s", log), "watched")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while time.time() < until:
            try:
                if spark.read.parquet(log).count() == 2:
                    break
            except Exception:
                time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(r.rows for r in spark.read.parquet(log).collect()) == [5, 8]
