"""Recognizers: any callable from samples to a response, run where the segments are."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (samples, start in seconds) -> response or None.
Recognizer = Callable[[list[float], float], dict | None]


def recognize(segments: DataFrame, recognizer: Recognizer, per_second: float | None = None, tasks: int = 1) -> DataFrame:
    """(series_id, seg, start_s, response): the recognizer's answer to each segment as JSON.

    An exception gives null, as does no answer. Spark may run a task again, so a recognizer must
    be idempotent.

    An outside service's limit is global. With a rate, segments are dealt evenly to so many tasks,
    and calls have slots: task i of n makes its calls n / per_second seconds apart, the first one
    i / per_second after its start. So together they never call more often than the rate, and reach
    it when all run; tasks that wait for a place only make it slower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = time.monotonic() + (TaskContext.get().partitionId() / per_second if per_second else 0.0)
        for batch in batches:
            out = []
            for samples, start in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if per_second:
                    time.sleep(max(0.0, ready - time.monotonic()))
                    ready = max(ready, time.monotonic()) + tasks / per_second
                try:
                    answer = recognizer(samples, start)
                except Exception:
                    answer = None
                out.append(json.dumps(answer) if answer else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["series_id", "seg", "start_s", "response"])

    rows = segments.select(F.col("series_id").cast("string"), F.col("seg").cast("int"), F.col("start_s").cast("double"), "samples")
    return (rows.repartition(tasks) if per_second else rows).mapInArrow(run, "series_id string, seg int, start_s double, response string")
