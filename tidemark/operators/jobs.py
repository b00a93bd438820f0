"""A job's own progress, as events in the log of tasks: counts that Spark observes while it runs."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions import scalars
from tidemark.sources import files

T = TypeVar("T")


class Job:
    """Events (task_id, at, seq, kind, status, progress, rows, message) of one task, appended one by one."""

    def __init__(self, spark: SparkSession, task_id: str, path: str):
        self.spark, self.task_id, self.path, self.seq = spark, task_id, path, 0

    def tell(self, kind: str, rows: int | None = None, message: str | None = None, current: int = 0, total: int = 1) -> None:
        """Append an event; its kind gives progress and status, as for any other task."""
        event = [(self.task_id, datetime.datetime.now(), self.seq, kind, rows, message, float(current), current, total)]
        frame = self.spark.createDataFrame(event, "task_id string, at timestamp, seq long, kind string, rows long, message string, pct double, current int, total int")
        made = frame.select("*", scalars.progress_event(F.col("kind"), F.col("pct"), F.col("current"), F.col("total")).alias("__p"))
        files.append_events(made.select("task_id", "at", "seq", "kind", "__p.status", "__p.progress", "rows", "message").coalesce(1), self.path)
        self.seq += 1

    def step(self, kind: str, frame: DataFrame, action: Callable[[DataFrame], T]) -> T:
        """Run an action over a frame, and tell how many rows went through it; no second pass counts them."""
        seen = Observation()
        try:
            out = action(frame.observe(seen, F.count(F.lit(1)).alias("rows")))
        except Exception as error:
            self.tell("failed", message=f"{type(error).__name__} in {kind}")
            raise
        self.tell(kind, rows=seen.get["rows"])
        return out


class Progress(StreamingQueryListener):
    """Tells a job of each micro-batch of the stream of a name that brought rows."""

    def __init__(self, job: Job, name: str, kind: str = "recognise"):
        self.job, self.name, self.kind = job, name, kind

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name and event.progress.numInputRows:
            self.job.tell(self.kind, rows=event.progress.numInputRows, message=f"batch {event.progress.batchId}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
