"""The latest state of each task, kept by a stream of its events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import tables


def latest_stream(events: DataFrame, task: str, order: list[str], columns: list[str]) -> DataFrame:
    """As the batch operator, on a stream: one state row to a task, in any order of arrival."""
    return events.groupBy(task).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("state")).select(task, "state.*")


def state_root(spark: SparkSession) -> str:
    """A new place for a stream's state in the folder that executors share."""
    return f"{tables.root(spark)}/tasks-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, task: str, root: str) -> DataFrame:
    """Process what is there and stop; the states, read back from the epochs' folders."""
    write = stream.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: upsert(batch, epoch, f"{root}/states"))
    write.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_upserts(stream.sparkSession, f"{root}/states", task)


def upsert(batch: DataFrame, epoch: int, path: str) -> None:
    """A foreachBatch sink: each epoch in a folder of its own, so that a repeated epoch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_upserts(spark: SparkSession, path: str, task: str) -> DataFrame:
    """The last epoch's row of each task."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (task, "epoch")]
    return rows.groupBy(task).agg(F.max_by(F.struct(*others), "epoch").alias("state")).select(task, "state.*")
