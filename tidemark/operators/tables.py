"""Tables between the steps of an iteration, in the folder that executors share, and their removal."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, removed at exit, only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _local_folder()).rstrip("/")


class Scratch:
    """Tables of one computation. Written ones end a lineage; all but the last are removed when they are done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.paths, self.number = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def written(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a frame as Parquet and read it back."""
        path, self.number = f"{self.path}/{name}-{self.number}", self.number + 1
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[path] = back
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for path, frame in list(self.paths.items()):
            if any(frame is f for f in frames):
                self._delete(path)
                del self.paths[path]

    def result(self, frame: DataFrame, name: str = "result") -> DataFrame:
        """Write what the computation gives, and remove all its other tables."""
        out = self.written(frame, name)
        self.drop(*[f for f in self.paths.values() if f is not out])
        return out

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
