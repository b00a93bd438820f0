"""Result and task files: readers that pass over what can't be read, and writers."""

from __future__ import annotations

import fnmatch
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.functions import scalars
from tidemark.sources import stores

#: Names that are listed, and bytes of text that are read, before they go on.
_NAMES, _TEXT = 10_000, 1 << 20


def _is_folder(path: str) -> bool:
    """Whether Arrow finds a folder there; not so for patterns, and for stores that it lacks."""
    try:
        system, root = stores.of(path)
        return system.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, value) of the files in a folder, and in its folders ``key=value``, whose names fit a pattern: each file one row.

    One task lists the names, as a stream, and they are dealt to tasks that read many files each: the
    driver holds nothing of a file, and a file costs no Spark split. What Arrow finds no folder in, and
    patterns with brackets or braces, are left to Spark's reader.
    """
    if not _is_folder(path) or set(pattern) & set("[]{}\\"):
        text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
        return text.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), "value")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            fit = (n for n in stores.each_file(*stores.of(path)) if fnmatch.fnmatchcase(n.rpartition("/")[2], pattern))
            while some := list(itertools.islice(fit, _NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = stores.of(path)
        for batch in batches:
            read, texts, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as source:
                    texts.append(source.read())
                read.append(name)
                size += len(texts[-1])
                if size >= _TEXT:
                    yield pa.RecordBatch.from_arrays([pa.array(read, pa.string()), pa.array(texts, pa.binary())], ["name", "text"])
                    read, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(read, pa.string()), pa.array(texts, pa.binary())], ["name", "text"])

    system, root = stores.of(path)
    folder = f"file:{root}" if isinstance(system, fs.LocalFileSystem) else path
    dealt = spark.range(0, 1, 1, 1).mapInArrow(names, "name string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(read, "name string, text binary").select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("file"), F.col("text").cast("string").alias("value"))


def read_tracklists(spark: SparkSession, path: str, pattern: str = "*_tracklist*.json") -> DataFrame:
    """(file, pos, track fields) of JSON tracklists; a file that is no JSON array of tracks gives no rows."""
    text = whole_texts(spark, path, pattern)
    tracks = F.from_json("value", T.ArrayType(model.TRACK), {"mode": "PERMISSIVE"})
    rows = text.select("file", F.posexplode(tracks).alias("pos", "track"))
    return rows.where(F.col("track").isNotNull()).select("file", "pos", "track.*")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(file, pos, line) of text tracklists. A tracklist is small, so a file is read as one row and its lines keep their order."""
    text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("pos", "line"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files; corrupt ones are left out. The id is the file's name."""
    fields = [f for f in model.TASK if f.name != "task_id"]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    text = whole_texts(spark, path, "*.json")
    task = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = text.select(scalars.stem(F.col("file")).alias("task_id"), task.alias("task"))
    return rows.where("task is not null and task._corrupt is null").select("task_id", *[f"task.{f.name}" for f in fields])


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) without reading any content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def write_tracklists(tracks: DataFrame, path: str, task: str, order: str) -> None:
    """Each task's tracks in order as one indented JSON array, in a file of its own in the folder ``task=...``.

    A tracklist is small, so it is one row; tasks are spread.
    """
    fields = F.struct(F.col(order).alias("__order"), F.struct(*[F.col(f.name) for f in model.TRACK]).alias("__track"))
    lists = tracks.groupBy(task).agg(F.sort_array(F.collect_list(fields)).alias("__all"))
    text = F.to_json(F.transform("__all", lambda x: x["__track"]), {"pretty": "true", "ignoreNullFields": "false"})
    lists.select(task, text.alias("value")).write.partitionBy(task).text(path)


def write_lines(tracks: DataFrame, path: str, task: str, order: str) -> None:
    """Each task's tracks in order as text lines, in a file of its own in the folder ``task=...``."""
    line = scalars.txt_line(F.col("start_time"), F.col("title"), F.col("artist"), F.col("match_count"))
    dealt = tracks.select(task, order, line.alias("value")).repartition(F.col(task)).sortWithinPartitions(task, order)
    dealt.select(task, "value").write.partitionBy(task).text(path)


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, line) of a downloader's log files: those there are, or as a stream also those to come."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def append_events(events: DataFrame, path: str) -> None:
    """Task events are appended, never rewritten; readers take the latest."""
    events.write.mode("append").parquet(path)
