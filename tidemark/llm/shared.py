"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """The owner of all tables that operators make inside: they go when the block ends, also by an error.

    Results read them, so they have to be written, or collected, inside.
    """
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            removed(spark, path)


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (a local test) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _local_folder()
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in that folder, owned by the scope that is open, if any."""
    path, paths = f"{root(spark)}/{name}-{uuid.uuid4().hex}", _made.get()
    if paths is not None:
        paths.append(path)
    return path


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: its lineage ends there.

    The table stays until the :func:`scope` around it ends, or for good where there is none.
    """
    path = folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, name: str, *columns: str) -> DataFrame:
    """Write a frame to the shared folder in sorted buckets, one file each, and read it back.

    Joins and aggregates by those columns then read it without a shuffle. The catalog forgets the
    table at once; the files stay.
    """
    spark = frame.sparkSession
    n, table = partitions(spark), f"{name}_{uuid.uuid4().hex}"
    dealt = frame.repartition(n, *[F.col(c) for c in columns])
    dealt.write.format("parquet").bucketBy(n, *columns).sortBy(*columns).option("path", folder(spark, name)).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return back


@contextlib.contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write that ends inside go with it: its table is what is left to read."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def passing(frame: DataFrame, name: str) -> Iterator[DataFrame]:
    """A frame written to the shared folder and read back, for as long as the block lasts; what was shuffled to make it goes at once."""
    spark, path = frame.sparkSession, folder(frame.sparkSession, name)
    with shuffles_end_with_writes(spark):
        frame.write.parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path)
    finally:
        removed(spark, path)


def spread(frame: DataFrame, name: str, column: str) -> DataFrame:
    """Write a frame to the shared folder in buckets of a column without a shuffle, and read it back."""
    spark = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    with shuffles_end_with_writes(spark):
        frame.write.format("parquet").bucketBy(partitions(spark), column).option("path", folder(spark, name)).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return back


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows with the other columns of a table that has each of their keys once, null keys too, and in ``count`` the number of rows that have it.

    Keys of more than a partition's share of the rows are fewer than the partitions: they are
    broadcast. The others are joined by a shuffle, where none has more rows than that share. Rows
    are read twice and the table three times, so both should be written ones.
    """
    share = (table.agg(F.sum(count)).first()[0] or 0) // partitions(rows.sparkSession)
    named = {k: f"__key_{i}" for i, k in enumerate(keys)}
    table = table.withColumnsRenamed(named)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]), how)

    hot = table.where(F.col(count) > share)
    rest = joined(rows, F.broadcast(hot.select(*named.values())), "left_anti")
    return joined(rows, F.broadcast(hot), "inner").unionByName(joined(rest, table.where(F.col(count) <= share), "inner")).drop(*named.values())


def unused(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def names(data: Column) -> list[Column]:
    """Two longs that stand for a binary column's bytes, made of their SHA-256."""
    digest = F.sha2(data, 256)
    return [F.xxhash64(digest), F.xxhash64(F.lit("second"), digest)]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """The id and the text alone, so that other columns never ride along or clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast(StringType()).alias("text"))
