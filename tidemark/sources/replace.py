"""Text files that are replaced whole: written aside by tasks, moved into place on commit, removed on abort."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark import model
from tidemark.sources import stores


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task has filled."""

    folder: str


class FilesWriter(DataSourceArrowWriter):
    """Each task writes into a folder of its own, so that a task that runs twice does no harm."""

    def __init__(self, path: str):
        self.path, self.aside = path, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = stores.of(self.path)
        folder = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        for batch in iterator:
            if batch.num_rows:
                system.create_dir(folder)
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"{name!r} is no file name")
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write((text or "").encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = stores.of(self.path)
        for message in messages:
            if message is not None:
                for name in sorted(stores.names(system, message.folder)):
                    system.move(f"{message.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """A task that still runs may write once more after this; ``leftovers`` finds that."""
        system, root = stores.of(self.path)
        with contextlib.suppress(FileNotFoundError):
            system.delete_dir(f"{root}/{self.aside}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def replace_files(rows: DataFrame, path: str, name: Column, text: Column) -> None:
    """Write each row's text as a file of its own, which replaces one of that name; other files stay.

    Readers see the old file or the new one, never a part. If a task fails, all old files stay. Names
    must differ.
    """
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select(name.cast("string").alias("name"), text.cast("string").alias("text")).write.format("tidemark_files").option("path", path).mode("append").save()


def upsert_tasks(states: DataFrame, path: str) -> None:
    """One JSON file to a task, ``<task_id>.json``, without the volatile fields; a row for each task."""
    kept = [c for c in states.columns if c not in (*model.VOLATILE_KEYS, "task_id")]
    replace_files(states, path, F.concat("task_id", F.lit(".json")), F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))


def write_tracklists(tracks: DataFrame, path: str, name: str, order: str) -> None:
    """Each name's tracks in order as one indented JSON array in a file of that name. A tracklist is small, so it is one row."""
    fields = F.struct(F.col(order).alias("__order"), F.struct(*[F.col(f.name) for f in model.TRACK]).alias("__track"))
    lists = tracks.groupBy(name).agg(F.sort_array(F.collect_list(fields)).alias("__all"))
    replace_files(lists, path, F.col(name), F.to_json(F.transform("__all", lambda x: x["__track"]), {"pretty": "true", "ignoreNullFields": "false"}))


def leftovers(path: str) -> list[str]:
    """Folders of jobs that died between writing and commit, for a sweep."""
    system, root = stores.of(path)
    return [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith("_staged-")]
