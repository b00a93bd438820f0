"""Files of the local system, and of stores that Arrow reads, by the paths that Spark gives them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs


def of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it. Spark writes local paths with one slash or three."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def open_input(path: str) -> BinaryIO:
    """An open file that can seek."""
    system, inner = of(path)
    return system.open_input_file(inner)


def names(system: fs.FileSystem, folder: str) -> dict[str, int]:
    """Sizes of the files right inside a folder, hidden ones left out; none for a folder that is not there."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}


def each_file(system: fs.FileSystem, folder: str) -> Iterator[str]:
    """Files right inside a folder and in its folders ``key=value``, by their paths from it, one by one: a local folder's names are never all in memory."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            kinds = ((e.name, e.is_dir()) for e in entries)
            yield from _below(system, folder, kinds)
    else:
        found = system.get_file_info(fs.FileSelector(folder))
        yield from _below(system, folder, ((f.base_name, f.type == fs.FileType.Directory) for f in found))


def _below(system: fs.FileSystem, folder: str, kinds: Iterator[tuple[str, bool]]) -> Iterator[str]:
    for name, is_folder in kinds:
        if name[0] in "._":
            continue
        if not is_folder:
            yield name
        elif "=" in name:
            yield from (f"{name}/{below}" for below in each_file(system, f"{folder}/{name}"))
