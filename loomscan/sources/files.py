"""Files below a path of any file system, for the tasks and the driver of the library's data sources."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def listed(system: fs.FileSystem, path: str, recursive: bool = False) -> Iterator[fs.FileInfo]:
    """What lies below a folder, in the order of its path; nothing for a folder that isn't there."""
    yield from sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive)), key=lambda i: i.path)


def write(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there, so that it is whole or absent."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def write_json(system: fs.FileSystem, path: str, value) -> None:
    write(system, path, json.dumps(value).encode())


def read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def remove(system: fs.FileSystem, path: str) -> None:
    if exists(system, path):
        system.delete_dir(path)
