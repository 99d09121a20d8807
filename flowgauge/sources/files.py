"""Small files in the folders that Spark sees, from Python code of a driver or a task."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str):
    system, where = of(path)
    return system.open_input_file(where)


def exists(path: str) -> bool:
    system, where = of(path)
    return system.get_file_info(where).type == fs.FileType.File


def listed(path: str) -> list[str]:
    """The files of a folder by name, none of a folder that is missing."""
    system, where = of(path)
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted(f"{path}/{i.base_name}" for i in found if i.type == fs.FileType.File)


def remove(path: str) -> None:
    """Removes a file; one that is gone already is no error."""
    if exists(path):
        system, where = of(path)
        system.delete_file(where)


def read_json(path: str) -> dict:
    with open_file(path) as f:
        return json.loads(f.read())


def write_json(path: str, content: dict) -> None:
    """Writes a file whole, or not at all: it takes its name once it is complete."""
    system, where = of(path)
    folder = where.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(json.dumps(content).encode())
    system.move(draft, where)
