"""Files of a store, by URI or local path."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs


def rename_over(files: fs.FileSystem, old: str, new: str) -> None:
    """Rename a file, over what may be there, also where a file system refuses that."""
    try:
        files.move(old, new)
    except OSError:
        if files.get_file_info(new).type == fs.FileType.NotFound:
            raise
        files.delete_file(new)
        files.move(old, new)


class Store:
    """A folder on any file system that pyarrow knows."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def open(self, name: str) -> pa.NativeFile:
        """A file for reads at any place."""
        return self.fs.open_input_file(f"{self.root}/{name}")

    def find(self, name: str) -> bytes | None:
        """What a file holds; null without one."""
        try:
            return self.read(name)
        except FileNotFoundError:
            return None

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: under a name of its own first, then renamed, over what may be there. Two attempts of one task
        so each write their own file, and the last one stays."""
        path = f"{self.root}/{name}"
        part = f"{path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(str(PurePosixPath(path).parent), recursive=True)
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        rename_over(self.fs, part, path)

    def move(self, old: str, new: str) -> None:
        """Rename a file of the store, over what may be there."""
        path = f"{self.root}/{new}"
        self.fs.create_dir(str(PurePosixPath(path).parent), recursive=True)
        rename_over(self.fs, f"{self.root}/{old}", path)

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.File

    def names(self, below: str = "", relative: bool = False) -> list[str]:
        """Files below a folder; ``relative`` to it instead of the store."""
        top = f"{self.root}/{below}".rstrip("/")
        found = self.fs.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return sorted(f.path[len(top if relative else self.root) + 1 :] for f in found if f.type == fs.FileType.File and not f.path.endswith(".part"))

    def folders(self, below: str = "") -> list[str]:
        """Names of the folders right below one."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
