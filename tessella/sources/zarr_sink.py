"""Chunk tables written into Zarr groups in one transaction: ``df.write.format("zarr_v2").mode("append").save(uri)``.

Each attempt of a task stages its chunks in a folder of its own below the group. The driver commits: it moves the files of the attempts
that Spark took, several at a time, and deletes the staging folder with whatever failed or doubled attempts left in it. If
a task fails for good, the group is as it was. A task that still runs when the job has ended sees that the staging folder's mark is
gone, removes what it wrote, and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.chunked import PLACE, ChunkGrid
from ..operators.encode import compress
from .stores import Store

NEEDED = [*PLACE, "dtype", "codec", "payload"]
MOVES_AT_ONCE = 32
MARK = "open"


@dataclass
class Staged(WriterCommitMessage):
    """What an attempt staged: its folder, and how many chunks and bytes."""

    folder: str
    chunks: int
    bytes: int


class ZarrWriter(DataSourceArrowWriter):
    """``overwrite``: the chunks of a level that are not written anew go, where any of the level are."""

    def __init__(self, uri: str, schema: StructType, overwrite: bool) -> None:
        from .zarr import group_arrays

        if missing := [c for c in NEEDED if c not in schema.fieldNames()]:
            raise ValueError(f"a chunk table has {', '.join(missing)} too")
        self.uri, self.overwrite = uri, overwrite
        self.arrays = {a.r: a for a in group_arrays(uri)}
        for a in self.arrays.values():
            if a.rank != 5 or a.chunk[:2] != (1, 1):
                raise ValueError("chunks are written into arrays of t, c, z, y, x with one time and channel a chunk")
        self.staging = f".staged-{uuid.uuid4().hex}"
        Store(uri).write(f"{self.staging}/{MARK}", b"")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder, chunks, size = f"{self.staging}/{uuid.uuid4().hex}", 0, 0
        store, group = Store(f"{self.uri}/{folder}"), Store(self.uri)
        for batch in iterator:
            for row in batch.select(NEEDED).to_pylist():
                name, data = self._chunk(row)
                store.write(name, data)
                if not group.has(f"{self.staging}/{MARK}"):
                    self._clear(group)
                    raise RuntimeError("the job that this task belongs to has ended")
                chunks, size = chunks + 1, size + len(data)
        return Staged(folder, chunks, size)

    def _chunk(self, row: dict) -> tuple[str, bytes]:
        """File name and bytes of a chunk as its array keeps them."""
        a = self.arrays.get(row["r"])
        at = (row["cz"], row["cy"], row["cx"])
        if a is None or not all(0 <= i < -(-n // k) for i, n, k in zip((row["t"], row["c"], *at), a.shape, a.chunk, strict=True)):
            raise ValueError(f"the group has no chunk {tuple(row[k] for k in PLACE)}")
        if row["dtype"] != a.dtype:
            raise ValueError(f"the group holds {a.dtype}, the chunk {row['dtype']}")
        shape, chunk = a.shape[2:], a.chunk[2:]
        grid = ChunkGrid(shape, chunk, a.dtype)
        inside = grid.inside(at)
        block = self._block(row, grid, at, inside)
        whole = np.full(chunk, a.fill, a.code)
        whole[tuple(slice(n) for n in inside)] = block
        return a.name(row), compress(whole.tobytes(order=a.head.get("order", "C")), a.codec, a.code.itemsize)

    @staticmethod
    def _block(row: dict, grid: ChunkGrid, at: tuple, inside: list[int]) -> np.ndarray:
        """The voxels of a payload that is padded to a whole chunk, or cut where the shape ends."""
        try:
            return grid.decode(row["payload"], row["codec"], at)
        except (ValueError, OSError):
            if tuple(inside) == grid.chunk:
                raise
            return ChunkGrid(grid.shape, grid.chunk, grid.dtype, cut=True).decode(row["payload"], row["codec"], at)

    def commit(self, messages: list[Staged | None]) -> None:
        store = Store(self.uri)
        moved: dict[str, str] = {}
        for m in messages:
            if m is not None and m.chunks:
                for name in Store(f"{self.uri}/{m.folder}").names():
                    moved[name] = f"{m.folder}/{name}"
        old: set[str] = set()
        if self.overwrite:
            for path in {name.partition("/")[0] for name in moved}:
                old |= {f"{path}/{n}" for n in store.names(path, relative=True) if not n.rpartition("/")[2].startswith(".z")}
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            list(pool.map(lambda x: store.move(x[1], x[0]), moved.items()))
            list(pool.map(store.delete, old - set(moved)))
        store.delete(f"{self.staging}/{MARK}")
        self._clear(store)

    def abort(self, messages: list[Staged | None]) -> None:
        store = Store(self.uri)
        if store.has(f"{self.staging}/{MARK}"):
            store.delete(f"{self.staging}/{MARK}")
        self._clear(store)

    def _clear(self, store: Store) -> None:
        place = f"{store.root}/{self.staging}"
        if store.fs.get_file_info(place).type == fs.FileType.Directory:
            store.fs.delete_dir(place)

