"""TIFF files and stacks of them as chunk tables (``tiff_chunks``), read by ranges.

A chunk is some rows of one plane: as many whole strips as ``depth`` asks for. The driver lists files and reads the tags of one
of them; tasks read the tags of theirs, then the strips that predicates on t, c, cz and cy leave, and no other bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import ArrayDataset, Level
from ..operators.chunked import ChunkGrid
from ..operators.encode import CHUNK_FIELDS
from ..operators.grid import read_depth
from .stores import Store
from .tiff import BITS, LENGTH, STACK, WIDTH, Ranged, _ifds, strip_rows, strips

FILE = re.compile(r"\.tiff?$", re.IGNORECASE)
#: Bytes of the rows that are read at once, where no depth is given, and of a partition.
CHUNK_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20


class Stack:
    """Planes of a file (its pages follow each other in z) or a folder (files in the order of their names, in folders T<t>/CH<c> or not)."""

    def __init__(self, uri: str, depth: int | None = None) -> None:
        folder, _, name = uri.rstrip("/").rpartition("/")
        one = FILE.search(name) is not None
        self.root = folder if one else uri.rstrip("/")
        store = Store(self.root)
        names = [name] if one else [n for n in store.names() if FILE.search(n)]
        if not names:
            raise ValueError(f"{uri} has no TIFF files")
        order, pages = self.pages(store, names[0])
        tags = pages[0]
        self.shape, self.dtype = (tags[LENGTH][0], tags[WIDTH][0]), f"uint{tags.get(BITS, [1])[0]}"
        step = strip_rows(tags)
        self.rows = min(-(-depth // step) * step if depth else read_depth(*self.shape, step, np.dtype(self.dtype).itemsize, CHUNK_BYTES), -(-self.shape[0] // step) * step)
        self.files: dict[tuple[int, int], list[str]] = {}
        for n in names:
            m = re.search(STACK, f"/{n}")
            self.files.setdefault((int(m[1]), int(m[2])) if m else (0, 0), []).append(n)
        self.planes = len(pages) if one else 1
        self.depth = max(map(len, self.files.values())) * self.planes

    @staticmethod
    def pages(store: Store, name: str) -> tuple[str, list[dict[int, list[int]]]]:
        with store.open(name) as f:
            return _ifds(Ranged(f))

    @property
    def grid(self) -> ChunkGrid:
        return ChunkGrid((self.depth, *self.shape), (1, self.rows, self.shape[1]), self.dtype)


class _Planes(InputPartition):
    """Files of one time and channel: names, and the z of the first."""

    def __init__(self, t: int, c: int, z: int, names: list[str]) -> None:
        self.t, self.c, self.z, self.names = t, c, z, names


class TiffReader(DataSourceReader):
    def __init__(self, uri: str, depth: int | None) -> None:
        self.stack, self.tests = Stack(uri, depth), []
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and len(f.attribute) == 1 and f.attribute[0] in ("r", "t", "c", "cz", "cy", "cx"):
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def _passes(self, name: str, number: int) -> bool:
        return all(test(number, v) for k, test, v in self.tests if k == name)

    def partitions(self) -> list[InputPartition]:
        s, out = self.stack, []
        if not (self._passes("r", 0) and self._passes("cx", 0)):
            return [InputPartition(None)]
        step = max(1, PARTITION_BYTES // max(1, s.shape[0] * s.shape[1] * s.planes * np.dtype(s.dtype).itemsize))
        for (t, c), names in sorted(s.files.items()):
            if self._passes("t", t) and self._passes("c", c):
                wanted = [k for k in range(len(names)) if any(self._passes("cz", k * s.planes + p) for p in range(s.planes))]
                runs = np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1) if wanted else []
                for run in runs:
                    out += [_Planes(t, c, int(k[0]) * s.planes, [names[i] for i in k]) for k in (run[i : i + step] for i in range(0, len(run), step))]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Planes):
            return
        s, store = self.stack, Store(self.stack.root)
        little = np.dtype(s.dtype).newbyteorder("<")
        names, kinds = [f.split()[0] for f in CHUNK_FIELDS.split(", ")], [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
        z = partition.z
        for name in partition.names:
            with store.open(name) as f:
                data = Ranged(f)
                order, pages = _ifds(data)
                if len(pages) != s.planes:
                    raise ValueError(f"{name} has {len(pages)} pages, the first file {s.planes}")
                for tags in pages:
                    if (tags[LENGTH][0], tags[WIDTH][0]) != s.shape or f"uint{tags.get(BITS, [1])[0]}" != s.dtype:
                        raise ValueError(f"{name} differs in shape or type from the first file")
                    strip = strip_rows(tags)
                    for cy in range(-(-s.shape[0] // s.rows)) if self._passes("cz", z) else ():
                        if not self._passes("cy", cy):
                            continue
                        low, high = cy * s.rows, min((cy + 1) * s.rows, s.shape[0])
                        first = low // strip
                        held = strips(data, order, tags, first, -(-high // strip))[low - first * strip :][: high - low]
                        block = np.zeros((s.rows, s.shape[1]), little)
                        block[: high - low] = held
                        row = [0, partition.t, partition.c, z, cy, 0, s.dtype, "null", block.tobytes(), held.size]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                    z += 1
                self.bytes_read += data.read


class TiffDataSource(DataSource):
    """Options: ``path`` of a file or folder; ``depth``, rows of a chunk (rounded up to whole strips)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_chunks"

    def schema(self) -> str:
        return CHUNK_FIELDS

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options["depth"]) if "depth" in self.options else None)


def read_tiff(spark: SparkSession, uri: str, depth: int | None = None) -> tuple[DataFrame, ChunkGrid]:
    """The chunk table of a file or stack, and its grid."""
    spark.dataSource.register(TiffDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tiff_chunks")
    return (reader.option("depth", depth) if depth else reader).load(uri), Stack(uri, depth).grid


def open_tiff(uri: str, depth: int | None = None) -> ArrayDataset:
    """The dataset that a file or stack makes."""
    s = Stack(uri, depth)
    return ArrayDataset(uri.rstrip("/").rpartition("/")[2], s.dtype, max(t for t, _ in s.files) + 1, max(c for _, c in s.files) + 1, (Level(0, s.grid.shape, s.grid.chunk),))
