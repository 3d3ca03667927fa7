"""Virtual HDF5 datasets: a folder of ``VDS_<level>.hf`` files whose array is put together from the arrays of shard files.

The driver reads the lists of sources, nothing of the shards but the chunk shape of the first. Each source is a partition; a task opens
its file and reads the chunks that predicates leave. Sources must begin at whole chunks; what else a list may hold raises.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import DTYPES, ArrayDataset, Level, UnsupportedDtype
from ..operators.chunked import PLACE, ChunkGrid
from ..operators.encode import CHUNK_FIELDS, voxels_of
from .hdf5 import DATASPACE, DATATYPE, LAYOUT, Bytes, Dataset, Hdf5Error, Hdf5File
from .stores import Store

LEVEL_FILE = re.compile(r"^VDS_(\d+)\.hf$")
ARRAY = "vdata"


@dataclass(frozen=True)
class Source:
    """Where a shard's array lies in the virtual one of t, c, z, y, x."""

    uri: str
    path: str
    low: tuple[int, ...]
    size: tuple[int, ...]


def _box(b: Bytes, shape: tuple[int, ...], what: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """First place and size of a selection, which has to be one box."""
    kind, version = b.number(4), b.number(4)
    if kind == 3:
        b.skip(8)
        return (0,) * len(shape), shape
    if kind != 2:
        raise Hdf5Error(f"{what} has a selection of kind {kind}, which is not read")
    if version == 1:
        b.skip(8)
        rank, blocks = b.number(4), b.number(4)
        if blocks != 1:
            raise Hdf5Error(f"{what} selects {blocks} blocks; one is read")
        low, last = (tuple(b.number(4) for _ in range(rank)) for _ in range(2))
        return low, tuple(z - a + 1 for a, z in zip(low, last, strict=True))
    if version not in (2, 3):
        raise Hdf5Error(f"{what} has a selection of version {version}, which is not read")
    flags = b.number(1)
    wide = 8
    if version == 2:
        b.skip(4)
    else:
        wide = b.number(1)
        if not flags & 1:
            raise Hdf5Error(f"{what} has an irregular selection, which is not read")
    rank, low, size = b.number(4), [], []
    for _ in range(rank):
        start, stride, count, block = (b.number(wide) for _ in range(4))
        if count != 1 and stride != block or count == (1 << 8 * wide) - 1:
            raise Hdf5Error(f"{what} selects {count} blocks of an axis; one is read")
        low.append(start)
        size.append(count * block)
    return tuple(low), tuple(size)


def sources_of(uri: str) -> tuple[tuple[int, ...], np.dtype, list[Source]]:
    """Shape, type and sources of a file's virtual array."""
    file = Hdf5File(uri)
    address = file.find(ARRAY)
    if address is None:
        raise Hdf5Error(f"{uri} has no {ARRAY}")
    found = {kind: data for kind, _, data in file.messages(address) if kind in (DATASPACE, DATATYPE, LAYOUT)}
    shape, dtype, b = file._shape(found[DATASPACE]), file._dtype(found[DATATYPE]), Bytes(found[LAYOUT])
    if len(shape) != 5:
        raise Hdf5Error(f"{uri} has {len(shape)} axes; virtual arrays of t, c, z, y, x are read")
    version, kind = b.number(1), b.number(1)
    if (version, kind) != (4, 3):
        raise Hdf5Error(f"{uri} is no virtual array")
    heap, index = b.number(file.offsets), b.number(4)
    b = Bytes(_heap_object(file, heap, index))
    if b.number(1) != 0:
        raise Hdf5Error(f"{uri} lists its sources in a way that is not read")
    folder, out = uri.rpartition("/")[0], []
    for _ in range(b.number(file.lengths)):
        names = []
        for _ in range(2):
            end = b.data.index(b"\0", b.at)
            names.append(b.take(end - b.at).decode())
            b.skip(1)
        what = f"source {names[0]} of {uri}"
        inner, wanted = _box(b, (), what)
        low, size = _box(b, shape, what)
        if any(inner) or wanted and math.prod(wanted) != math.prod(size):
            raise Hdf5Error(f"{what} takes a part of its array; whole ones are read")
        name = names[0]
        place = uri if name == "." else name if name.startswith("/") or "://" in name else f"{folder}/{name}"
        out.append(Source(place, names[1], low, size))
    return shape, dtype, out


def _heap_object(file: Hdf5File, heap: int, index: int) -> bytes:
    head = file.at(heap, 8 + file.lengths)
    if head[:4] != b"GCOL":
        raise Hdf5Error(f"{file.uri} has no global heap at {heap}")
    b = Bytes(file.at(heap, int.from_bytes(head[8:], "little")), 8 + file.lengths)
    while b.at + 8 + file.lengths <= len(b.data):
        number = b.number(2)
        size = b.skip(6).number(file.lengths)
        if number == index:
            return b.take(size)
        if not number:
            break
        b.skip(-(-size // 8) * 8)
    raise Hdf5Error(f"{file.uri} has no object {index} in its heap")


def level_files(uri: str) -> dict[int, str]:
    """Levels of a folder and their files."""
    store = Store(uri)
    found = {int(m[1]): f"{uri.rstrip('/')}/{n}" for n in store.names() if (m := LEVEL_FILE.match(n))}
    if not found:
        raise Hdf5Error(f"{uri} has no virtual arrays")
    return dict(sorted(found.items()))


def _named(uri: str, dtype: np.dtype) -> str:
    name = {np.dtype(v[0]): k for k, v in DTYPES.items()}.get(dtype.newbyteorder("<"))
    if name is None:
        raise UnsupportedDtype(f"{uri} holds {dtype}")
    return name


def _array(file: Hdf5File, s: Source) -> tuple[Dataset, tuple[int, int, int]]:
    """A source's dataset, and the z, y, x chunk shape."""
    d = file.dataset(s.path)
    if len(d.shape) not in (3, 5) or d.contiguous or len(d.shape) == 5 and d.chunk[:2] != (1, 1):
        raise Hdf5Error(f"{s.uri} holds no chunks of one time and channel")
    if d.fill:
        raise Hdf5Error(f"{s.uri} is filled with {d.fill} where it has no chunks; only 0 is read")
    return d, d.chunk[-3:]


def open_virtual(uri: str, resolution: tuple[float, float, float] = (50.0, 1.0, 1.0)) -> ArrayDataset:
    """The dataset of a folder; voxel sizes are ``resolution`` and double with each level."""
    levels, dtype, heads = [], None, (1, 1)
    for r, path in level_files(uri).items():
        shape, kind, sources = sources_of(path)
        dtype, heads = dtype or _named(path, kind), shape[:2] if not levels else heads
        chunk = _array(Hdf5File(sources[0].uri), sources[0])[1] if sources else shape[2:]
        levels.append(Level(r, shape[2:], chunk, tuple(v * 2**r for v in resolution)))
    return ArrayDataset(uri.rstrip("/").rpartition("/")[2], dtype, *heads, tuple(levels))


class _Shard(InputPartition):
    def __init__(self, r: int, source: Source) -> None:
        self.r, self.source = r, source


class VirtualReader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.ds, self.files, self.tests = open_virtual(uri), level_files(uri), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and len(f.attribute) == 1 and f.attribute[0] in PLACE:
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def _passes(self, name: str, numbers: range | list[int]) -> bool:
        tests = [(test, v) for k, test, v in self.tests if k == name]
        return not tests or any(all(test(n, v) for test, v in tests) for n in numbers)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for r, path in self.files.items():
            if not self._passes("r", [r]):
                continue
            chunks = self.ds.chunks(r)
            for s in sources_of(path)[2]:
                if any(b % k for b, k in zip(s.low, chunks, strict=True)):
                    raise Hdf5Error(f"{s.uri} begins within a chunk")
                spans = [range(b // k, -(-(b + n) // k)) for b, n, k in zip(s.low, s.size, chunks, strict=True)]
                if all(self._passes(name, span) for name, span in zip(PLACE[1:], spans, strict=True)):
                    out.append(_Shard(r, s))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Shard):
            return
        r, s = partition.r, partition.source
        file, grid = Hdf5File(s.uri), ChunkGrid.of(self.ds, r)
        d, chunk = _array(file, s)
        if chunk != grid.chunk or _named(s.uri, d.dtype) != grid.dtype:
            raise Hdf5Error(f"{s.uri} differs in chunks or type from the first source")
        names, kinds = [f.split()[0] for f in CHUNK_FIELDS.split(", ")], [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
        begin = [b // k for b, k in zip(s.low, (1, 1, *chunk), strict=True)]
        axes = range(5 - len(d.shape), 5)
        near = lambda i, numbers: self._passes(PLACE[1 + axes[i]], [begin[axes[i]] + n for n in numbers])
        for level, node in file.nodes(d, 1, near):
            for found, data in file.chunks(d, level, node, near):
                at = [b + n for b, n in zip(begin, (0,) * (5 - len(found)) + found, strict=True)]
                inside = [max(0, min(k, n - i * k, b + m - i * k)) for i, k, n, b, m in zip(at[2:], chunk, grid.shape, s.low[2:], s.size[2:], strict=True)]
                if not math.prod(inside) or not all(self._passes(k, [v]) for k, v in zip(("t", "c"), at, strict=False)):
                    continue
                block = np.frombuffer(data, d.dtype).reshape(chunk)[tuple(slice(n) for n in inside)]
                row = [r, *at, grid.dtype, "null", grid.encode(block, "null", at[2:]), block.size]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


class VirtualDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_virtual"

    def schema(self) -> str:
        return CHUNK_FIELDS

    def reader(self, schema: StructType) -> VirtualReader:
        return VirtualReader(self.options["path"])


def read_virtual(spark: SparkSession, uri: str) -> DataFrame:
    """The chunk table of all levels of a folder."""
    spark.dataSource.register(VirtualDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("hdf5_virtual").load(uri)


def virtual_voxels(spark: SparkSession, uri: str, r: int = 0) -> DataFrame:
    """Voxels of a level; places that no source has a chunk for are left out."""
    grid = ChunkGrid.of(open_virtual(uri), r)
    return voxels_of(read_virtual(spark, uri).where(F.col("r") == r), grid.chunk, grid.shape, grid.dtype)
