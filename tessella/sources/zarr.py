"""Zarr version 2 groups and series of arrays as a Spark data source (``zarr_v2``) and sink.

A read enumerates the chunks of each array's grid that predicates on r, t, c and chunk numbers leave, and deals them to
partitions of some MB each; tasks open the chunks' files. A chunk without a file holds the fill value: where that is 0 its
voxels are not listed, as voxel tables leave zeros out, otherwise they are.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import DTYPES, ArrayDataset, Level, UnsupportedDtype
from ..operators.encode import block_batch, chunks_of, compress, decompress
from ..operators.grid import with_chunks
from ..operators.metadata import zattrs, zgroup
from .stores import Store

FIELDS = "r int, t int, c int, z int, y int, x int, v double, cz int, cy int, cx int"
PRUNABLE = ("r", "t", "c", "cz", "cy", "cx")
#: Decoded bytes of a partition, and how many partitions there may be beside that.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 20_000
#: Arrays of a series: one of z, y, x for each time, channel and level.
SERIES = re.compile(r"^t(\d{2})_c(\d{2})_(?:.*_)?(\d+)\.zarr$")


class ArrayAt:
    """A stored array: its path, level, and for arrays of z, y, x the time and channel."""

    def __init__(self, path: str, r: int, head: dict, t: int = 0, c: int = 0) -> None:
        rank = len(head["shape"])
        if rank not in (3, 5):
            raise ValueError(f"{path} has {rank} axes; arrays of t, c, z, y, x or of z, y, x are read")
        if head.get("zarr_format", 2) != 2:
            raise ValueError(f"{path} is of zarr version {head['zarr_format']}")
        if head.get("filters"):
            raise ValueError(f"{path} has filters, which are not read: {head['filters']}")
        self.path, self.r, self.head, self.rank, self.t, self.c = path, r, head, rank, t, c
        self.code, self.shape, self.chunk = np.dtype(head["dtype"]), tuple(head["shape"]), tuple(head["chunks"])
        if self.dtype is None:
            raise UnsupportedDtype(head["dtype"])
        self.codec = (head.get("compressor") or {"id": "null"})["id"]
        self.fill = head.get("fill_value") or 0
        self.fill = float(self.fill) if isinstance(self.fill, str) else self.fill  # NaN and infinities are strings

    @property
    def dtype(self) -> str | None:
        return {v[0]: k for k, v in DTYPES.items()}.get(self.code.newbyteorder("<").str)

    def grid(self) -> dict[str, range]:
        """Chunk numbers of each axis; those of t and c are indexes where a chunk holds one of them."""
        counts = [-(-n // k) for n, k in zip(self.shape, self.chunk, strict=True)]
        names = ["t", "c", "cz", "cy", "cx"][5 - self.rank :]
        return ({"t": range(self.t, self.t + 1), "c": range(self.c, self.c + 1)} if self.rank == 3 else {}) | {k: range(n) for k, n in zip(names, counts, strict=True)}

    def name(self, at: dict[str, int]) -> str:
        numbers = [at[k] for k in ("t", "c", "cz", "cy", "cx")[5 - self.rank :]]
        return f"{self.path}/" + self.head.get("dimension_separator", ".").join(map(str, numbers))

    def block(self, data: bytes | None) -> np.ndarray:
        """A chunk as (t, c, z, y, x); without data full of the fill value."""
        if data is None:
            block = np.full(self.chunk, self.fill, self.code)
        else:
            raw = decompress(data, self.codec, math.prod(self.chunk) * self.code.itemsize)
            block = np.frombuffer(raw, self.code).reshape(self.chunk, order=self.head.get("order", "C"))
        return block if self.rank == 5 else block[None, None]

    def batches(self, at: dict[str, int], block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(block.shape[0]):
            for j in range(block.shape[1]):
                t, c = at["t"] * block.shape[0] + i, at["c"] * block.shape[1] + j
                if self.rank == 3 or (t < self.shape[0] and c < self.shape[1]):
                    yield block_batch(block[i, j], self.shape[-3:], at | {"r": self.r, "t": t, "c": c})


def _head(store: Store, path: str) -> dict:
    return json.loads(store.read(f"{path}/.zarray".lstrip("/")))


def group_arrays(uri: str) -> list[ArrayAt]:
    store = Store(uri)
    attrs = json.loads(store.read(".zattrs"))
    if "multiscales" not in attrs:
        raise ValueError(f"{uri} has no multiscales")
    return [ArrayAt(d["path"], r, _head(store, d["path"])) for r, d in enumerate(attrs["multiscales"][0]["datasets"])]


def series_folder(uri: str) -> str:
    folder, _, name = uri.rstrip("/").rpartition("/")
    return folder if SERIES.match(name) else uri


def series_arrays(uri: str) -> list[ArrayAt]:
    """Arrays ``tNN_cNN_<level>.zarr`` in a folder, which ``uri`` names, or next to the one that it names."""
    store, found = Store(series_folder(uri)), []
    for name in store.folders():
        if m := SERIES.match(name):
            found.append(ArrayAt(name, int(m[3]), _head(store, name), int(m[1]), int(m[2])))
    if not found:
        raise ValueError(f"{uri} has no arrays of a series")
    return sorted(found, key=lambda a: (a.r, a.t, a.c))


def open_group(uri: str, name: str | None = None) -> ArrayDataset:
    """The dataset that a group's documents describe."""
    arrays, levels = group_arrays(uri), []
    for a, d in zip(arrays, json.loads(Store(uri).read(".zattrs"))["multiscales"][0]["datasets"], strict=True):
        scale = d.get("coordinateTransformations", [{}])[0].get("scale", [1.0] * 5)
        levels.append(Level(a.r, a.shape[-3:], a.chunk[-3:], tuple(scale[-3:])))
    t, c = arrays[0].shape[:2] if arrays[0].rank == 5 else (1, 1)
    return ArrayDataset(name or uri.rstrip("/").rpartition("/")[2], arrays[-1].dtype, t, c, tuple(levels))


def open_series(uri: str, resolution: tuple[float, float, float] = (1.0, 0.3, 0.3)) -> ArrayDataset:
    """The dataset of a series; voxel sizes are ``resolution`` and double with each level. There are as many levels as the largest says."""
    arrays = series_arrays(uri)
    first = {a.r: a for a in reversed(arrays)}
    levels = tuple(Level(r, first[r].shape, first[r].chunk, tuple(v * 2**r for v in resolution)) for r in range(max(first) + 1))
    return ArrayDataset(uri.rstrip("/").rpartition("/")[2], arrays[0].dtype, max(a.t for a in arrays) + 1, max(a.c for a in arrays) + 1, levels)


class _Chunks(InputPartition):
    """Chunks ``begin`` to ``end`` (without it), in C order of the numbers that predicates left, of one array."""

    def __init__(self, array: ArrayAt, numbers: dict[str, list[int]], begin: int, end: int) -> None:
        self.array, self.numbers, self.begin, self.end = array, numbers, begin, end


class ZarrReader(DataSourceReader):
    def __init__(self, uri: str, arrays: Callable[[str], list[ArrayAt]]) -> None:
        self.uri, self.arrays, self.tests = uri, arrays, []
        self.folder = series_folder(uri) if arrays is series_arrays else uri

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and len(f.attribute) == 1 and f.attribute[0] in PRUNABLE:
                self.tests.append((f.attribute[0], compare[type(f)], getattr(f, "value", None)))
            yield f  # Spark tests rows again, as a chunk may hold several times or channels

    def _passes(self, name: str, numbers: list[int]) -> bool:
        """Whether any of the numbers passes all predicates on this column."""
        return any(all(test(n, v) for k, test, v in self.tests if k == name) for n in numbers)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        dealt = []
        for a in self.arrays(self.uri):
            if not self._passes("r", [a.r]):
                continue
            each = {"t": a.chunk[0], "c": a.chunk[1]} if a.rank == 5 else {}
            numbers = {k: [i for i in span if self._passes(k, list(range(i * each.get(k, 1), (i + 1) * each.get(k, 1))))] for k, span in a.grid().items()}
            dealt.append((a, numbers, math.prod(map(len, numbers.values()))))
        every = sum(n for _, _, n in dealt)
        for a, numbers, n in dealt:
            step = max(1, PARTITION_BYTES // (math.prod(a.chunk) * a.code.itemsize), -(-every // MOST_PARTITIONS))
            out += [_Chunks(a, numbers, k, min(n, k + step)) for k in range(0, n, step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Chunks):
            return
        store, a, names = Store(self.folder), partition.array, list(partition.numbers)
        sizes = [len(v) for v in partition.numbers.values()]
        for k in range(partition.begin, partition.end):
            at = {n: partition.numbers[n][int(i)] for n, i in zip(names, np.unravel_index(k, sizes), strict=True)}
            data = store.find(a.name(at))
            if data is None and a.fill == 0:
                continue
            for batch in a.batches(at, a.block(data)):
                yield batch.set_column(6, "v", batch.column(6).cast(pa.float64()))


class ZarrDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr_v2"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(self.options["path"], series_arrays if self.options.get("kind") == "series" else group_arrays)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        from .zarr_sink import ZarrWriter

        return ZarrWriter(self.options["path"], schema, overwrite)


def read_zarr(spark: SparkSession, uri: str, kind: str = "group") -> DataFrame:
    """``kind``: group, or series."""
    spark.dataSource.register(ZarrDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("zarr_v2").option("kind", kind).load(uri)


def write_chunks(chunks: DataFrame, uri: str, overwrite: bool = False) -> None:
    """Put a chunk table into a group made before, in one transaction."""
    chunks.sparkSession.dataSource.register(ZarrDataSource)
    chunks.select("r", "t", "c", "cz", "cy", "cx", "dtype", "codec", "payload").write.format("zarr_v2").mode("overwrite" if overwrite else "append").save(uri)


def create_zarr(ds: ArrayDataset, uri: str, codec: str = "zstd", channels: list[dict] | None = None, fill_value: float = 0, separator: str = "/", order: str = "C") -> None:
    """The documents of a group whose chunks are all empty; regions are written afterwards."""
    store = Store(uri)
    store.write(".zgroup", zgroup().encode())
    store.write(".zattrs", json.dumps(zattrs(ds, channels or [{"vmin": 0, "vmax": None}] * ds.C)).encode())
    compressor = {"null": None, "zlib": {"id": "zlib", "level": 6}, "zstd": {"id": "zstd", "level": 3}, "blosc": {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 1, "blocksize": 0}}[codec]
    for level in ds.levels:
        head = {"chunks": list(ds.chunks(level.r)), "compressor": compressor, "dimension_separator": separator, "dtype": DTYPES[ds.dtype][0], "fill_value": fill_value, "filters": None, "order": order, "shape": list(ds.shape(level.r)), "zarr_format": 2}
        store.write(f"{level.r}/.zarray", json.dumps(head).encode())


def write_zarr(levels: list[DataFrame], ds: ArrayDataset, uri: str, codec: str = "zstd", channels: list[dict] | None = None) -> int:
    """Write each level's voxels as a Zarr group; the number of chunks written. Tasks write their own chunks; a file
    that exists is complete, and a task that runs again writes the same."""
    create_zarr(ds, uri, codec, channels)
    total = 0
    for level, voxels in zip(ds.levels, levels, strict=True):

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, n = Store(uri), 0
            for batch in batches:
                for row in batch.to_pylist():
                    out.write("/".join(str(row[k]) for k in ("r", "t", "c", "cz", "cy", "cx")), row["payload"])
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

        made = chunks_of(voxels, level.chunk, ds.dtype, codec, level.r).drop("n").mapInArrow(write, "n long")
        total += sum(row["n"] for row in made.collect())
    return total


def write_region(voxels: DataFrame, uri: str, r: int = 0) -> int:
    """Put voxels (t, c, z, y, x, v) into a group made before; what they don't cover stays. The number of chunks touched.

    All voxels of a chunk meet in one task, which lays them over what the chunk holds, so regions need not be whole chunks.
    """
    array = next(a for a in group_arrays(uri) if a.r == r)
    if array.rank != 5 or array.chunk[:2] != (1, 1):
        raise ValueError("regions are written into arrays of t, c, z, y, x with one time and channel a chunk")
    top = DTYPES[array.dtype][2]

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        at = dict(zip(("t", "c", "cz", "cy", "cx"), (k.as_py() for k in key), strict=True))
        store = Store(uri)
        block = array.block(store.find(array.name(at)))[0, 0].copy()
        v = rows.column("v").to_numpy()
        place = tuple(rows.column(a).to_numpy() - at[f"c{a}"] * k for a, k in zip("zyx", array.chunk[2:], strict=True))
        block[place] = np.clip(v, 0, top) if array.code.kind == "u" else v
        store.write(array.name(at), compress(block.tobytes(order=array.head.get("order", "C")), array.codec, array.code.itemsize))
        return pa.table({"n": [1]})

    placed = with_chunks(voxels.select("t", "c", "z", "y", "x", "v"), array.chunk[2:])
    return placed.groupBy("t", "c", "cz", "cy", "cx").applyInArrow(merge, "n long").groupBy().sum("n").first()[0] or 0
