"""Arrays behind a service as chunk tables (``remote_array``): its metadata is fetched, predicates become the requests.

The driver asks the service once what it holds. Chunks that predicates on r, t, c and chunk numbers leave are dealt to partitions;
tasks ask for one chunk a request and try again, with growing pauses, where a service or the way to it fails for a while.
"""

from __future__ import annotations

import ast
import io
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import ArrayDataset, Level
from ..operators.chunked import PLACE, ChunkGrid
from ..operators.encode import CHUNK_FIELDS, decompress, voxels_of

TRIES, WAIT, TIMEOUT = 5, 0.2, 60
#: Requests of a partition, and how many partitions there may be beside that.
PARTITION_REQUESTS, MOST_PARTITIONS = 64, 20_000
METADATA, ARRAY = "/metadata/", "/array/"


def fetch(url: str, tries: int = TRIES, wait: float = WAIT) -> bytes:
    """What a URL holds; failures that may pass (of the way, of the server, too many requests) are tried again."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as f:
                return f.read()
        except urllib.error.HTTPError as e:
            if (e.code < 500 and e.code != 429) or k == tries - 1:
                raise OSError(f"{url} answers {e.code}") from None  # an HTTPError itself can't leave a worker
        except (OSError, TimeoutError):
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k)
    raise ValueError("at least one try")


def unpacked(data: bytes, codec: str) -> np.ndarray:
    """The array of a compressed ``.npy``."""
    if codec == "zstd":
        with pa.CompressedInputStream(pa.BufferReader(data), "zstd") as f:
            data = f.read()
    else:
        data = decompress(data, codec, 0)
    return np.load(io.BytesIO(data), allow_pickle=False)


def describe_remote(url: str) -> ArrayDataset:
    """The dataset that a service describes: numbers of levels, times and channels, and facts keyed by (level, time, channel, what)."""
    told = json.loads(fetch(url.rstrip("/").replace(ARRAY, METADATA, 1)))
    facts = {ast.literal_eval(k): v for k, v in told.items() if k.startswith("(")}
    levels = []
    for r in range(int(told["ResolutionLevels"])):
        fact = lambda what, r=r: facts[r, 0, 0, what]
        levels.append(Level(r, tuple(fact("shape")[-3:]), tuple(fact("chunks")[-3:]), tuple(float(v) for v in facts.get((r, 0, 0, "resolution"), (1.0, 1.0, 1.0)))))
    return ArrayDataset(url.rstrip("/").rpartition("/")[2], str(np.dtype(facts[0, 0, 0, "dtype"])), int(told["TimePoints"]), int(told["Channels"]), tuple(levels))


class _Requests(InputPartition):
    """Chunks ``begin`` to ``end`` (without it), in C order of the numbers that predicates left, of one level."""

    def __init__(self, r: int, numbers: list[list[int]], begin: int, end: int) -> None:
        self.r, self.numbers, self.begin, self.end = r, numbers, begin, end


class RemoteReader(DataSourceReader):
    def __init__(self, url: str, codec: str) -> None:
        self.url, self.codec, self.tests, self.ds = url.rstrip("/"), codec, [], describe_remote(url)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and len(f.attribute) == 1 and f.attribute[0] in PLACE:
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def _left(self, name: str, count: int) -> list[int]:
        return [i for i in range(count) if all(test(i, v) for k, test, v in self.tests if k == name)]

    def partitions(self) -> list[InputPartition]:
        plan = []
        for r in self._left("r", len(self.ds.levels)):
            plan.append((r, [self._left(k, n) for k, n in zip(PLACE[1:], (self.ds.T, self.ds.C, *self.ds.level(r).grid), strict=True)]))
        every = sum(math.prod(map(len, numbers)) for _, numbers in plan)
        step = max(PARTITION_REQUESTS, -(-every // MOST_PARTITIONS))
        out: list[InputPartition] = []
        for r, numbers in plan:
            n = math.prod(map(len, numbers))
            out += [_Requests(r, numbers, k, min(n, k + step)) for k in range(0, n, step)]
        return out or [InputPartition(None)]

    def request(self, r: int, at: tuple[int, ...]) -> str:
        """The URL of a chunk's box."""
        low = [i * k for i, k in zip(at, self.ds.chunks(r), strict=True)]
        high = [min(b + k, n) for b, k, n in zip(low, self.ds.chunks(r), self.ds.shape(r), strict=True)]
        box = "&".join(f"{a}start={b}&{a}stop={e}&{a}step=1" for a, b, e in zip("tczyx", low, high, strict=True))
        return f"{self.url}?res={r}&{box}"

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Requests):
            return
        names, kinds = [f.split()[0] for f in CHUNK_FIELDS.split(", ")], [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
        grid, sizes = ChunkGrid.of(self.ds, partition.r), [len(n) for n in partition.numbers]
        for k in range(partition.begin, partition.end):
            at = tuple(n[int(i)] for n, i in zip(partition.numbers, np.unravel_index(k, sizes), strict=True))
            got = unpacked(fetch(self.request(partition.r, at)), self.codec)
            inside = grid.inside(at[2:])
            if got.size != math.prod(inside):
                raise ValueError(f"{self.request(partition.r, at)} answers {got.shape}, asked for {tuple(inside)}")
            row = [partition.r, *at, self.ds.dtype, "null", grid.encode(got.reshape(inside), "null", at[2:]), got.size]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)


class RemoteDataSource(DataSource):
    """Options: ``path``, the array's URL; ``codec`` of its answers."""

    @classmethod
    def name(cls) -> str:
        return "remote_array"

    def schema(self) -> str:
        return CHUNK_FIELDS

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(self.options["path"], self.options.get("codec", "zlib"))


def read_remote_array(spark: SparkSession, url: str, codec: str = "zlib") -> DataFrame:
    """The chunk table of all levels; ask for few of them by ``where``."""
    spark.dataSource.register(RemoteDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("remote_array").option("codec", codec).load(url)


def remote_voxels(spark: SparkSession, url: str, r: int = 0, codec: str = "zlib") -> DataFrame:
    """Voxels of a level."""
    grid = ChunkGrid.of(describe_remote(url), r)
    return voxels_of(read_remote_array(spark, url, codec).where(F.col("r") == r), grid.chunk, grid.shape, grid.dtype)
