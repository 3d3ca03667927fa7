"""HDF5 files by ranged reads: groups, attributes, and the chunks of datasets as a Spark data source (``hdf5_chunks``).

The public file format is read directly: superblocks of versions 0 to 3, object headers of versions 1 and 2, groups as symbol tables or as
links in the header, attributes in the header, integers, floats and strings of fixed length, and datasets that are contiguous or lie in
chunks under a version 1 B-tree, raw or with the deflate, shuffle and checksum filters. Whatever else a file holds raises ``Hdf5Error``
where it is asked for.

A read lists datasets on the driver and walks the upper nodes of their trees until there are enough of them; each partition is some nodes,
whose leaves and chunks are read by tasks. Predicates on r, t, c and chunk numbers leave out datasets, subtrees and chunks.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..model import DTYPES, UnsupportedDtype
from ..operators.encode import CHUNK_FIELDS
from .stores import Store

#: Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x4, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1
PAGE, PAGES = 1 << 16, 256
#: Decoded bytes of a partition, how many tree nodes the driver looks at, and bytes of a slab of a contiguous dataset.
PARTITION_BYTES, MOST_NODES, SLAB_BYTES = 64 << 20, 20_000, 16 << 20


class Hdf5Error(ValueError):
    pass


class Bytes:
    """A message's bytes, read from the front."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Hdf5Error("the file ends within a structure")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def skip(self, n: int) -> Bytes:
        self.take(n)
        return self

    def align(self, n: int) -> None:
        self.at = -(-self.at // n) * n


@dataclass
class Dataset:
    """Where a dataset's voxels lie and how they are kept. ``chunk`` of a contiguous one is a slab, or null where it has no data."""

    path: str
    shape: tuple[int, ...]
    dtype: np.dtype
    chunk: tuple[int, ...]
    address: int | None
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    contiguous: bool = False
    fill: float = 0
    inline: bytes | None = None

    @property
    def chunk_bytes(self) -> int:
        return math.prod(self.chunk) * self.dtype.itemsize

    def decode(self, data: bytes, mask: int = 0) -> bytes:
        for i in reversed(range(len(self.filters))):
            if mask >> i & 1:
                continue
            kind, values = self.filters[i]
            if kind == CHECKSUM:
                data = data[:-4]
            elif kind == DEFLATE:
                data = zlib.decompress(data)
            elif kind == SHUFFLE:
                size = values[0] if values else self.dtype.itemsize
                whole = len(data) // size * size
                data = np.frombuffer(data, np.uint8, whole).reshape(size, -1).T.tobytes() + data[whole:]
            else:
                raise Hdf5Error(f"{self.path} has filter {kind}, which is not read")
        return data


class Hdf5File:
    """A file of a store, read in pages that are kept for a while."""

    def __init__(self, uri: str) -> None:
        folder, _, name = uri.rpartition("/")
        store = Store(folder or ".")
        self.uri, self.file = uri, store.open(name)
        self.size, self.pages = self.file.size(), {}
        self.offsets, self.lengths, self.base = 8, 8, 0
        self.root = self._superblock()

    def at(self, address: int, n: int) -> bytes:
        """Bytes of the file, all of them."""
        found = self.upto(address, n)
        if len(found) < n:
            raise Hdf5Error(f"{self.uri} ends within a structure")
        return found

    def upto(self, address: int, n: int) -> bytes:
        """At most so many bytes; long runs are read as such, short ones by pages."""
        address += self.base
        if n > PAGE:
            return self.file.read_at(n, address)
        out = b""
        for page in range(address // PAGE, (address + n - 1) // PAGE + 1):
            if page not in self.pages:
                if len(self.pages) >= PAGES:
                    self.pages.clear()
                self.pages[page] = self.file.read_at(PAGE, page * PAGE)
            out += self.pages[page]
        begin = address % PAGE
        return out[begin : begin + n]

    def _superblock(self) -> int:
        place = 0
        while place + 96 <= max(self.size, 96):
            head = self.file.read_at(min(128, max(0, self.size - place)), place)
            if head[:8] == SIGNATURE:
                break
            place = place * 2 or 512
        else:
            raise Hdf5Error(f"{self.uri} is no HDF5 file")
        b, version = Bytes(head, 9), head[8]
        if version in (0, 1):
            b.skip(4)
            self.offsets, self.lengths = b.number(1), b.number(1)
            b.skip(9 + 4 * version)
            self.base = b.number(self.offsets)
            b.skip(3 * self.offsets + self.offsets)
            return b.number(self.offsets)
        if version in (2, 3):
            self.offsets, self.lengths = b.number(1), b.number(1)
            b.skip(1)
            self.base = b.number(self.offsets)
            return b.skip(2 * self.offsets).number(self.offsets)
        raise Hdf5Error(f"{self.uri} has a superblock of version {version}")

    def _address(self, b: Bytes) -> int | None:
        value = b.number(self.offsets)
        return None if value == NOWHERE >> (64 - 8 * self.offsets) else value

    # objects

    def messages(self, address: int) -> Iterator[tuple[int, int, bytes]]:
        """(type, flags, data) of an object's header and its continuations."""
        head = self.upto(address, 64)
        if head[:4] == b"OHDR":
            b = Bytes(head, 5)
            flags = b.number(1)
            b.skip(16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1))
            size = b.number(1 << (flags & 3))
            todo, tagged = [(address + b.at, size, 0)], 2 * (flags >> 2 & 1)
        elif head[:1] == b"\1" and len(head) >= 12:
            todo, tagged = [(address + 16, int.from_bytes(head[8:12], "little"), 0)], None
        else:
            raise Hdf5Error(f"{self.uri} has no object at {address}")
        while todo:
            begin, size, skipped = todo.pop(0)
            b = Bytes(self.at(begin, size), skipped)
            least = 8 if tagged is None else 4 + tagged
            while b.at + least <= size:
                if tagged is None:
                    kind, n, flags = b.number(2), b.number(2), b.number(1)
                    b.skip(3)
                else:
                    kind, n, flags = b.number(1), b.number(2), b.number(1)
                    b.skip(tagged)
                data = b.take(n)
                if kind == CONTINUATION:
                    more = Bytes(data)
                    where, length = more.number(self.offsets), more.number(self.lengths)
                    todo.append((where, length, 0) if tagged is None else (where, length - 4, 4))
                else:
                    yield kind, flags, data

    def links(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds."""
        out: dict[str, int] = {}
        for kind, _, data in self.messages(address):
            b = Bytes(data)
            if kind == SYMBOLS:
                tree, heap = b.number(self.offsets), b.number(self.offsets)
                out |= self._symbols(tree, heap)
            elif kind == LINK:
                flags = b.skip(1).number(1)
                sort = b.number(1) if flags & 8 else 0
                b.skip(8 * (flags >> 2 & 1) + (flags >> 4 & 1))
                name = b.take(b.number(1 << (flags & 3))).decode()
                if sort == 0:
                    out[name] = b.number(self.offsets)
            elif kind == LINK_INFO:
                flags = b.skip(1).number(1)
                b.skip(8 * (flags & 1))
                if self._address(b) is not None:
                    raise Hdf5Error(f"{self.uri} keeps a group's links in a heap, which is not read")
        return out

    def _symbols(self, tree: int, heap: int) -> dict[str, int]:
        b = Bytes(self.at(heap, 8 + 2 * self.lengths + self.offsets))
        if b.take(4) != b"HEAP":
            raise Hdf5Error(f"{self.uri} has no heap at {heap}")
        size = b.skip(4).number(self.lengths)
        names = self.at(b.skip(self.lengths).number(self.offsets), size)
        out, todo = {}, [tree]
        while todo:
            node = todo.pop()
            if self.at(node, 4) == b"SNOD":
                n = int.from_bytes(self.at(node + 6, 2), "little")
                entry = 2 * self.offsets + 24
                b = Bytes(self.at(node + 8, n * entry))
                for _ in range(n):
                    name, header = b.number(self.offsets), b.number(self.offsets)
                    b.skip(24)
                    out[names[name : names.index(b"\0", name)].decode()] = header
            else:
                todo += [child for _, child in self._node(node, self.lengths)[1]]
        return out

    def _node(self, address: int, key: int) -> tuple[int, list[tuple[bytes, int]]]:
        """Level, and (key, child) pairs, of a version 1 B-tree node with keys of that many bytes."""
        head = self.at(address, 8 + 2 * self.offsets)
        if head[:4] != b"TREE":
            raise Hdf5Error(f"{self.uri} has no tree at {address}")
        n = int.from_bytes(head[6:8], "little")
        b, out = Bytes(self.at(address + len(head), n * (key + self.offsets))), []
        for _ in range(n):
            out.append((b.take(key), b.number(self.offsets)))
        return head[5], out

    def find(self, path: str) -> int | None:
        """An object's address by its path; null if nothing bears it."""
        address = self.root
        for name in path.strip("/").split("/"):
            address = self.links(address).get(name) if name else address
            if address is None:
                return None
        return address

    def attributes(self, path: str) -> dict[str, object]:
        """An object's attributes: text (also of arrays of single characters), numbers or arrays."""
        address, out = self.find(path), {}
        if address is None:
            raise Hdf5Error(f"{self.uri} has no {path}")
        for kind, flags, data in self.messages(address):
            if kind == ATTRIBUTE_INFO:
                b = Bytes(data, 1)
                flags = b.number(1)
                b.skip(2 * (flags & 1))
                if self._address(b) is not None:
                    raise Hdf5Error(f"{path} keeps its attributes in a heap, which is not read")
            if kind != ATTRIBUTE:
                continue
            version, step = data[0], 8 if data[0] == 1 else 1
            b = Bytes(data, 2)
            sizes = [b.number(2) for _ in range(3)]
            b.skip(version == 3)
            parts = []
            for n in sizes:
                parts.append(b.take(n))
                b.skip(-n % step)
            if data[1] & 3 and version > 1:
                raise Hdf5Error(f"{path} shares types among attributes, which is not read")
            try:
                dtype, shape = self._dtype(parts[1]), self._shape(parts[2])
            except Hdf5Error:
                continue  # of a kind that is not read; it is missing only where it is asked for
            value = np.frombuffer(b.take(math.prod(shape) * dtype.itemsize), dtype).reshape(shape)
            if dtype.kind == "S":
                text = value.tobytes() if dtype.itemsize == 1 else value.ravel()[0] if value.size else b""
                value = text.rstrip(b"\0").decode("utf-8", "replace")
            elif not shape:
                value = value.item()
            out[parts[0].split(b"\0")[0].decode()] = value
        return out

    def _dtype(self, data: bytes) -> np.dtype:
        kind, bits, size = data[0] & 15, data[1], int.from_bytes(data[4:8], "little")
        order = ">" if bits & 1 else "<"
        if kind == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        if kind == 1 and size in (2, 4, 8):
            return np.dtype(f"{order}f{size}")
        if kind == 3:
            return np.dtype(f"S{size}")
        raise Hdf5Error(f"{self.uri} has a type of class {kind} and {size} bytes, which is not read")

    def _shape(self, data: bytes) -> tuple[int, ...]:
        b = Bytes(data, 1)
        rank = b.number(1)
        b.skip(6 if data[0] == 1 else 2)
        return tuple(b.number(self.lengths) for _ in range(rank))

    def dataset(self, path: str) -> Dataset:
        address = self.find(path)
        if address is None:
            raise Hdf5Error(f"{self.uri} has no {path}")
        found = {}
        for kind, flags, data in self.messages(address):
            if kind in (DATASPACE, DATATYPE, LAYOUT, FILTERS, FILL, OLD_FILL):
                if flags & 2:
                    raise Hdf5Error(f"{path} shares a message, which is not read")
                found[kind] = data
        if not {DATASPACE, DATATYPE, LAYOUT} <= set(found):
            raise Hdf5Error(f"{path} is no dataset")
        shape, dtype = self._shape(found[DATASPACE]), self._dtype(found[DATATYPE])
        fill, filters = self._fill(found, dtype), self._filters(found.get(FILTERS, b""))
        b = Bytes(found[LAYOUT])
        if (version := b.number(1)) != 3:
            raise Hdf5Error(f"{path} has a layout of version {version}, which is not read")
        kind = b.number(1)
        if kind == 2:
            rank = b.number(1)
            tree = self._address(b)
            return Dataset(path, shape, dtype, tuple(b.number(4) for _ in range(rank - 1)), tree, filters, fill=fill)
        slab = (max(1, min(shape[0], SLAB_BYTES // max(1, math.prod(shape[1:]) * dtype.itemsize))), *shape[1:]) if shape else ()
        if kind == 1:
            return Dataset(path, shape, dtype, slab, self._address(b), contiguous=True, fill=fill)
        if kind == 0:
            return Dataset(path, shape, dtype, shape, None, contiguous=True, fill=fill, inline=b.take(b.number(2)))
        raise Hdf5Error(f"{path} is laid out in a way ({kind}) that is not read")

    def _fill(self, found: dict[int, bytes], dtype: np.dtype) -> float:
        data, value = found.get(FILL), b""
        if data is not None:
            b = Bytes(data)
            version = b.number(1)
            if version == 3:
                value = b.take(b.number(4)) if b.number(1) & 32 else b""
            elif b.skip(2).number(1) or version == 1:
                value = b.take(b.number(4))
        elif OLD_FILL in found:
            b = Bytes(found[OLD_FILL])
            value = b.take(b.number(4))
        return np.frombuffer(value, dtype)[0].item() if len(value) == dtype.itemsize and dtype.kind != "S" else 0

    def _filters(self, data: bytes) -> list[tuple[int, list[int]]]:
        if not data:
            return []
        b, out = Bytes(data), []
        version, n = b.number(1), b.number(1)
        b.skip(6 if version == 1 else 0)
        for _ in range(n):
            kind = b.number(2)
            name = b.number(2) if version == 1 or kind >= 256 else 0
            count = b.skip(2).number(2)
            b.skip(-(-name // 8) * 8 if version == 1 else name)
            out.append((kind, [b.number(4) for _ in range(count)]))
            b.skip(4 * (count % 2) if version == 1 else 0)
        return out

    # chunks

    def nodes(self, d: Dataset, most: int, passes) -> list[tuple[int, int]]:
        """(level, address) of tree nodes that together hold all chunks, as many as may keep tasks busy and at most some ``most``."""
        if d.address is None:
            return []
        level, _ = self._node(d.address, 0)
        found = [d.address]
        while level and len(found) * 64 <= most:
            found = [child for node in found for child in self._children(d, node, passes)]
            level -= 1
        return [(level, node) for node in found]

    def _key(self, d: Dataset) -> int:
        return 8 + 8 * (len(d.shape) + 1)

    def _children(self, d: Dataset, node: int, passes) -> list[int]:
        """Inner nodes below a node whose range of first-axis places may hold chunks that pass."""
        _, pairs = self._node(node, self._key(d))
        first = [int.from_bytes(k[8:16], "little") // d.chunk[0] for k, _ in pairs]
        ends = [*first[1:], -(-d.shape[0] // d.chunk[0]) - 1]
        return [child for (_, child), a, z in zip(pairs, first, ends, strict=True) if passes(0, range(a, max(a, z) + 1))]

    def chunks(self, d: Dataset, level: int, node: int, passes) -> Iterator[tuple[tuple[int, ...], bytes]]:
        """(chunk numbers, decoded bytes) of the chunks below a node."""
        if level:
            for child in self._children(d, node, passes):
                yield from self.chunks(d, level - 1, child, passes)
            return
        for key, child in self._node(node, self._key(d))[1]:
            size, mask, *place = struct.unpack(f"<II{len(d.shape)}Q", key[: 8 + 8 * len(d.shape)])
            at = tuple(p // k for p, k in zip(place, d.chunk, strict=True))
            if all(passes(i, [n]) for i, n in enumerate(at)):
                yield at, d.decode(self.at(child, size), mask)

    def slab(self, d: Dataset, number: int) -> bytes:
        """One slab of a contiguous dataset, as long as the dataset goes."""
        row = math.prod(d.shape[1:]) * d.dtype.itemsize
        begin, end = number * d.chunk[0] * row, min((number + 1) * d.chunk[0], d.shape[0]) * row
        if d.inline is not None:
            return d.inline[begin:end]
        return self.at(d.address, d.shape[0] * row)[begin:end] if end - begin < PAGE and d.shape[0] * row < PAGE else self.file.read_at(end - begin, self.base + d.address + begin)

    def array(self, path: str) -> np.ndarray:
        """A small dataset as a whole, such as a stored histogram."""
        d = self.dataset(path)
        if d.contiguous:
            data = b"".join(self.slab(d, k) for k in range(-(-d.shape[0] // d.chunk[0]))) if d.address is not None or d.inline is not None else b""
            return np.frombuffer(data, d.dtype).reshape(d.shape) if data else np.full(d.shape, d.fill, d.dtype)
        out = np.full(d.shape, d.fill, d.dtype)
        for level, node in self.nodes(d, 1, lambda i, n: True):
            for at, data in self.chunks(d, level, node, lambda i, n: True):
                block = np.frombuffer(data, d.dtype).reshape(d.chunk)
                low = [i * k for i, k in zip(at, d.chunk, strict=True)]
                part = out[tuple(slice(b, b + k) for b, k in zip(low, d.chunk, strict=True))]
                part[...] = block[tuple(slice(n) for n in part.shape)]
        return out


# the data source


class _Nodes(InputPartition):
    """Tree nodes, or slabs, of one dataset."""

    def __init__(self, place: tuple[int, int, int], dataset: Dataset, nodes: list[tuple[int, int]]) -> None:
        self.place, self.dataset, self.nodes = place, dataset, nodes


class Hdf5Reader(DataSourceReader):
    """``datasets``: paths of arrays of z, y, x with their r, t and c, and the shape that counts (what lies beyond is padding)."""

    def __init__(self, uri: str, datasets: list[tuple[int, int, int, str, tuple[int, int, int] | None]]) -> None:
        self.uri, self.datasets, self.tests = uri, datasets, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and len(f.attribute) == 1 and f.attribute[0] in ("r", "t", "c", "cz", "cy", "cx"):
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def _passes(self, name: str, numbers: range | list[int]) -> bool:
        tests = [(test, v) for k, test, v in self.tests if k == name]
        return not tests or any(all(test(n, v) for test, v in tests) for n in numbers)

    def _axis(self, i: int, numbers: range | list[int]) -> bool:
        return self._passes(("cz", "cy", "cx")[i], numbers)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        file = Hdf5File(self.uri)
        wanted = [x for x in self.datasets if all(self._passes(k, [v]) for k, v in zip(("r", "t", "c"), x, strict=False))]
        for r, t, c, path, _ in wanted:
            d = file.dataset(path)
            check(d)
            if d.contiguous:
                there = d.address is not None or d.inline is not None
                nodes = [(0, k) for k in range(-(-d.shape[0] // d.chunk[0])) if self._passes("cz", [k])] if there else []
                step = max(1, PARTITION_BYTES // max(1, d.chunk_bytes))
            else:
                nodes = file.nodes(d, max(64, MOST_NODES // len(wanted)), self._axis)
                step = max(1, PARTITION_BYTES // (d.chunk_bytes * 64 ** (nodes[0][0] + 1))) if nodes else 1
            out += [_Nodes((r, t, c), d, nodes[k : k + step]) for k in range(0, len(nodes), step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Nodes):
            return
        file, d = Hdf5File(self.uri), partition.dataset
        shape = next(s for *place, _, s in self.datasets if tuple(place) == partition.place) or d.shape
        name = check(d)
        little = np.dtype(DTYPES[name][0])
        names, kinds = [f.split()[0] for f in CHUNK_FIELDS.split(", ")], [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
        for level, node in partition.nodes:
            found = [((node, 0, 0), file.slab(d, node))] if d.contiguous else file.chunks(d, level, node, self._axis)
            for at, data in found:
                inside = [max(0, min(k, n - i * k)) for i, k, n in zip(at, d.chunk, shape, strict=True)]
                if not math.prod(inside) or not (self._axis(1, [at[1]]) and self._axis(2, [at[2]])):
                    continue
                if d.dtype != little:
                    data = np.frombuffer(data, d.dtype).astype(little).tobytes()
                data += b"\0" * (d.chunk_bytes - len(data))  # the last slab
                row = [*partition.place, *at, name, "null", data, math.prod(inside)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def check(d: Dataset) -> str:
    """The name of a dataset's type, if its chunks can be rows of a chunk table."""
    if len(d.shape) != 3:
        raise Hdf5Error(f"{d.path} has {len(d.shape)} axes; arrays of z, y, x are read")
    name = {np.dtype(v[0]): k for k, v in DTYPES.items()}.get(d.dtype.newbyteorder("<"))
    if name is None:
        raise UnsupportedDtype(f"{d.path} holds {d.dtype}")
    if d.fill:
        raise Hdf5Error(f"{d.path} is filled with {d.fill} where it has no chunks; only 0 is read")
    for kind, _ in d.filters:
        if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
            raise Hdf5Error(f"{d.path} has filter {kind}, which is not read")
    return name


class Hdf5DataSource(DataSource):
    """Options: ``path``; ``layout`` imaris, or ``dataset``, the path of one array."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_chunks"

    def schema(self) -> str:
        return CHUNK_FIELDS

    def reader(self, schema: StructType) -> Hdf5Reader:
        from .imaris import datasets

        uri, one = self.options["path"], self.options.get("dataset")
        return Hdf5Reader(uri, [(0, 0, 0, one, None)] if one else datasets(uri))


def read_hdf5(spark: SparkSession, uri: str, dataset: str | None = None) -> DataFrame:
    """The chunk table of one array of a file, or of all of an Imaris file."""
    spark.dataSource.register(Hdf5DataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("hdf5_chunks")
    return (reader.option("dataset", dataset) if dataset else reader).load(uri)
