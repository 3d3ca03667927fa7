"""Imaris files of chunk payloads: a slab of chunks becomes one HDF5 file, written by one task.

Files have a superblock of version 0, groups as symbol tables, attributes in headers, and chunks, shuffled and deflated, under
version 1 B-trees: what every HDF5 library reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ArrayDataset
from ..operators.chunked import PLACE, ChunkGrid
from .hdf5 import ATTRIBUTE, DATASPACE, DATATYPE, DEFLATE, FILL, FILTERS, LAYOUT, NOWHERE, SHUFFLE, SIGNATURE, SYMBOLS
from .stores import Store

LEAF, INNER, CHUNKS = 8, 32, 64  # entries of a symbol node, a group's tree node, and a chunk tree node
BINS = 256


@dataclass
class Array:
    """A dataset: packed chunks by their numbers, or with ``chunk`` null one run of bytes."""

    shape: tuple[int, ...]
    dtype: np.dtype
    chunk: tuple[int, ...] | None = None
    data: Mapping[tuple[int, ...], bytes] | bytes = b""
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Group:
    members: dict[str, Group | Array] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)

    def at(self, path: str) -> Group:
        """The group of a path, made where it isn't there yet."""
        out = self
        for name in path.split("/"):
            out = out.members.setdefault(name, Group())
        return out


def pack(data: bytes, itemsize: int) -> bytes:
    return zlib.compress(np.frombuffer(data, np.uint8).reshape(-1, itemsize).T.tobytes(), 2)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _dataspace(shape: Sequence[int]) -> bytes:
    return struct.pack(f"<BBBx4x{len(shape)}Q", 1, len(shape), 0, *shape)


def _datatype(dtype: np.dtype) -> bytes:
    size = dtype.itemsize
    if dtype.kind == "S":
        return struct.pack("<B3xI", 0x13, size)
    if dtype.kind == "f":
        places = {4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}[size]
        sign, exponent, wide, low, mantissa, bias = places
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, size, 0, 8 * size, exponent, wide, low, mantissa, bias)
    return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)


class _File:
    def __init__(self) -> None:
        self.out = bytearray(96)

    def put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        self.out += data
        return len(self.out) - len(data)

    def header(self, messages: list[tuple[int, bytes]], attributes: dict[str, str]) -> int:
        for name, text in attributes.items():
            value, kind = text.encode(), _datatype(np.dtype("S1"))
            space, label = _dataspace([len(value)]), name.encode() + b"\0"
            messages.append((ATTRIBUTE, struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + _padded(label) + _padded(kind) + _padded(space) + value))
        body = b"".join(struct.pack("<HHB3x", kind, len(_padded(data)), 0) + _padded(data) for kind, data in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def tree(self, kind: int, width: int, entries: list[tuple[bytes, int]], last: bytes) -> int:
        """A B-tree of (key, child) pairs; the key after a node's last child is that of the next node, at the end ``last``. Keys of
        chunks are where they begin, those of groups the last name before a child."""
        level = 0
        while True:
            made = []
            for k in range(0, len(entries), width):
                part = entries[k : k + width]
                end = entries[k + width][0] if k + width < len(entries) else last
                body = b"".join(key + struct.pack("<Q", child) for key, child in part) + end
                whole = width * (len(last) + 8) + len(last)
                made.append((part[0][0], self.put(struct.pack("<4sBBHQQ", b"TREE", kind, level, len(part), NOWHERE, NOWHERE) + body.ljust(whole, b"\0"))))
            if len(made) == 1:
                return made[0][1]
            entries, level = made, level + 1

    def group(self, group: Group) -> tuple[int, int, int]:
        """Address of a group's header, its tree and its heap."""
        names = sorted(group.members)
        heap, at = bytearray(8), {}
        for name in names:
            at[name] = len(heap)
            heap += _padded(name.encode() + b"\0")
        found = [(at[n], self.member(group.members[n])) for n in names]
        nodes = []
        for k in range(0, max(len(found), 1), LEAF):
            part = found[k : k + LEAF]
            body = b"".join(struct.pack("<QQI4x16x", name, header, 0) for name, header in part)
            nodes.append((struct.pack("<Q", found[k - 1][0] if k else 0), self.put(struct.pack("<4sBxH", b"SNOD", 1, len(part)) + body.ljust(LEAF * 40, b"\0"))))
        tree = self.tree(0, INNER, nodes, struct.pack("<Q", found[-1][0] if found else 0))
        data = self.put(bytes(heap))
        held = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), 1, data))
        return self.header([(SYMBOLS, struct.pack("<QQ", tree, held))], group.attributes), tree, held

    def member(self, x: Group | Array) -> int:
        if isinstance(x, Group):
            return self.group(x)[0]
        messages = [(DATASPACE, _dataspace(x.shape)), (DATATYPE, _datatype(x.dtype)), (FILL, struct.pack("<BBBB", 2, 3, 0, 0))]
        if x.chunk is None:
            messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(x.data), len(x.data))))
            return self.header(messages, x.attributes)
        key = lambda size, place: struct.pack(f"<II{len(place) + 1}Q", size, 0, *place, 0)
        places = {at: [i * k for i, k in zip(at, x.chunk, strict=True)] for at in sorted(x.data)}
        entries = [(key(len(x.data[at]), place), self.put(x.data[at])) for at, place in places.items()]
        end = key(0, [-(-n // k) * k for n, k in zip(x.shape, x.chunk, strict=True)])
        root = self.tree(1, CHUNKS, entries, end) if entries else NOWHERE
        messages.append((LAYOUT, struct.pack(f"<BBBQ{len(x.chunk) + 1}I", 3, 2, len(x.chunk) + 1, root, *x.chunk, x.dtype.itemsize)))
        messages.append((FILTERS, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, x.dtype.itemsize) + struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, 2)))
        return self.header(messages, x.attributes)


def encode(root: Group) -> bytes:
    """The bytes of a file."""
    file = _File()
    header, tree, heap = file.group(root)
    end = file.put(b"")
    file.out[:96] = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, LEAF // 2, INNER // 2, 0) + struct.pack("<QQQQ", 0, NOWHERE, end, NOWHERE) + struct.pack("<QQI4xQQ", 0, header, 1, tree, heap)
    return bytes(file.out)


def imaris_group(times: int, channels: int, shape: Sequence[int], extent: Sequence[float]) -> Group:
    """An Imaris file of one level without voxels; ``extent`` is the size of the image in z, y, x."""
    root = Group()
    image = root.at("DataSetInfo/Image").attributes
    image |= {a: str(n) for a, n in zip("ZYX", shape, strict=True)} | {f"ExtMin{i}": "0" for i in range(3)} | {f"ExtMax{i}": repr(float(e)) for i, e in zip((2, 1, 0), extent, strict=True)}
    for t in range(times):
        for c in range(channels):
            root.at(f"DataSet/ResolutionLevel 0/TimePoint {t}/Channel {c}").attributes |= {f"ImageSize{a}": str(n) for a, n in zip("ZYX", shape, strict=True)}
    return root


def write_imaris_slabs(chunks: DataFrame, ds: ArrayDataset, uri: str, rows: int = 1, r: int = 0) -> DataFrame:
    """One Imaris file for every ``rows`` rows of chunks along z of a level: path, z, depth and bytes of each.

    A task holds the packed chunks of its slab, of all times and channels, until its file is written.
    """
    grid, level = ChunkGrid.of(ds, r), ds.level(r)
    depth = rows * level.chunk[0]

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = key[0].as_py()
        shape = (min(depth, level.shape[0] - slab * depth), *level.shape[1:])
        padded = tuple(-(-n // k) * k for n, k in zip(shape, level.chunk, strict=True))
        packed: dict[tuple[int, int], dict[tuple[int, ...], bytes]] = {(t, c): {} for t in range(ds.T) for c in range(ds.C)}
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.select([*PLACE, "codec", "payload"]).to_pylist():
                at = (row["cz"], row["cy"], row["cx"])
                block = grid.decode(row["payload"], row["codec"], at)
                whole = np.zeros(level.chunk, grid.code)
                whole[tuple(slice(n) for n in block.shape)] = block
                packed[row["t"], row["c"]][(at[0] - slab * rows, *at[1:])] = pack(whole.tobytes(), grid.code.itemsize)
                if grid.code.kind == "u":
                    held = seen.setdefault((row["t"], row["c"]), np.zeros(1 << 8 * grid.code.itemsize, np.int64))
                    held += np.bincount(block.ravel(), minlength=len(held))
        root = imaris_group(ds.T, ds.C, shape, [n * v for n, v in zip(shape, level.resolution, strict=True)])
        for (t, c), data in packed.items():
            place = root.at(f"DataSet/ResolutionLevel 0/TimePoint {t}/Channel {c}")
            place.members["Data"] = Array(padded, grid.code, tuple(level.chunk), data)
            held = seen.get((t, c))
            if held is not None and held.any():
                values = np.flatnonzero(held)
                low, high = int(values[0]), int(values[-1])
                counted, _ = np.histogram(values, BINS, (low, max(high, low + 1)), weights=held[values])
                place.attributes |= {"HistogramMin": f"{low:.3f}", "HistogramMax": f"{high:.3f}"}
                place.members["Histogram"] = Array((BINS,), np.dtype("<u8"), None, counted.astype("<u8").tobytes())
        data = encode(root)
        name = f"z{slab * depth:08d}.ims"
        Store(uri).write(name, data)
        yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "z": pa.array([slab * depth], pa.int32()), "depth": pa.array([shape[0]], pa.int32()), "bytes": [len(data)]})

    dealt = chunks.where(F.col("r") == r).withColumn("slab", F.floor(F.col("cz") / rows).cast("int"))
    return dealt.groupBy("slab").applyInArrow(write, "path string, z int, depth int, bytes long")
