"""Grey TIFF files of 8 or 16 bits, of one image or several, and stacks of such files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
#: Where a plane lies in a stack: T<t>/CH<c>/<file>.
STACK = r"/T(\d+)/CH(\d+)/([^/]+)$"


def encode(plane: np.ndarray, rows: int | None = None, deflate: bool = False) -> bytes:
    """One image of unsigned integers as a little-endian TIFF, in strips of so many rows (one strip if null)."""
    bits = plane.dtype.itemsize * 8
    y, x = plane.shape
    rows = min(rows or y, y)
    strips = [plane[k : k + rows].astype(plane.dtype.newbyteorder("<")).tobytes() for k in range(0, y, rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    out, offsets = bytearray(8), []
    for s in strips:
        offsets.append(len(out))
        out += s + b"\0" * (len(s) % 2)
    tags = [(WIDTH, 4, [x]), (LENGTH, 4, [y]), (BITS, 3, [bits]), (COMPRESSION, 3, [8 if deflate else 1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (ROWS, 4, [rows]), (COUNTS, 4, [len(s) for s in strips])]
    body = struct.pack("<H", len(tags))
    for tag, kind, values in tags:
        if len(values) == 1:
            body += struct.pack("<HHII", tag, kind, 1, values[0])
        else:
            body += struct.pack("<HHII", tag, kind, len(values), len(out))
            out += struct.pack(f"<{len(values)}I", *values)
    out[:8] = struct.pack("<2sHI", b"II", 42, len(out))
    return bytes(out) + body + struct.pack("<I", 0)


class Ranged:
    """A file's bytes, of which only the slices asked for are read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.read = file, 0

    def __getitem__(self, part: slice) -> bytes:
        begin = part.start or 0
        found = self.file.read_at(part.stop - begin, begin)
        self.read += len(found)
        return found


def _ifds(data: bytes | Ranged) -> tuple[str, list[dict[int, list[int]]]]:
    """Byte order and the tags of each image of a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, out = struct.unpack(f"{order}I", data[4:8])[0], []
    while at:
        n, tags = struct.unpack(f"{order}H", data[at : at + 2])[0], {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack(f"{order}HHI", data[entry : entry + 8])
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter is None:
                continue
            size = struct.calcsize(letter) * count
            place = entry + 8 if size <= 4 else struct.unpack(f"{order}I", data[entry + 8 : entry + 12])[0]
            tags[tag] = list(struct.unpack(f"{order}{count}{letter}", data[place : place + size]))
        out.append(tags)
        at = struct.unpack(f"{order}I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return order, out


def lzw(data: bytes) -> bytes:
    """What an LZW strip holds: codes of 9 to 12 bits, the highest first; 256 starts anew, 257 ends."""
    single = [bytes([i]) for i in range(256)]
    table, out, held, bits, width, last = single + [b"", b""], [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = single + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        # the writer's table is one entry ahead
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def page_count(data: bytes) -> int:
    return len(_ifds(data)[1])


def decode(data: bytes, page: int = 0) -> np.ndarray:
    """An image of a TIFF: grey, 8 or 16 bits, in strips, plain or compressed by LZW or deflate, with or without differencing."""
    order, pages = _ifds(data)
    return strips(data, order, pages[page])


def strip_rows(tags: dict[int, list[int]]) -> int:
    """Rows of a strip."""
    return min(tags.get(ROWS, tags[LENGTH])[0], tags[LENGTH][0])


def strips(data: bytes | Ranged, order: str, tags: dict[int, list[int]], first: int = 0, end: int | None = None) -> np.ndarray:
    """The rows of an image that strips from ``first`` up to ``end`` (without it) hold; only these are read."""
    kind, bits = tags.get(COMPRESSION, [1])[0], tags.get(BITS, [1])[0]
    if kind not in (1, 5, 8, 32946) or tags.get(SAMPLES, [1]) != [1] or bits not in (8, 16) or OFFSETS not in tags:
        raise ValueError("only grey images of 8 or 16 bits in strips are read, plain or compressed by LZW or deflate")
    unpack = {1: bytes, 5: lzw}.get(kind, zlib.decompress)
    held = b"".join(unpack(data[o : o + n]) for o, n in list(zip(tags[OFFSETS], tags[COUNTS], strict=True))[first:end])
    rows = np.frombuffer(held, f"{order}u{bits // 8}").reshape(-1, tags[WIDTH][0])
    if tags.get(PREDICTOR, [1]) == [2]:
        rows = np.cumsum(rows, axis=1, dtype=rows.dtype.newbyteorder("="))
    return rows


def planes_to_voxels(files: DataFrame) -> DataFrame:
    """``files`` (t, c, z, content) as voxels; the pages of a file follow each other in z."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c, z, content in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                for page in range(page_count(content)):
                    plane = decode(content, page)
                    y, x = np.indices(plane.shape, np.int32).reshape(2, -1)
                    same = [pa.array(np.full(plane.size, k, np.int32)) for k in (t, c, z + page)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(y), pa.array(x), pa.array(plane.ravel().astype(np.int32))], ["t", "c", "z", "y", "x", "v"])

    return files.select("t", "c", "z", "content").mapInArrow(read, "t int, c int, z int, y int, x int, v int")


def read_stack(spark: SparkSession, uri: str) -> DataFrame:
    """Voxels of a stack of planes: t and c from the folders, z from the rank of the file's name in its folder."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(uri)
    named = files.select("path", *(F.regexp_extract("path", STACK, i + 1).cast("int").alias(k) for i, k in enumerate("tc")))
    order = Window.partitionBy("t", "c").orderBy("path")
    ranked = named.withColumn("z", F.row_number().over(order) - 1)  # names alone; contents are joined afterwards
    return planes_to_voxels(files.select("path", "content").join(ranked, "path"))
