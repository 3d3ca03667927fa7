"""Chunk payloads: dense arrays assembled from voxels and encoded as bytes, one row a chunk."""

from __future__ import annotations

import io
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DTYPES, dtype_code
from ..sources import blosc
from .grid import with_chunks

CODECS = ("null", "zlib", "zstd", "blosc")
CHUNK_FIELDS = "r int, t int, c int, cz int, cy int, cx int, dtype string, codec string, payload binary, n long"


def compress(data: bytes, codec: str, itemsize: int = 1) -> bytes:
    if codec == "null":
        return data
    if codec == "zlib":
        return zlib.compress(data, 6)
    if codec == "zstd":
        return pa.Codec("zstd", 3).compress(data, asbytes=True)
    if codec == "blosc":
        return blosc.encode(data, itemsize)
    raise ValueError(f"{codec} is none of {', '.join(CODECS)}")


def decompress(data: bytes, codec: str, size: int) -> bytes:
    """Also of codecs that are only read: gzip, and lz4 with its size before it."""
    if codec == "null":
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        return pa.Codec("zstd").decompress(data, size, asbytes=True)
    if codec == "blosc":
        return blosc.decode(data)
    if codec == "gzip":
        return zlib.decompress(data, 31)
    if codec == "lz4":
        return pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True)
    raise ValueError(f"{codec} is none of {', '.join(CODECS)}, gzip, lz4")


def chunks_of(voxels: DataFrame, chunk: Sequence[int], dtype: str, codec: str = "null", r: int = 0, shape: Sequence[int] | None = None, combine_channels: int = 0) -> DataFrame:
    """The chunk table of a volume (t, c, z, y, x, v): C-order bytes, zeros where voxels are missing.

    Chunks at the edge are full size, padded with zeros; with ``shape`` they are cut there instead. With
    ``combine_channels`` (their number) a payload holds all channels, channel first, and c is 0. ``n`` counts the voxels given.
    """
    chunk, code, shape = tuple(chunk), np.dtype(dtype_code(dtype)), tuple(shape) if shape else None
    top = DTYPES[dtype][2]
    placed = with_chunks(voxels, chunk)
    keys = ["t", "cz", "cy", "cx"] if combine_channels else ["t", "c", "cz", "cy", "cx"]

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        at = dict(zip(keys, (k.as_py() for k in key), strict=True))
        low = [at[f"c{a}"] * k for a, k in zip("zyx", chunk, strict=True)]
        size = [min(k, n - m) for k, n, m in zip(chunk, shape, low, strict=True)] if shape else list(chunk)
        block = np.zeros([max(combine_channels, 1), *size], code)
        channel = rows.column("c").to_numpy() if combine_channels else np.zeros(rows.num_rows, np.int64)
        v = rows.column("v").to_numpy()
        if code.kind == "u":
            v = np.clip(v, 0, top)
        block[(channel, *(rows.column(a).to_numpy() - m for a, m in zip("zyx", low, strict=True)))] = v
        row = {"r": [r], "t": [at["t"]], "c": [at.get("c", 0)], **{f"c{a}": [at[f"c{a}"]] for a in "zyx"}, "dtype": [dtype], "codec": [codec], "payload": [compress(block.tobytes(), codec, code.itemsize)], "n": [rows.num_rows]}
        kinds = [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(row.values(), kinds, strict=True)], list(row))

    return placed.select("t", "c", "z", "y", "x", "v", "cz", "cy", "cx").groupBy(*keys).applyInArrow(build, CHUNK_FIELDS)


def voxels_of(chunks: DataFrame, chunk: Sequence[int], shape: Sequence[int], dtype: str) -> DataFrame:
    """The inverse of ``chunks_of`` for padded chunks: voxels inside ``shape``."""
    chunk, shape, code = tuple(chunk), tuple(shape), np.dtype(dtype_code(dtype))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield voxel_batch(decompress(row["payload"], row["codec"], int(np.prod(chunk)) * code.itemsize), code, chunk, shape, row)

    kind = "int" if code.kind == "u" else "double"
    return chunks.mapInArrow(read, f"r int, t int, c int, z int, y int, x int, v {kind}, cz int, cy int, cx int")


def voxel_batch(data: bytes, code: np.dtype, chunk: tuple, shape: tuple, at: dict) -> pa.RecordBatch:
    return block_batch(np.frombuffer(data, code).reshape(chunk), shape, at)


def block_batch(block: np.ndarray, shape: tuple, at: dict) -> pa.RecordBatch:
    """Voxels of a chunk's block (z, y, x), what lies beyond the shape left out."""
    chunk = block.shape
    low = [at[f"c{a}"] * k for a, k in zip("zyx", chunk, strict=True)]
    block = block[tuple(slice(0, n - m) for n, m in zip(shape, low, strict=True))]
    index = np.indices(block.shape, np.int32).reshape(3, -1)
    n = block.size
    columns = [np.full(n, at[k], np.int32) for k in ("r", "t", "c")] + [i + np.int32(m) for i, m in zip(index, low, strict=True)]
    columns.append(block.ravel().astype(np.int32 if block.dtype.kind == "u" else np.float64))
    columns += [np.full(n, at[f"c{a}"], np.int32) for a in "zyx"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["r", "t", "c", "z", "y", "x", "v", "cz", "cy", "cx"])


def npy_payload(chunks: DataFrame, chunk: Sequence[int], codec: str = "zstd") -> DataFrame:
    """Payloads of unencoded chunks as compressed ``.npy`` files, with their raw and packed sizes."""
    chunk = tuple(chunk)

    def run(batches):
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("payload", "dtype")}
            made = []
            for payload, dtype in zip(batch.column(at["payload"]).to_pylist(), batch.column(at["dtype"]).to_pylist(), strict=True):
                held = io.BytesIO()
                np.save(held, np.frombuffer(payload, dtype_code(dtype)).reshape(-1, *chunk))
                made.append((len(held.getvalue()), compress(held.getvalue(), codec)))
            keys = [batch.column(i) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([c for _, c in made], pa.binary()), pa.array([n for n, _ in made], pa.int64()), pa.array([len(c) for _, c in made], pa.int64())], ["r", "t", "c", "cz", "cy", "cx", "payload", "raw_bytes", "packed_bytes"])

    return chunks.select("r", "t", "c", "cz", "cy", "cx", "dtype", "payload").mapInArrow(run, "r int, t int, c int, cz int, cy int, cx int, payload binary, raw_bytes long, packed_bytes long")


def planes(voxels: DataFrame, shape: Sequence[int], dtype: str) -> DataFrame:
    """One TIFF file (bytes) for each t, c and z."""
    from ..sources.tiff import encode

    _, y, x = shape
    code = np.dtype(dtype_code(dtype))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        plane = np.zeros((y, x), code)
        plane[rows.column("y").to_numpy(), rows.column("x").to_numpy()] = rows.column("v").to_numpy()
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([encode(plane)], pa.binary())], ["t", "c", "z", "tiff"])

    return voxels.select("t", "c", "z", "y", "x", F.col("v")).groupBy("t", "c", "z").applyInArrow(build, "t int, c int, z int, tiff binary")
