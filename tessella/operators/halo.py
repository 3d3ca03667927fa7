"""Filters on chunk tables: each chunk gets the faces, edges and corners of its neighbours, not their voxels as rows.

A chunk sends each neighbour the part of itself that lies within ``width`` of it, as packed bytes. These halos meet by chunk, at most a
shell of ``width`` around it, and are joined with the chunk itself; so what is sent for the neighbours grows with the surface of
chunks. The chunk's own payload is sent once, encoded as it is stored, or not at all if the table is bucketed by chunk (``bucketed``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DTYPES
from ..session import scratch_path
from .chunked import PIECE, PLACE, ChunkGrid, _chunk_batch, _read, blocks
from .encode import CHUNK_FIELDS
from .neighborhood import gaussian_weights, shifted

MODES = {"reflect": "symmetric", "nearest": "edge", "zero": "constant"}


def bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    """The table, written into the shared folder in buckets by chunk: later joins by chunk leave it where it lies."""
    spark, name = chunks.sparkSession, f"chunks_{uuid.uuid4().hex}"
    chunks.write.bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _shell(at: Sequence[int], grid: ChunkGrid, width: int) -> tuple[list[int], list[int]]:
    """First place, and the one after the last, of a chunk and what lies within ``width`` of it."""
    return [max(0, i * k - width) for i, k in zip(at, grid.chunk, strict=True)], [min(n, i * k + m + width) for i, k, m, n in zip(at, grid.chunk, grid.inside(at), grid.shape, strict=True)]


def halos(chunks: DataFrame, grid: ChunkGrid, width: int) -> DataFrame:
    """The pieces that chunks send their neighbours: for which chunk, where in its shell, and their voxels."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int32()] * 6 + [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    last = [-(-n // k) - 1 for n, k in zip(grid.shape, grid.chunk, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, block in blocks(batches, grid):
            low = grid.low(at[3:])
            high = [b + n for b, n in zip(low, block.shape, strict=True)]
            near = (range(max(0, (b - width) // k), min(m, (e - 1 + width) // k) + 1) for b, e, k, m in zip(low, high, grid.chunk, last, strict=True))
            rows = []
            for other in product(*near):
                if other != at[3:]:
                    first, end = _shell(other, grid, width)
                    begin, stop = [max(a, b) for a, b in zip(low, first, strict=True)], [min(a, b) for a, b in zip(high, end, strict=True)]
                    piece = block[tuple(slice(a - b, c - b) for a, c, b in zip(begin, stop, low, strict=True))]
                    if piece.size:
                        rows.append((*at[:3], *other, [a - b for a, b in zip(begin, first, strict=True)], list(piece.shape), np.ascontiguousarray(piece).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _read(chunks).mapInArrow(run, PIECE)


def map_chunks(chunks: DataFrame, grid: ChunkGrid, fn: Callable[[np.ndarray], np.ndarray], width: int = 0, boundary: str = "reflect", dtype: str | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """``fn`` over chunks as float arrays with ``width`` voxels of their neighbours around them, which are cut off again.

    Beyond the volume: mirrored ("reflect", border repeated), the border continued ("nearest") or zeros ("zero"). A chunk that is
    not there holds zeros; it has a result if any neighbour is there, so ``fn`` should make zeros of zeros. Whole numbers are
    rounded half to even and kept within the type.
    """
    target, mode = replace(grid, dtype=dtype or grid.dtype, cut=False), MODES[boundary]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                *at, codec_in, payload, halo = (batch.column(i)[row] for i in range(9))
                at = tuple(x.as_py() for x in at)
                low, high = _shell(at[3:], grid, width)
                block = np.zeros([b - a for a, b in zip(low, high, strict=True)])
                begin, size = [b - a for a, b in zip(low, grid.low(at[3:]), strict=True)], grid.inside(at[3:])
                if payload.is_valid:
                    block[tuple(slice(b, b + n) for b, n in zip(begin, size, strict=True))] = grid.decode(payload.as_buffer(), codec_in.as_py(), at[3:])
                for piece in halo if halo.is_valid else ():
                    shape = piece["size"].as_py()
                    block[tuple(slice(b, b + n) for b, n in zip(piece["low"].as_py(), shape, strict=True))] = np.frombuffer(piece["payload"].as_buffer(), grid.code).reshape(shape)
                pads = [(width - b, width - (h - b - n)) for b, n, h in zip(begin, size, block.shape, strict=True)]
                made = fn(np.pad(block, pads, mode=mode))[tuple(slice(width, width + n) for n in size)]
                if target.code.kind == "u":
                    made = np.clip(np.rint(made), 0, DTYPES[target.dtype][2])
                yield _chunk_batch(at, made.astype(target.code), target, codec, made.size)

    shells = halos(chunks, grid, width).groupBy(*PLACE).agg(F.collect_list(F.struct("low", "size", "payload")).alias("halo")) if width else None
    if shells is None:
        both = _read(chunks).withColumn("halo", F.lit(None).cast("array<struct<low:array<int>,size:array<int>,payload:binary>>"))
    else:
        both = _read(chunks).join(shells, PLACE, "full")
    return both.select(*PLACE, "codec", "payload", "halo").mapInArrow(run, CHUNK_FIELDS), target


def gaussian_chunks(chunks: DataFrame, grid: ChunkGrid, sigma: float, truncate: float = 4.0, dtype: str | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """Gaussian blur with the border voxel continued outside."""
    weights = gaussian_weights(sigma, truncate)

    def blur(block: np.ndarray) -> np.ndarray:
        for axis in range(3):
            block = shifted(block, axis, weights)
        return block

    return map_chunks(chunks, grid, blur, len(weights) // 2, "nearest", dtype, codec)


def box_chunks(chunks: DataFrame, grid: ChunkGrid, radius: int = 1, dtype: str | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """Sum of each voxel's cube of neighbours, zeros outside."""

    def total(block: np.ndarray) -> np.ndarray:
        for axis in range(3):
            block = shifted(block, axis, [1.0] * (2 * radius + 1))
        return block

    return map_chunks(chunks, grid, total, radius, "zero", dtype, codec)
