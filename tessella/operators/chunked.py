"""Operators on chunk tables: payloads are cut, reduced and joined as arrays, and no voxel becomes a row.

A chunk table has r, t, c, cz, cy, cx, dtype, codec and payload (``operators.encode.chunks_of``); a chunk that is not there holds zeros
and is not counted. Reductions add up in the tasks that decode payloads, so only their sums are shuffled. What makes new chunks
cuts payloads into pieces, one for each new chunk that they touch, and pastes the pieces of a new chunk together in one
task, which holds that chunk and its pieces. Where each old chunk yields whole new ones, pieces are pasted
where they were cut, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DTYPES, ArrayDataset, Level, dtype_code
from ..session import materialize
from .encode import CHUNK_FIELDS, compress, decompress
from .reduce import KEYS
from .slicing import AxisSlice, SliceSpec

PLACE = ["r", "t", "c", "cz", "cy", "cx"]
PIECE = "r int, t int, c int, cz int, cy int, cx int, low array<int>, size array<int>, payload binary"


@dataclass(frozen=True)
class ChunkGrid:
    """Shape and chunk shape in z, y, x of a level. Payloads at the end of an axis are full size, or with ``cut`` as long as the axis."""

    shape: tuple[int, int, int]
    chunk: tuple[int, int, int]
    dtype: str
    cut: bool = False

    @classmethod
    def of(cls, ds: ArrayDataset, r: int = 0) -> ChunkGrid:
        level = ds.level(r)
        return cls(tuple(level.shape), tuple(level.chunk), ds.dtype)

    @property
    def code(self) -> np.dtype:
        return np.dtype(dtype_code(self.dtype))

    def low(self, at: Sequence[int]) -> list[int]:
        return [i * k for i, k in zip(at, self.chunk, strict=True)]

    def inside(self, at: Sequence[int]) -> list[int]:
        """Size of a chunk as far as it lies in the shape."""
        return [max(0, min(k, n - i * k)) for i, k, n in zip(at, self.chunk, self.shape, strict=True)]

    def decode(self, payload: bytes, codec: str, at: Sequence[int]) -> np.ndarray:
        size = self.inside(at)
        stored = size if self.cut else self.chunk
        raw = decompress(payload, codec, math.prod(stored) * self.code.itemsize)
        return np.frombuffer(raw, self.code).reshape(stored)[tuple(slice(n) for n in size)]

    def encode(self, block: np.ndarray, codec: str, at: Sequence[int]) -> bytes:
        """The payload of a block that may be short at the end of an axis."""
        size = tuple(self.inside(at)) if self.cut else self.chunk
        if block.shape != size:
            whole = np.zeros(size, self.code)
            whole[tuple(slice(n) for n in block.shape)] = block
            block = whole
        return compress(np.ascontiguousarray(block, self.code).tobytes(), codec, self.code.itemsize)


def blocks(batches: Iterator[pa.RecordBatch], grid: ChunkGrid) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(r, t, c, cz, cy, cx) and voxels of each chunk, one at a time. Columns: those six, codec, payload."""
    for batch in batches:
        for row in range(batch.num_rows):
            *at, codec, payload = (batch.column(i)[row] for i in range(8))
            at = tuple(x.as_py() for x in at)
            yield at, grid.decode(payload.as_buffer(), codec.as_py(), at[3:])


def _read(chunks: DataFrame) -> DataFrame:
    return chunks.select(*PLACE, "codec", "payload")


def _chunk_batch(at: Sequence[int], block: np.ndarray, grid: ChunkGrid, codec: str, n: int) -> pa.RecordBatch:
    values = [*at, grid.dtype, codec, grid.encode(block, codec, at[3:]), n]
    kinds = [pa.int32()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in CHUNK_FIELDS.split(", ")])


# cutting


def _cut(at: Sequence[int], grid: ChunkGrid, axes: Sequence[AxisSlice]) -> tuple[tuple[slice, ...], list[int], list[int]] | None:
    """What slices of z, y, x take of a chunk: slices in it, and first place and size in the result; null if nothing."""
    inner, low, size = [], [], []
    for begin, n, a in zip(grid.low(at), grid.inside(at), axes, strict=True):
        first = max(0, -(-(begin - a.start) // a.step))
        last = -(-(min(begin + n, a.stop) - a.start) // a.step)
        if last <= first:
            return None
        inner.append(slice(a.start + first * a.step - begin, min(begin + n, a.stop) - begin, a.step))
        low.append(first)
        size.append(last - first)
    return tuple(inner), low, size


def _touched(low: Sequence[int], size: Sequence[int], chunk: Sequence[int]) -> Iterator[tuple[tuple[int, ...], tuple[slice, ...], list[int]]]:
    """(new chunk, slices of a block that lies at ``low``, place in the new chunk) of each new chunk that the block touches."""
    for at in product(*(range(b // k, (b + n - 1) // k + 1) for b, n, k in zip(low, size, chunk, strict=True))):
        begin = [max(b, i * k) for b, i, k in zip(low, at, chunk, strict=True)]
        end = [min(b + n, (i + 1) * k) for b, n, i, k in zip(low, size, at, chunk, strict=True)]
        yield at, tuple(slice(x - b, y - b) for x, y, b in zip(begin, end, low, strict=True)), [x - i * k for x, i, k in zip(begin, at, chunk, strict=True)]


def _pieces(found: Iterator[tuple[tuple[int, ...], list[int], np.ndarray]], chunk: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Pieces of blocks (r, t, c), first place, voxels."""
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int32()] * 6 + [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    for head, low, block in found:
        rows = []
        for at, part, place in _touched(low, block.shape, chunk):
            piece = block[part]
            rows.append((*head, *at, place, list(piece.shape), np.ascontiguousarray(piece).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _paste(code: np.dtype, target: ChunkGrid, codec: str, finish: Callable[[np.ndarray, Sequence[int]], np.ndarray] | None) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the pieces of a new chunk, which arrive batch by batch: they fill it, or with ``finish`` are summed in it first."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [k.as_py() for k in key]
        block, n = np.zeros(target.inside(at[3:]), code), 0
        for batch in batches:
            low, size, payload = (batch.column(batch.schema.get_field_index(c)) for c in ("low", "size", "payload"))
            for row in range(batch.num_rows):
                shape = size[row].as_py()
                part = block[tuple(slice(b, b + k) for b, k in zip(low[row].as_py(), shape, strict=True))]
                piece = np.frombuffer(payload[row].as_buffer(), code).reshape(shape)
                n += piece.size
                if finish:
                    part += piece
                else:
                    part[...] = piece
        yield _chunk_batch(at, finish(block, at[3:]) if finish else block, target, codec, n)

    return run


def _make(chunks: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]], code: np.dtype, target: ChunkGrid, codec: str, local: bool, finish: Callable[[np.ndarray, Sequence[int]], np.ndarray] | None = None) -> DataFrame:
    """New chunks of blocks that ``made`` gets from payloads; ``local``: each block consists of whole new chunks."""
    if not local:
        pieces = _read(chunks).mapInArrow(lambda batches: _pieces(made(batches), target.chunk), PIECE)
        return pieces.groupBy(*PLACE).applyInArrow(_paste(code, target, codec, finish), CHUNK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, low, block in made(batches):
            for at, part, _ in _touched(low, block.shape, target.chunk):
                piece = block[part]
                yield _chunk_batch([*head, *at], finish(piece, at) if finish else piece, target, codec, piece.size)

    return _read(chunks).mapInArrow(run, CHUNK_FIELDS)


def _near(chunks: DataFrame, grid: ChunkGrid, axes: Sequence[AxisSlice]) -> DataFrame:
    """The chunks that slices of z, y, x touch, by predicates that prune files."""
    for name, k, a in zip(("cz", "cy", "cx"), grid.chunk, axes, strict=True):
        chunks = chunks.where(F.col(name).between(a.start // k, (a.stop - 1) // k) if a.stop > a.start else F.lit(False))
    return chunks


def slice_chunks(chunks: DataFrame, grid: ChunkGrid, spec: SliceSpec, chunk: Sequence[int] | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """A slice of t, c, z, y, x as chunks of its own, numbered from 0, and their grid; ``chunk`` is their shape (as before if null)."""
    times, channels, *space = spec.axes
    target = ChunkGrid(tuple(a.size for a in space), tuple(chunk or grid.chunk), grid.dtype)
    inside = _near(chunks.where(F.col("r") == spec.r), grid, space)
    for name, a in (("t", times), ("c", channels)):
        inside = inside.where((F.col(name) >= a.start) & (F.col(name) < a.stop) & (F.pmod(F.col(name) - a.start, F.lit(a.step)) == 0))
    inside = inside.withColumns({name: F.floor((F.col(name) - a.start) / a.step).cast("int") for name, a in (("t", times), ("c", channels))})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
        for at, block in blocks(batches, grid):
            cut = _cut(at[3:], grid, space)
            if cut is not None:
                yield at[:3], cut[1], block[cut[0]]

    local = all(k % a.step == 0 and k // a.step % new == 0 and a.start % k < a.step for k, new, a in zip(grid.chunk, target.chunk, space, strict=True))
    return _make(inside, made, grid.code, target, codec, local), target


def rechunk(chunks: DataFrame, grid: ChunkGrid, chunk: Sequence[int], codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """The same voxels in chunks of another shape, which need not divide the old one."""
    target = replace(grid, chunk=tuple(chunk), cut=False)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
        for at, block in blocks(batches, grid):
            yield at[:3], grid.low(at[3:]), block

    local = all(k % new == 0 for k, new in zip(grid.chunk, target.chunk, strict=True))
    return _make(chunks, made, grid.code, target, codec, local), target


def decimate_chunks(chunks: DataFrame, grid: ChunkGrid, step: Sequence[int] = (2, 2, 2), offset: int = 0, chunk: Sequence[int] | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """Every step-th voxel of z, y, x, from ``offset`` on; axes of step 1 stay whole. Keeps times, channels and levels."""
    axes = [AxisSlice(min(offset, n) if s > 1 else 0, n, s) for n, s in zip(grid.shape, step, strict=True)]
    target = ChunkGrid(tuple(a.size for a in axes), tuple(chunk or (max(1, k // s) for k, s in zip(grid.chunk, step, strict=True))), grid.dtype)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
        for at, block in blocks(batches, grid):
            cut = _cut(at[3:], grid, axes)
            if cut is not None:
                yield at[:3], cut[1], block[cut[0]]

    local = all(k % a.step == 0 and k // a.step % new == 0 and a.start % k < a.step for k, new, a in zip(grid.chunk, target.chunk, axes, strict=True))
    return _make(chunks, made, grid.code, target, codec, local), target


# means


@dataclass(frozen=True)
class AxisMean:
    """n voxels of an axis averaged into m cells of equal length, which may end within a voxel.

    In units that make a voxel ``each`` long and a cell ``cell`` long, all overlaps are whole numbers.
    """

    n: int
    m: int

    @property
    def each(self) -> int:
        return self.m // math.gcd(self.n, self.m)

    @property
    def cell(self) -> int:
        return self.n // math.gcd(self.n, self.m)

    def cells(self, low: int, size: int) -> tuple[int, int]:
        """First and last cell (without it) that voxels from ``low`` on touch."""
        return low * self.each // self.cell, -(-(min(low + size, self.n) * self.each) // self.cell)

    def weights(self, low: int, size: int) -> np.ndarray:
        """Overlaps of the touched cells (rows) with the voxels."""
        first, last = self.cells(low, size)
        begin, voxel = np.arange(first, last)[:, None] * self.cell, np.arange(low, low + size)[None, :] * self.each
        return np.maximum(np.minimum(begin + self.cell, voxel + self.each) - np.maximum(begin, voxel), 0)

    def share(self, first: int, count: int, length: int) -> np.ndarray:
        """How much of each cell lies within the first ``length`` voxels."""
        begin = np.arange(first, first + count) * self.cell
        return np.minimum(begin + self.cell, length * self.each) - begin


def mean_chunks(chunks: DataFrame, grid: ChunkGrid, target: Sequence[int] | None = None, factor: Sequence[int] | None = None, edge: str = "floor", chunk: Sequence[int] | None = None, codec: str = "zstd") -> tuple[DataFrame, ChunkGrid]:
    """Means as chunks of a smaller shape, whole numbers rounded half to even.

    Either of blocks of ``factor`` voxels, where ``edge`` is as in ``reduce.block_reduce``, or for any ``target`` shape of
    cells of equal size, voxels counting by how much of a cell they fill. ``chunk``: the new chunk shape; as before if null.
    """
    shape = grid.shape
    if factor is not None:
        if edge not in ("floor", "zero_pad", "partial"):
            raise ValueError(edge)
        target = tuple(n // f if edge == "floor" else -(-n // f) for n, f in zip(shape, factor, strict=True))
        axes = [AxisMean(m * f, m) for m, f in zip(target, factor, strict=True)]
    else:
        if any(not 0 < m <= n for n, m in zip(shape, target, strict=True)):
            raise ValueError(f"{target} does not fit into {shape}")
        axes = [AxisMean(n, m) for n, m in zip(shape, target, strict=True)]
    made_grid = ChunkGrid(tuple(target), tuple(chunk or grid.chunk), grid.dtype)
    if 0 in made_grid.shape:
        return chunks.where("false").select(*PLACE, "dtype", "codec", "payload", F.lit(0).cast("long").alias("n")), made_grid

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
        for at, block in blocks(batches, grid):
            low = grid.low(at[3:])
            size = [min(n, a.n - b) for n, a, b in zip(block.shape, axes, low, strict=True)]
            if min(size) <= 0:
                continue
            total, first = block[tuple(slice(n) for n in size)].astype(np.float64), []
            for i, (a, b, n) in enumerate(zip(axes, low, size, strict=True)):
                begin = a.cells(b, n)[0]
                first.append(begin)
                if a.each == 1:  # whole voxels: sums of runs
                    starts = np.maximum(np.arange(begin, a.cells(b, n)[1]) * a.cell - b, 0)
                    total = np.add.reduceat(total, starts, axis=i) if a.cell > 1 else total
                else:
                    total = np.moveaxis(np.tensordot(a.weights(b, n).astype(np.float64), total, (1, i)), 0, i)
            yield at[:3], first, total

    def finish(total: np.ndarray, at: Sequence[int]) -> np.ndarray:
        volume: float | np.ndarray = float(math.prod(a.cell for a in axes))
        if factor is not None and edge == "partial":
            shares = [a.share(i * k, n, length).astype(np.float64) for a, i, k, n, length in zip(axes, at, made_grid.chunk, total.shape, shape, strict=True)]
            volume = shares[0][:, None, None] * shares[1][None, :, None] * shares[2][None, None, :]
        mean = total / volume
        return np.rint(mean).astype(grid.code) if grid.code.kind == "u" else mean.astype(grid.code)

    local = all(k * a.each % a.cell == 0 and k * a.each // a.cell % new == 0 for k, a, new in zip(grid.chunk, axes, made_grid.chunk, strict=True))
    return _make(chunks, made, np.dtype(np.float64), made_grid, codec, local, finish), made_grid


def build_chunks(chunks: DataFrame, ds: ArrayDataset, plan: Sequence[Level], codec: str = "zstd") -> list[DataFrame]:
    """The levels of ``plan`` (full resolution first) as chunk tables, each of means of the one before, written out and read again between."""
    found, grid = [chunks], ChunkGrid.of(replace(ds, levels=tuple(plan)))
    for level in plan[1:]:
        made, grid = mean_chunks(found[-1], grid, tuple(level.shape), chunk=level.chunk, codec=codec)
        found.append(materialize(made.withColumn("r", F.lit(level.r)), f"chunks-{level.r}"))
    return found


# reductions


def channel_range(chunks: DataFrame, grid: ChunkGrid, spec: SliceSpec | None = None, nonzero: bool = False) -> DataFrame:
    """vmin, vmax and n of each t and c, of a slice if one is given; with ``nonzero`` the least and largest above 0."""
    space = spec.axes[2:] if spec else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for at, block in blocks(batches, grid):
            if space:
                cut = _cut(at[3:], grid, space)
                if cut is None:
                    continue
                block = block[cut[0]]
            held = found.setdefault(at[1:3], [None, None, 0])
            held[2] += block.size
            values = block[block > 0] if nonzero else block
            if values.size:
                low, high = float(values.min()), float(values.max())
                held[:2] = [low if held[0] is None else min(held[0], low), high if held[1] is None else max(held[1], high)]
        rows = [(*k, *v) for k, v in found.items()]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["t", "c", "vmin", "vmax", "n"])

    parts = _read(_inside(chunks, grid, spec)).mapInArrow(run, "t int, c int, vmin double, vmax double, n long")
    kind = "long" if grid.code.kind == "u" else "double"
    return parts.groupBy(*KEYS).agg(F.min("vmin").cast(kind).alias("vmin"), F.max("vmax").cast(kind).alias("vmax"), F.sum("n").alias("n"))


def _inside(chunks: DataFrame, grid: ChunkGrid, spec: SliceSpec | None) -> DataFrame:
    if spec is None:
        return chunks
    out = _near(chunks.where(F.col("r") == spec.r), grid, spec.axes[2:])
    for name, a in zip(KEYS, spec.axes[:2], strict=True):
        out = out.where((F.col(name) >= a.start) & (F.col(name) < a.stop) & (F.pmod(F.col(name) - a.start, F.lit(a.step)) == 0))
    return out


def histogram(chunks: DataFrame, grid: ChunkGrid, bins: int, top: int | None = None, spec: SliceSpec | None = None) -> DataFrame:
    """n of each bin of 0..top by t and c; ``top`` is the largest of the type if null."""
    width = ((DTYPES[grid.dtype][2] if top is None else top) + 1) / bins
    space = spec.axes[2:] if spec else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], dict[int, int]] = {}
        for at, block in blocks(batches, grid):
            cut = _cut(at[3:], grid, space) if space else ((), None, None)
            if cut is None:
                continue
            bins_of = np.floor(block[cut[0]] / width).astype(np.int64).ravel()
            least = int(bins_of.min(initial=0))
            counts = np.bincount(bins_of - least)
            held = found.setdefault(at[1:3], {})
            for v in np.flatnonzero(counts).tolist():
                held[v + least] = held.get(v + least, 0) + int(counts[v])
        rows = [(*k, v, n) for k, held in found.items() for v, n in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["t", "c", "bin", "n"])

    parts = _read(_inside(chunks, grid, spec)).mapInArrow(run, "t int, c int, bin int, n long")
    return parts.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
