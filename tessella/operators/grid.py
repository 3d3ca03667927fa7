"""Chunk grids: names and boxes of chunks, enumeration, dense completion, shards, halos, re-chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = ("z", "y", "x")


def chunk_number(coordinate: Column, k: int) -> Column:
    return F.floor(coordinate / k).cast("int")


def name_to_box(name: Column, shape: Sequence[Column], chunk: Sequence[int], open_end: bool = False) -> dict[str, Column]:
    """``t.c.z.y.x`` -> start and stop of each axis. Stops are clamped to the shape, or null there with ``open_end``."""
    parts, out = F.split(name, r"\."), {}
    for i, (axis, n, k) in enumerate(zip("tczyx", shape, chunk, strict=True)):
        number = F.element_at(parts, i + 1).cast("long")
        stop = (number + 1) * k
        out[f"{axis}0"] = number * k
        out[f"{axis}1"] = F.when(stop < n, stop) if open_end else F.least(stop, n)
    return out


def box_name(start: Sequence[Column], stop: Sequence[Column]) -> Column:
    """``x0-x1_y0-y1_z0-z1`` from boxes in z, y, x order."""
    z, y, x = (F.concat_ws("-", a.cast("string"), b.cast("string")) for a, b in zip(start, stop, strict=True))
    return F.concat_ws("_", x, y, z)


def box_of_name(name: Column) -> dict[str, Column]:
    """The inverse of ``box_name``; t is 0 and all channels are meant."""
    pattern = r"^(\d+)-(\d+)_(\d+)-(\d+)_(\d+)-(\d+)$"
    return {f"{axis}{end}": F.regexp_extract(name, pattern, 2 * i + end + 1).cast("long") for i, axis in enumerate("xyz") for end in (0, 1)}


def dotted_path(path: Column) -> Column:
    """``.../t/c/z/y/x`` -> ``.../t.c.z.y.x`` where the last five segments are numbers."""
    return F.regexp_replace(path, r"/(\d+)/(\d+)/(\d+)/(\d+)/(\d+)$", "/$1.$2.$3.$4.$5")


def slashed_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/(\d+)\.(\d+)\.(\d+)\.(\d+)\.(\d+)$", "/$1/$2/$3/$4/$5")


def chunk_in_path(path: Column) -> Column:
    """Chunk shape written in a path as ``.8x256x256.`` (two to four numbers), padded with 1 on the left to five; null without one."""
    found = F.regexp_extract(path, r"\.(\d+(?:x\d+){1,3})\.", 1)
    numbers = F.transform(F.split(found, "x"), lambda n: n.cast("int"))
    return F.when(found != "", F.concat(F.array_repeat(F.lit(1), F.lit(5) - F.size(numbers)), numbers))


def grid_size(n: Column, k: int) -> Column:
    return F.ceil(n / k).cast("long")


def enumerate_grid(levels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """All chunks of levels (with t_size, c_size, z_size, y_size, x_size): numbers, boxes and whether no axis is cut short."""
    sizes = ["t_size", "c_size", "z_size", "y_size", "x_size"]
    names = ["ct", "cc", "cz", "cy", "cx"]
    out = levels
    for name, size, k in zip(names, sizes, chunk, strict=True):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), grid_size(F.col(size), k) - 1)))
    for axis, name, size, k in zip("tczyx", names, sizes, chunk, strict=True):
        out = out.withColumn(f"{axis}0", F.col(name) * k).withColumn(f"{axis}1", F.least((F.col(name) + 1) * k, F.col(size)))
    full = F.lit(True)
    for axis, k in zip("tczyx", chunk, strict=True):
        full = full & (F.col(f"{axis}1") - F.col(f"{axis}0") == k)
    return out.withColumn("full", full)


def with_chunks(voxels: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Chunk numbers cz, cy, cx; re-chunking is this with another chunk shape."""
    return voxels.withColumns({f"c{a}": chunk_number(F.col(a), k) for a, k in zip(SPACE, chunk, strict=True)})


def densify(voxels: DataFrame, box: Sequence[Column | int], keys: Sequence[str], fill: int = 0) -> DataFrame:
    """Every voxel of each key's zero-based box in z, y, x; those missing get ``fill``. ``voxels`` has keys, z, y, x and v."""
    grid = voxels.select(*keys).distinct()
    for axis, n in zip(SPACE, box, strict=True):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n) - 1 if isinstance(n, int) else n - 1)))
    return grid.join(voxels, [*keys, *SPACE], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def shards(n: Column, k: int) -> Column:
    """Array of (start, depth) of slabs of k along an axis of n; the last may be short."""
    k_ = F.lit(k).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, k_), lambda z: F.struct(z.alias("start"), F.least(k_, n - z).alias("depth")))


def shard_of(i: Column, k: int) -> tuple[Column, Column]:
    """(first index of i's shard, offset in it)."""
    return i - F.pmod(i, F.lit(k)), F.pmod(i, F.lit(k))


def halo(start: Column, stop: Column, n: Column, width: int) -> tuple[Column, Column, Column, Column]:
    """(start, stop, before, after) of a box grown by ``width`` inside 0..n: what it really grew by."""
    low, high = F.greatest(start - width, F.lit(0)), F.least(stop + width, n)
    return low, high, start - low, high - stop


def chunk_proposals(data: tuple[int, int, int], kind: bool | int | tuple[int, int, int]) -> list[list[int]]:
    """Chunk shapes in x, y, z: the data's own (False), three with one axis of d (int), or as given. ``data`` is z, y, x."""
    z, y, x = data
    if isinstance(kind, tuple):
        return [list(kind)]
    if kind is False:
        return [[x, y, z]]
    d = int(kind)
    return [[x, y, d], [x, d, y], [d, x, y]]


def read_depth(y: int, x: int, chunk_y: int, itemsize: int, limit: int) -> int:
    """Rows of a plane to read at once: whole storage chunks, the first depth whose bytes exceed the limit, or the plane."""
    depth = chunk_y
    while depth < y and depth * x * itemsize <= limit:
        depth += chunk_y
    return min(depth, y)
