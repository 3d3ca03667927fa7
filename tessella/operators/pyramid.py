"""Resolution pyramids: decimation, block means, and the loop that builds level after level."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Level
from ..session import materialize
from .reduce import KEYS, area_mean, block_reduce


def decimate(voxels: DataFrame, step: Sequence[int] = (2, 2, 2), offset: int = 0) -> DataFrame:
    """Every step-th voxel of each axis, from ``offset`` on, renumbered."""
    out = voxels
    for axis, s in zip("zyx", step, strict=True):
        if s > 1:
            out = out.where((F.col(axis) >= offset) & ((F.col(axis) - offset) % s == 0)).withColumn(axis, F.floor((F.col(axis) - offset) / s).cast("int"))
    return out


def decimated_pyramid(voxels: DataFrame, levels: int) -> DataFrame:
    """All decimated levels in one pass over the full resolution: column r and the coordinates at that level."""
    out = voxels.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    step = F.pow(F.lit(2), F.col("r")).cast("int")
    for axis in "zyx":
        out = out.where(F.col(axis) % step == 0).withColumn(axis, F.floor(F.col(axis) / step).cast("int"))
    return out


def mean_levels(voxels: DataFrame, shape: Sequence[int], levels: int, tile: int = 32) -> list[tuple[DataFrame, tuple[int, ...]]]:
    """(voxels, shape) of 2x2x2 block means, level after level.

    Tiles whose edge is a multiple of 2^levels are dealt out once and stay in every grouping, so all levels together need
    one shuffle.
    """
    while tile % (1 << levels):
        tile *= 2
    names = ["tz", "ty", "tx"]
    out, found = voxels.withColumns({n: F.floor(F.col(a) / tile).cast("int") for n, a in zip(names, "zyx", strict=True)}).repartition(*KEYS, *names), []
    for _ in range(levels):
        out = block_reduce(out, (2, 2, 2), shape, tile=names)
        shape = tuple(n // 2 for n in shape)
        found.append((out.drop(*names), shape))
    return found


def mean_once(voxels: DataFrame, shape: Sequence[int], even_edge_zero: bool = False) -> tuple[DataFrame, tuple[int, ...]]:
    """One level of 2x2x2 means and its shape. With ``even_edge_zero`` the last plane of an axis of even length holds 0, as
    where tiles stop one voxel before the end and what they don't write stays empty."""
    out, made = block_reduce(voxels, (2, 2, 2), shape), tuple(n // 2 for n in shape)
    if even_edge_zero:
        for axis, n in zip("zyx", shape, strict=True):
            if n % 2 == 0:
                out = out.withColumn("v", F.when(F.col(axis) == n // 2 - 1, F.lit(0).cast("long")).otherwise(F.col("v")))
    return out, made


def build(voxels: DataFrame, plan: Sequence[Level], reduce_by: Callable[[DataFrame, tuple, tuple], DataFrame] | None = None) -> list[DataFrame]:
    """The levels of ``plan`` (full resolution first), each from the one before, written out and read again between.

    A level has exactly the shape that the plan gives it: by means of whole blocks where such a factor leads there, else by
    means of cells that end within voxels. ``reduce_by`` takes whole factors only.
    """
    found = [voxels]
    for before, level in zip(plan, plan[1:], strict=False):
        factor = tuple(max(1, a // b) for a, b in zip(before.shape, level.shape, strict=True))
        whole = all(a // f == b for a, b, f in zip(before.shape, level.shape, factor, strict=True))
        if reduce_by and not whole:
            raise ValueError(f"no whole factors lead from {before.shape} to {level.shape}")
        if reduce_by:
            made = reduce_by(found[-1], factor, before.shape)
        else:
            made = block_reduce(found[-1], factor, before.shape) if whole else area_mean(found[-1], before.shape, level.shape)
        found.append(materialize(made, f"level-{level.r}"))
    return found
