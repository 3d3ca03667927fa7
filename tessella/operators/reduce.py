"""Reductions of voxel tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("t", "c")


def channel_range(voxels: DataFrame, keys: Sequence[str] = KEYS, nonzero: bool = False) -> DataFrame:
    """vmin, vmax and n of each channel; with ``nonzero`` over voxels above 0, null where there are none."""
    v = F.when(F.col("v") > 0, F.col("v")) if nonzero else F.col("v")
    return voxels.groupBy(*keys).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.count("*").alias("n"))


def stored_range(voxels: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """vmin and vmax of each channel as ``stored`` (keys, vmin, vmax) has them, else as computed; ``computed`` says which."""
    known = stored.where("vmin is not null and vmax is not null").select(*keys, F.col("vmin").alias("__low"), F.col("vmax").alias("__high"))
    missing = voxels.join(F.broadcast(known.select(*keys)), list(keys), "left_anti")
    found = channel_range(missing, keys).select(*keys, F.col("vmin").cast("double").alias("vmin"), F.col("vmax").cast("double").alias("vmax"), F.lit(True).alias("computed"))
    return known.select(*keys, F.col("__low").cast("double").alias("vmin"), F.col("__high").cast("double").alias("vmax"), F.lit(False).alias("computed")).unionByName(found)


def histogram(voxels: DataFrame, bins: int, top: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """n of each bin of 0..top, by channel."""
    width = (top + 1) / bins
    return voxels.groupBy(*keys, F.floor(F.col("v") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def block_reduce(voxels: DataFrame, factor: Sequence[int], shape: Sequence[int] | None = None, edge: str = "floor", keys: Sequence[str] = KEYS, tile: Sequence[str] = ()) -> DataFrame:
    """Mean of blocks of ``factor`` (z, y, x), as integers rounded half to even.

    ``edge`` says what becomes of blocks that are cut short: "floor" drops them (needs ``shape``), "zero_pad" fills them
    with zeros, "partial" takes the mean of what is there. Columns in ``tile`` are carried in the grouping, so that
    tables partitioned by them need no new shuffle.
    """
    fz, fy, fx = factor
    if edge == "floor":
        if shape is None:
            raise ValueError("floor needs the shape")
        nz, ny, nx = (n // f for n, f in zip(shape, factor, strict=True))
        voxels = voxels.where((F.col("z") < nz * fz) & (F.col("y") < ny * fy) & (F.col("x") < nx * fx))
    total, count = F.sum("v"), F.lit(fz * fy * fx)
    if edge == "partial":
        count = F.count("v")
    elif edge not in ("floor", "zero_pad"):
        raise ValueError(edge)
    block = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip("zyx", factor, strict=True)]
    return voxels.groupBy(*keys, *tile, *block).agg(F.bround(total / count).cast("long").alias("v"))


def area_mean(voxels: DataFrame, shape: Sequence[int], target: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Means over cells of equal size that divide ``shape`` into ``target``, rounded half to even; a voxel counts by how much of a
    cell it fills, and what is missing counts as 0. Overlaps are whole numbers in units of 1 / target of an axis."""
    if any(not 0 < m <= n for n, m in zip(shape, target, strict=True)):
        raise ValueError(f"{tuple(target)} does not fit into {tuple(shape)}")
    out, weight, volume = voxels, F.lit(1).cast("long"), 1
    for axis, n, m in zip("zyx", shape, target, strict=True):
        cell, each = n // math.gcd(n, m), m // math.gcd(n, m)
        volume *= cell
        begin = F.col(f"__{axis}") * each
        out = out.withColumn(f"__{axis}", F.col(axis).cast("long"))
        touched = F.sequence(F.floor(begin / cell), F.floor((begin + each - 1) / cell))
        out = out.withColumn(axis, F.explode(touched) if each > 1 else F.floor(begin / cell)).withColumn(axis, F.col(axis).cast("int"))
        weight = weight * (F.least((F.col(axis).cast("long") + 1) * cell, begin + each) - F.greatest(F.col(axis).cast("long") * cell, begin))
    return out.groupBy(*keys, *"zyx").agg(F.bround(F.sum(F.col("v") * weight) / F.lit(volume)).cast("long").alias("v"))


def listing_counts(entries: DataFrame) -> DataFrame:
    """dirs and files directly in each parent; ``entries`` has parent and is_dir."""
    return entries.groupBy("parent").agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"))
