"""Operators that look at neighbouring voxels: mirrored borders, box and Gaussian filters, tiles with halos, scatter."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reduce import KEYS

SPACE = ("z", "y", "x")
TILE = (64, 64, 64)


def mirror_pad(voxels: DataFrame, shape: Sequence[int], width: int) -> DataFrame:
    """The volume with ``width`` voxels more on each side, mirrored so that the border voxel repeats (-1 shows 0)."""
    out = voxels
    for axis, n in zip(SPACE, shape, strict=True):
        at = F.col(axis)
        low = F.when(at < width, -1 - at)
        high = F.when(at >= n - width, 2 * n - 1 - at)
        out = out.withColumn(axis, F.explode(F.array_compact(F.array(at, low, high))))
    return out


def box_sum(voxels: DataFrame, shape: Sequence[int], radius: int = 1, divisor: int = 1, limit: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of each voxel's cube of neighbours over ``divisor``, zeros outside, for every place of the box. A result above
    ``limit`` is an error: it could not be stored as a share of the largest value."""

    def total(block: np.ndarray) -> np.ndarray:
        for axis in range(3):
            block = shifted(block, axis, [1.0] * (2 * radius + 1))
        return block

    out = map_tiles(voxels, shape, TILE, total, radius, "zero", keys)
    if divisor != 1:
        out = out.withColumn("v", F.col("v") / divisor)
    if limit is not None:
        out = out.withColumn("v", F.when(F.col("v") > limit, F.raise_error(F.concat(F.lit(f"above {limit}: "), F.col("v").cast("string"))).cast("double")).otherwise(F.col("v")))
    return out


def shifted(block: np.ndarray, axis: int, weights: Sequence[float]) -> np.ndarray:
    """Weighted sum of a voxel and its neighbours along an axis; zeros beyond the block."""
    radius, out = len(weights) // 2, np.zeros_like(block)
    n = block.shape[axis]
    for d, w in zip(range(-radius, radius + 1), weights, strict=True):
        to, of = [slice(None)] * 3, [slice(None)] * 3
        to[axis], of[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
        if abs(d) < n:
            out[tuple(to)] += w * block[tuple(of)]
    return out


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(voxels: DataFrame, shape: Sequence[int], sigma: float, truncate: float = 4.0, keys: Sequence[str] = KEYS, tile: Sequence[int] = TILE) -> DataFrame:
    """Gaussian blur with the border voxel continued outside, for every place of the box; voxels that are not there count as 0."""
    weights = gaussian_weights(sigma, truncate)

    def blur(block: np.ndarray) -> np.ndarray:
        for axis in range(3):
            block = shifted(block, axis, weights)
        return block

    return map_tiles(voxels, shape, tile, blur, len(weights) // 2, "nearest", keys)


def map_tiles(voxels: DataFrame, shape: Sequence[int], tile: Sequence[int], fn: Callable[[np.ndarray], np.ndarray], width: int = 0, boundary: str = "reflect", keys: Sequence[str] = KEYS) -> DataFrame:
    """``fn`` over tiles of the volume as float arrays, each with ``width`` voxels of its neighbours around it, which are
    cut off again. Beyond the volume: mirrored ("reflect", border repeated), the border continued ("nearest") or zeros
    ("zero"). Places without a voxel hold 0; the result has every place of the volume."""
    out = voxels
    for axis, n, k in zip(SPACE, shape, tile, strict=True):
        last = -(-n // k) - 1
        first_tile, last_tile = F.greatest(F.floor((F.col(axis) - width) / k), F.lit(0)), F.least(F.floor((F.col(axis) + width) / k), F.lit(last))
        out = out.withColumn(f"t{axis}", F.explode(F.sequence(first_tile, last_tile)))
    mode = {"reflect": "symmetric", "nearest": "edge", "zero": "constant"}[boundary]
    shape, tile = tuple(shape), tuple(tile)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]
        at = key[len(keys) :]
        low = [max(0, i * k - width) for i, k in zip(at, tile, strict=True)]
        high = [min(n, (i + 1) * k + width) for i, k, n in zip(at, tile, shape, strict=True)]
        block = np.zeros([b - a for a, b in zip(low, high, strict=True)])
        rows = rows.filter(rows.column("z").is_valid())
        block[tuple(rows.column(a).to_numpy() - m for a, m in zip(SPACE, low, strict=True))] = rows.column("v").to_numpy()
        pads = [(width - (i * k - a), width - (b - min(n, (i + 1) * k))) for i, k, n, a, b in zip(at, tile, shape, low, high, strict=True)]
        made = fn(np.pad(block, pads, mode=mode))[tuple(slice(width, width + min(n, (i + 1) * k) - i * k) for i, k, n in zip(at, tile, shape, strict=True))]
        index = np.indices(made.shape, np.int32).reshape(3, -1)
        columns = [pa.array(np.full(made.size, k, np.int32)) for k in key[: len(keys)]] + [pa.array(i + np.int32(m * k)) for i, m, k in zip(index, at, tile, strict=True)]
        return pa.table([*columns, pa.array(np.ascontiguousarray(made, np.float64).ravel())], [*keys, *SPACE, "v"])

    fields = ", ".join([*(f"{k} int" for k in keys), "z int, y int, x int, v double"])
    # a tile without voxels has a row without a value, so that it is there too
    tiles = voxels.select(*keys).distinct()
    for axis, n, k in zip(SPACE, shape, tile, strict=True):
        tiles = tiles.withColumn(f"t{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // k) - 1).cast("long"))))
    out = out.select(*keys, *SPACE, F.col("v").cast("double").alias("v"), *(f"t{a}" for a in SPACE)).unionByName(tiles, allowMissingColumns=True)
    return out.groupBy(*keys, *(f"t{a}" for a in SPACE)).applyInArrow(run, fields)


def scatter(voxels: DataFrame, field: DataFrame, shape: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Forward deformation: each voxel moves to the rounded and clamped place that ``field`` (z, y, x, fz, fy, fx) gives it.
    Where several meet, the last in C order stays."""
    place = {a: F.least(F.greatest(F.rint(F.col(f"f{a}")), F.lit(0)), F.lit(n - 1)).cast("int") for a, n in zip(SPACE, shape, strict=True)}
    moved = voxels.join(field, list(SPACE)).select(*keys, F.struct(*SPACE).alias("origin"), "v", *(c.alias(f"to_{a}") for a, c in place.items()))
    return moved.groupBy(*keys, *(F.col(f"to_{a}").alias(a) for a in SPACE)).agg(F.max_by("v", "origin").alias("v"))


def resize_nearest(voxels: DataFrame, shape: Sequence[int], target: Sequence[int]) -> DataFrame:
    """Another shape by the nearest voxel: place i shows floor((i + 0.5) * n / m)."""
    out = voxels
    for axis, n, m in zip(SPACE, shape, target, strict=True):
        # the places that show voxel s: i with floor((i + 0.5) * n / m) = s
        low = F.ceil(F.col(axis) * m / F.lit(float(n)) - 0.5).cast("int")
        high = F.ceil((F.col(axis) + 1) * m / F.lit(float(n)) - 0.5).cast("int") - 1
        out = out.where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
    return out


def cubic_weights(spark: SparkSession, n: int, m: int) -> DataFrame:
    """source, target, weight of cubic spline interpolation of n voxels at m places, mirrored at the border voxels; made by tasks.

    A spline's coefficients are the voxels weighted by sqrt(3) (sqrt(3) - 2)^distance; weights below 1e-15 are left out.
    """
    pole, reach = math.sqrt(3) - 2, 27
    period = max(1, 2 * n - 2)
    near = spark.range(m).select(F.col("id").cast("int").alias("target"), ((F.col("id") + 0.5) * n / F.lit(m) - 0.5).alias("place"))
    near = near.withColumn("k", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda d: F.floor("place") + d)))
    d = F.abs(F.col("place") - F.col("k"))
    basis = F.when(d < 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6)
    near = near.withColumn("basis", basis).where("basis > 0").withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    source = F.pmod(F.col("k") + F.col("step"), F.lit(period)) if n > 1 else F.lit(0)
    source = F.least(source, period - source) if n > 1 else source
    weight = F.col("basis") * math.sqrt(3) * F.when(F.col("step") % 2 == 0, 1.0).otherwise(-1.0) * F.pow(F.lit(-pole), F.abs("step"))
    return near.groupBy(source.cast("int").alias("source"), "target").agg(F.sum(weight).alias("weight")).where("abs(weight) >= 1e-15")


#: Places of an axis whose weights, some fifty a place, are broadcast.
MOST_PLACES = 20_000


def resize_cubic(voxels: DataFrame, shape: Sequence[int], target: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Another shape by cubic splines, axis by axis; results stay within the range of the input. Every voxel of the box must be there.

    Weights of an axis are broadcast up to MOST_PLACES target places, and joined by a shuffle beyond.
    """
    spark, out = voxels.sparkSession, voxels.withColumn("v", F.col("v").cast("double"))
    for axis, n, m in zip(SPACE, shape, target, strict=True):
        if n == m:
            continue
        weights = cubic_weights(spark, n, m)
        weights = F.broadcast(weights) if m <= MOST_PLACES else weights
        rest = [a for a in SPACE if a != axis]
        out = out.join(weights, out[axis] == weights["source"]).groupBy(*keys, *rest, weights["target"].alias(axis)).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    bounds = voxels.agg(F.min("v").cast("double").alias("__low"), F.max("v").cast("double").alias("__high")).first()
    if bounds["__low"] is None:
        return out
    return out.withColumn("v", F.least(F.greatest("v", F.lit(bounds["__low"])), F.lit(bounds["__high"])))
