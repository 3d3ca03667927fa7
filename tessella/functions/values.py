"""Value functions of voxels: dtype conversion, 8-bit scaling, display windows, clamping, voxel sizes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..model import DTYPES, UnsupportedDtype


def convert(v: Column, source: str, target: str, chunk_max: Column | None = None) -> Column:
    """``v`` of one dtype as another. 16 to 8 bits drops the low byte; given ``chunk_max`` (the largest value of v's chunk),
    chunks that fit 8 bits keep their values. Unsigned to float is v / largest; float to unsigned rounds half to even and clips."""
    for d in (source, target):
        if d not in DTYPES:
            raise UnsupportedDtype(d)
    if source == target:
        return v
    if source == "uint16" and target == "uint8":
        high = F.shiftright(v.cast("int"), 8)
        return high if chunk_max is None else F.when(chunk_max < 256, v.cast("int")).otherwise(high)
    if source == "uint8" and target == "uint16":
        return v.cast("int") * 257
    if source.startswith("uint"):
        out = v / F.lit(float(DTYPES[source][2]))
        return out.cast("float") if target == "float32" else out
    if target.startswith("uint"):
        top = float(DTYPES[target][2])
        return F.least(F.greatest(F.rint(v.cast("double") * top), F.lit(0.0)), F.lit(top)).cast("int")
    return v.cast({"float32": "float", "float64": "double"}[target])


def chunk_max(v: Column, *chunk_columns: str) -> Column:
    return F.max(v).over(Window.partitionBy(*chunk_columns))


def rescale(v: Column, source: str, target: str) -> Column:
    """A scalar (a display bound) scaled between dtypes, half to even."""
    return F.bround(v * F.lit(float(DTYPES[target][3])) / F.lit(float(DTYPES[source][3])))


def integer_window(start: Column, end: Column, top: int) -> tuple[Column, Column]:
    """(min, max) of a display window of integers: half the start, twice the end, within 0..top."""
    return F.greatest(F.floor(start / 2), F.lit(0)).cast("long"), F.least(end * 2, F.lit(top)).cast("long")


def float_window(start: Column, end: Column) -> tuple[Column, Column]:
    """(min, max) for floats; defined for every value, unlike a chain that leaves some out."""
    top = F.when(end > 1, end * 2).when(end < 1, end / 2).otherwise(end)
    low = F.when(start > 1, start / 2).when(start <= 0, start * 2).otherwise(start)
    return low, top


def clamp_index(x: Column, n: Column | int) -> Column:
    top = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.least(F.greatest(F.rint(x), F.lit(0)), top).cast("long")


def nanometres(resolution_um: Column) -> Column:
    """Array z, y, x in micrometres -> x, y, z in nanometres."""
    return F.transform(F.reverse(resolution_um), lambda r: r * 1000)


def voxel_size(low: Column, high: Column, n: Column, digits: int = 3) -> Column:
    return F.bround((high - low) / n, digits)


def synthetic_resolution(base: float, r: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), r)
