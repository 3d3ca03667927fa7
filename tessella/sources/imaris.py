"""Imaris files: levels, times and channels as HDF5 groups, with histograms and ranges stored beside the voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ArrayDataset, Level
from ..operators.chunked import ChunkGrid
from ..operators.encode import voxels_of
from .hdf5 import Hdf5Error, Hdf5File, check, read_hdf5

IMAGE = "DataSetInfo/Image"


def _count(file: Hdf5File, path: str, name: str) -> int:
    """How many members ``name 0``, ``name 1``, ... a group has."""
    address = file.find(path)
    if address is None:
        raise Hdf5Error(f"{file.uri} has no {path}")
    names = file.links(address)
    n = 0
    while f"{name} {n}" in names:
        n += 1
    return n


def _place(r: int, t: int, c: int) -> str:
    return f"DataSet/ResolutionLevel {r}/TimePoint {t}/Channel {c}"


def _size(file: Hdf5File, r: int, t: int, c: int) -> tuple[int, int, int]:
    """Shape of a level without the padding to whole chunks."""
    told = file.attributes(_place(r, t, c))
    return tuple(int(float(told[f"ImageSize{a}"])) for a in "ZYX")


def counts(file: Hdf5File) -> tuple[int, int, int]:
    """Levels, times and channels."""
    levels = _count(file, "DataSet", "ResolutionLevel")
    if not levels:
        raise Hdf5Error(f"{file.uri} has no levels")
    times = _count(file, "DataSet/ResolutionLevel 0", "TimePoint")
    return levels, times, _count(file, "DataSet/ResolutionLevel 0/TimePoint 0", "Channel") if times else 0


def datasets(uri: str) -> list[tuple[int, int, int, str, tuple[int, int, int]]]:
    """r, t, c, path and shape of every array."""
    file = Hdf5File(uri)
    levels, times, channels = counts(file)
    sizes = {r: _size(file, r, 0, 0) for r in range(levels)}
    return [(r, t, c, f"{_place(r, t, c)}/Data", sizes[r]) for r in range(levels) for t in range(times) for c in range(channels)]


def open_imaris(uri: str, name: str | None = None) -> ArrayDataset:
    """The dataset that a file describes. Voxel sizes are extents over numbers of voxels, to three digits."""
    file = Hdf5File(uri)
    levels, times, channels = counts(file)
    image = file.attributes(IMAGE)
    shape = [int(float(image[a])) for a in "ZYX"]
    finest = [round((float(image[f"ExtMax{i}"]) - float(image[f"ExtMin{i}"])) / n, 3) for i, n in zip((2, 1, 0), shape, strict=True)]
    out, dtype = [], None
    for r in range(levels):
        d, size = file.dataset(f"{_place(r, 0, 0)}/Data"), _size(file, r, 0, 0)
        dtype = dtype or check(d)
        out.append(Level(r, size, d.chunk, tuple(round(n / m * v, 3) for n, m, v in zip(shape, size, finest, strict=True))))
    return ArrayDataset(name or uri.rpartition("/")[2], dtype, times, channels, tuple(out))


def imaris_chunks(spark: SparkSession, uri: str, r: int = 0) -> tuple[DataFrame, ChunkGrid]:
    """The chunk table of a level and its grid."""
    return read_hdf5(spark, uri).where(F.col("r") == r), ChunkGrid.of(open_imaris(uri), r)


def imaris_voxels(spark: SparkSession, uri: str, r: int | None = None) -> DataFrame:
    """Voxels of one level, or of all."""
    ds = open_imaris(uri)
    parts = [voxels_of(*(lambda chunks, grid: (chunks, grid.chunk, grid.shape, grid.dtype))(*imaris_chunks(spark, uri, level.r))) for level in ds.levels if r in (None, level.r)]
    if not parts:
        raise ValueError(f"level {r} of {len(ds.levels)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _beside(spark: SparkSession, uri: str) -> list[tuple[int, int, int, dict, list[int]]]:
    file = Hdf5File(uri)
    found = []
    for r, t, c, path, _ in datasets(uri):
        place = path.rpartition("/")[0]
        has = "Histogram" in file.links(file.find(place))
        found.append((r, t, c, file.attributes(place), file.array(f"{place}/Histogram").tolist() if has else []))
    return found


def stored_histograms(spark: SparkSession, uri: str) -> DataFrame:
    """r, t, c, bin and n from the file's own histograms, and the values that a bin begins and ends with."""
    rows = []
    for r, t, c, told, counted in _beside(spark, uri):
        low, high = (float(told.get(f"Histogram{end}", 0)) for end in ("Min", "Max"))
        step = (high - low) / len(counted) if counted else 0.0
        rows += [(r, t, c, i, int(n), low + i * step, low + (i + 1) * step) for i, n in enumerate(counted)]
    return spark.createDataFrame(rows, "r int, t int, c int, bin int, n long, low double, high double")


def stored_ranges(spark: SparkSession, uri: str) -> DataFrame:
    """t, c, vmin and vmax of the finest level as the file states them; null where it doesn't. Fits ``reduce.stored_range``."""
    rows = [(t, c, *(float(told[k]) if k in told else None for k in ("HistogramMin", "HistogramMax"))) for r, t, c, told, _ in _beside(spark, uri) if r == 0]
    return spark.createDataFrame(rows, "t int, c int, vmin double, vmax double")
