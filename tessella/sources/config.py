"""Settings, collections and folders; and opening a dataset by its extension."""

from __future__ import annotations

import configparser
import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ArrayDataset
from .stores import Store


class MissingDependency(ImportError):
    pass


def mounted_roots(spark: SparkSession, uri: str) -> DataFrame:
    """name, path and is_auth from the sections ``dir_anon`` and ``dir_auth`` of a settings file."""
    folder, _, name = uri.rpartition("/")
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read_string(Store(folder).read(name).decode())
    rows = [(k, v, section == "dir_auth") for section in ("dir_anon", "dir_auth") if parser.has_section(section) for k, v in parser.items(section)]
    return spark.createDataFrame(rows, "name string, path string, is_auth boolean")


def collection(spark: SparkSession, uri: str) -> DataFrame:
    """Paths of a collection file, one a line, without empty lines."""
    return spark.read.text(uri).select(F.trim("value").alias("path")).where("path <> ''")


def folder_entries(spark: SparkSession, uri: str) -> DataFrame:
    """path, parent, name, size and modified of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def open_dataset(spark: SparkSession, uri: str, r: int | None = 0) -> DataFrame:
    """Voxels of level ``r`` (null: of all levels) of the dataset at ``uri``, whose extension names its format."""
    from .imaris import imaris_voxels
    from .zarr import SERIES, read_zarr
    from .zshard import read_zsharded

    kind = uri.rstrip("/").lower()
    if kind.endswith(".omehans"):
        raise MissingDependency("chunks kept in HDF5 files by key need h5py, which is not installed")
    if kind.endswith(".ims"):
        return imaris_voxels(spark, uri, r)
    if SERIES.match(kind.rpartition("/")[2]):
        out = read_zarr(spark, uri, "series")
    elif kind.endswith((".ome.zarr", ".omezarr", ".omezans", ".zarr")):
        out = read_zarr(spark, uri)
    elif kind.endswith(".z_sharded"):
        return read_zsharded(spark, uri, r or 0)
    elif kind.endswith(".parquet"):
        out = spark.read.parquet(uri)
    else:
        raise ValueError(f"no reader for {uri}")
    return out if r is None else out.where(F.col("r") == r)


def describe(uri: str) -> ArrayDataset | None:
    """What the documents of a dataset say of it; null where there are none or they can't be read."""
    from .imaris import open_imaris
    from .zarr import SERIES, open_group, open_series
    from .zshard import open_zsharded

    kind = uri.rstrip("/").lower()
    try:
        if kind.endswith(".z_sharded"):
            return open_zsharded(uri)
        if kind.endswith(".ims"):
            return open_imaris(uri)
        return open_series(uri) if SERIES.match(kind.rpartition("/")[2]) else open_group(uri)
    except (OSError, ValueError, KeyError, TypeError):
        return None


def register_dataset(spark: SparkSession, uri: str) -> str:
    """A temporary view of all levels of a dataset, under a name that its URI alone determines; made once a session."""
    key = f"ds_{hashlib.md5(uri.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(key):
        open_dataset(spark, uri, None).createTempView(key)
    return key


def virtual_dataset(spark: SparkSession, parts: Sequence[tuple[str, Mapping[str, int]]], r: int = 0) -> DataFrame:
    """One volume over several datasets, each with the offsets of its axes in it."""
    return reduce(DataFrame.unionByName, (open_dataset(spark, uri, r).withColumns({a: F.col(a) + n for a, n in offset.items()}).select("t", "c", "z", "y", "x", "v") for uri, offset in parts))


def write_virtual(voxels: DataFrame, parts: Sequence[tuple[str, Mapping[str, int]]], r: int = 0) -> int:
    """Put voxels of the volume into those of its datasets (Zarr groups) that hold their places; the number of chunks touched."""
    from .zarr import open_group, write_region

    total = 0
    for uri, offset in parts:
        low = {a: offset.get(a, 0) for a in "tczyx"}
        inside = reduce(lambda p, q: p & q, (F.col(a).between(low[a], low[a] + n - 1) for a, n in zip("tczyx", open_group(uri).shape(r), strict=True)))
        total += write_region(voxels.where(inside).withColumns({a: F.col(a) - n for a, n in low.items()}), uri, r)
    return total


def level_views(spark: SparkSession, uri: str) -> list[DataFrame]:
    """The dataset as one lazy table a level, the finest first."""
    found = describe(uri)
    if found is None:
        raise ValueError(f"{uri} does not say which levels it has")
    return [open_dataset(spark, uri, level.r) for level in found.levels]


def level_count(voxels: DataFrame) -> int:
    """How many levels a table of voxels has, by its largest level."""
    top = voxels.agg(F.max("r")).first()[0]
    return 0 if top is None else top + 1
