"""Folders and files below a folder, listed by tasks level by level."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .stores import Store

ENTRY = "path string, parent string, name string, is_dir boolean, link boolean, size long, modified timestamp, listed boolean"
MOST_DEPTH = 256


def _list(batches: Iterator[pa.RecordBatch], place: str) -> Iterator[pa.RecordBatch]:
    """What lies right in each folder; a folder that can't be listed gives one row that says so. Column: path, below the root."""
    store = Store(place)
    local = store.fs.type_name == "local"
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for given in batches:
        for folder in given.column(0).to_pylist():
            try:
                found = store.fs.get_file_info(fs.FileSelector(f"{store.root}/{folder}".rstrip("/")))
            except (OSError, PermissionError):
                yield batch([(folder, folder.rpartition("/")[0], folder.rpartition("/")[2], True, False, None, None, False)])
                continue
            rows = []
            for f in found:
                # a link to a folder is listed, but what lies behind it is not walked, as it may lead back
                is_dir, link = f.type == fs.FileType.Directory, local and os.path.islink(f.path)
                path = f"{folder}/{f.base_name}".lstrip("/")
                rows.append((path, folder, f.base_name, is_dir, link, None if is_dir else f.size, f.mtime, True))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def walk(spark: SparkSession, uri: str, depth: int | None = None) -> DataFrame:
    """Everything below a folder: path (below it), parent, name, is_dir, link, size, modified, and its depth (1: right below).

    Each round lists the folders that the round before found, in as many tasks as there are folders, up to the shuffle partitions;
    what a round found is written and read again, so a lost executor costs no more than its round. ``depth``: how many rounds, all if
    null. ``listed`` is false for a folder that could not be listed.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, rounds, level = spark.createDataFrame([("",)], "path string"), [], 0
    while depth is None or level < depth:
        level += 1
        if level > MOST_DEPTH:
            raise ValueError(f"{uri} is more than {MOST_DEPTH} folders deep")
        found = folders.repartition(tasks, "path") if level > 1 else folders
        found = materialize(found.mapInArrow(lambda batches: _list(batches, uri), ENTRY).withColumn("depth", F.lit(level)), "walk")
        rounds.append(found)
        folders = found.where("is_dir and not link and listed").select("path")
        if folders.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    # the row of a folder that could not be listed is beside the one that names it
    failed = out.where("not listed").select("path").withColumn("failed", F.lit(True))
    return out.where("listed").drop("listed").join(failed, "path", "left").withColumn("listed", F.col("failed").isNull()).drop("failed")


def folder_counts(entries: DataFrame) -> DataFrame:
    """path, dirs and files of each folder that holds anything, and of those that hold nothing; ``entries`` as ``walk`` gives them."""
    counts = entries.groupBy(F.col("parent").alias("path")).agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), F.sum("size").alias("bytes"))
    empty = entries.where("is_dir and not link").select("path").join(counts.select("path"), "path", "left_anti")
    return counts.unionByName(empty.select("path", *(F.lit(0).cast("long").alias(c) for c in ("dirs", "files", "bytes")))).fillna(0, ["bytes"])
