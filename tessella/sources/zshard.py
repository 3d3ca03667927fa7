"""z-sharded datasets: slabs along z as zip files ``r/t/c/<first z>.zip``, described by ``z_sharded.json``."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import ArrayDataset, Level, dtype_code
from ..operators.encode import chunks_of, voxel_batch
from .stores import Store

SIDECAR = "z_sharded.json"


def open_zsharded(uri: str) -> ArrayDataset:
    d = json.loads(Store(uri).read(SIDECAR))
    levels = tuple(Level(r, tuple(d["shape"][str(r)][2:]), tuple(d["chunks"][str(r)][2:]), tuple(d["resolution"][str(r)])) for r in range(d["ResolutionLevels"]))
    return ArrayDataset(uri.rstrip("/").rpartition("/")[2], d["dtype"], d["TimePoints"], d["Channels"], levels)


def write_zsharded(levels: list[DataFrame], ds: ArrayDataset, uri: str) -> None:
    """One zip a slab of chunk depth, written by the task that holds it."""
    key = {str(level.r): level for level in ds.levels}
    sidecar = {"ResolutionLevels": len(ds.levels), "TimePoints": ds.T, "Channels": ds.C, "dtype": ds.dtype, "shape": {r: ds.shape(v.r) for r, v in key.items()}, "chunks": {r: ds.chunks(v.r) for r, v in key.items()}, "resolution": {r: v.resolution for r, v in key.items()}}
    Store(uri).write(SIDECAR, json.dumps(sidecar).encode())
    for level, voxels in zip(ds.levels, levels, strict=True):
        depth = level.chunk[0]

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            r, t, c, cz = (k.as_py() for k in key)
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
                for row in sorted(rows.to_pylist(), key=lambda x: (x["cy"], x["cx"])):
                    z.writestr(f"0.{row['cy']}.{row['cx']}", row["payload"])
            Store(uri).write(f"{r}/{t}/{c}/{cz * depth}.zip", held.getvalue())  # noqa: B023
            return pa.table({"n": [rows.num_rows]})

        chunks_of(voxels, level.chunk, ds.dtype, "zlib", level.r).groupBy("r", "t", "c", "cz").applyInArrow(pack, "n long").collect()


def read_zsharded(spark: SparkSession, uri: str, r: int = 0) -> DataFrame:
    """Voxels of one level; one task a shard, the last of which may be short."""
    ds = open_zsharded(uri)
    level, code = ds.level(r), np.dtype(dtype_code(ds.dtype))
    shards = [(t, c, cz) for t in range(ds.T) for c in range(ds.C) for cz in range(level.grid[0])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for batch in batches:
            for at in batch.to_pylist():
                name = f"{r}/{at['t']}/{at['c']}/{at['cz'] * level.chunk[0]}.zip"
                if not store.has(name):
                    continue  # nothing but zeros
                with zipfile.ZipFile(io.BytesIO(store.read(name))) as z:
                    import zlib

                    for entry in z.namelist():
                        _, cy, cx = map(int, entry.split("."))
                        yield voxel_batch(zlib.decompress(z.read(entry)), code, level.chunk, level.shape, {"r": r, **at, "cy": cy, "cx": cx})

    kind = "int" if code.kind == "u" else "double"
    table = spark.createDataFrame(shards, "t int, c int, cz int").repartition(len(shards))
    return table.mapInArrow(read, f"r int, t int, c int, z int, y int, x int, v {kind}, cz int, cy int, cx int")
