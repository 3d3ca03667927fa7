"""Queries on chunk tables: what they return in voxels is read from the chunks that the operators make."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce as reduce_frames

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ArrayDataset, Level
from ..operators import chunked, grid, halo, reduce
from ..operators.chunked import ChunkGrid
from ..operators.encode import chunks_of, voxels_of
from ..operators.slicing import SliceSpec
from ..session import scratch_path
from .arrays import BLURRED, BOX3, SIGMA
from .common import CHUNK, DENSE, VOX, Query, plain, shape_of, sql, volume

QUERIES: dict[str, tuple[Query, str | None]] = {}
XS = "(SELECT max(x) + 1 FROM vox)"


def query(sql_text: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (lambda spark, sf_dir: plain(fn(spark, sf_dir)), sql_text)
        return fn

    return add


def dense(body: str, longs: str, *more: str) -> str:
    return sql(body, longs, ctes=(VOX, DENSE, *more))


def dense_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ChunkGrid]:
    """Every chunk of the volume over orders, zeros where it has no voxel."""
    v = volume(spark, sf_dir)
    shape = shape_of(v)
    whole = grid.densify(v.drop("t"), shape, ["c"]).withColumn("t", F.lit(0))
    return chunks_of(whole, CHUNK, "uint16", "zstd"), ChunkGrid(shape, CHUNK, "uint16")


def voxels(chunks: DataFrame, made: ChunkGrid) -> DataFrame:
    return voxels_of(chunks, made.chunk, made.shape, made.dtype).select("c", "z", "y", "x", "v")


@query(dense("SELECT t, 0 AS c, (z - 1) // 2 AS z, y - 3 AS y, x // 3 AS x, v FROM (SELECT 0 AS t, * FROM dense) WHERE c = 1 AND z >= 1 AND (z - 1) % 2 = 0 AND y >= 3 AND y < 14 AND x % 3 = 0", "t c z y x v"))
def chunk_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice with steps, cut from payloads and pasted into chunks of its own."""
    chunks, old = dense_chunks(spark, sf_dir)
    spec = SliceSpec.of((0, 1, slice(1, 8, 2), slice(3, 14), slice(0, old.shape[2], 3)), (1, 2, *old.shape))
    got, made = chunked.slice_chunks(chunks, old, spec, (2, 8, 16))
    return voxels_of(got, made.chunk, made.shape, made.dtype).select("t", "c", "z", "y", "x", "v")


@query(dense("SELECT c, z // 3 AS cz, y // 5 AS cy, x // 6 AS cx, z, y, x, v FROM dense", "c cz cy cx z y x v"))
def chunk_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads from one grid to another that doesn't divide it."""
    chunks, old = dense_chunks(spark, sf_dir)
    got, made = chunked.rechunk(chunks, old, (3, 5, 6), "blosc")
    return voxels_of(got, made.chunk, made.shape, made.dtype).select("c", "cz", "cy", "cx", "z", "y", "x", "v")


@query(dense("SELECT c, CAST(min(v) FILTER (v > 0) AS BIGINT) AS vmin, max(v) FILTER (v > 0) AS vmax, count(*) AS n FROM dense WHERE z >= 1 AND z < 7 GROUP BY c", "c vmin vmax n"))
def chunk_range_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, old = dense_chunks(spark, sf_dir)
    spec = SliceSpec.of((slice(None), slice(None), slice(1, 7)), (1, 2, *old.shape))
    return chunked.channel_range(chunks, old, spec, nonzero=True).drop("t")


@query(dense("SELECT c, v // 4096 AS bin, count(*) AS n FROM dense GROUP BY ALL", "c bin n"))
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.histogram(*dense_chunks(spark, sf_dir), 16).drop("t")


@query(dense("SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, v FROM dense WHERE z % 2 = 1 AND y % 2 = 1 AND x % 2 = 1", "c z y x v"))
def chunk_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(*chunked.decimate_chunks(*dense_chunks(spark, sf_dir), offset=1))


@query(dense("SELECT c, z // 3 AS z, y // 3 AS y, x // 3 AS x, round_even(sum(v) / CAST(count(*) AS DOUBLE), 0) AS v FROM dense GROUP BY c, z // 3, y // 3, x // 3", "c z y x v"))
def chunk_mean_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three voxels in chunks of four and eight, so that most blocks lie in several chunks."""
    return voxels(*chunked.mean_chunks(*dense_chunks(spark, sf_dir), factor=(3, 3, 3), edge="partial", chunk=(2, 4, 8)))


def area_sql(source: str, target: str, n: tuple[str, str, str], m: tuple[str, str, str]) -> str:
    """CTE ``target``: means of ``source`` (c, z, y, x, v) over cells of equal size; a voxel touches at most two cells of an axis, as m <= n."""
    out = f"SELECT c, z, y, x, v, {n[0]} AS nz, {n[1]} AS ny, {n[2]} AS nx, {m[0]} AS mz, {m[1]} AS my, {m[2]} AS mx FROM {source}"
    two = "(SELECT unnest(range(0, 2)) AS d{a})"
    cells = ", ".join(f"{a} * m{a} // n{a} + d{a} AS i{a}" for a in "zyx")
    weights = ", ".join(f"least((i{a} + 1) * n{a}, ({a} + 1) * m{a}) - greatest(i{a} * n{a}, {a} * m{a}) AS w{a}" for a in "zyx")
    inner = f"SELECT *, {weights} FROM (SELECT *, {cells} FROM ({out}), {', '.join(two.format(a=a) for a in 'zyx')})"
    return f"""{target} AS (SELECT c, iz AS z, iy AS y, ix AS x, CAST(round_even(sum(CAST(v * wz * wy * wx AS BIGINT)) / CAST(any_value(nz) * any_value(ny) * any_value(nx) AS DOUBLE), 0) AS BIGINT) AS v
        FROM ({inner}) WHERE wz > 0 AND wy > 0 AND wx > 0 GROUP BY c, iz, iy, ix)"""


AREA = area_sql("dense", "area", ("8", "16", XS), ("6", "11", f"{XS} * 2 // 3"))


def _areas(shape: Sequence[int]) -> tuple[int, int, int]:
    return (6, 11, shape[2] * 2 // 3)


@query(dense("SELECT * FROM area", "c z y x v", AREA))
def chunk_area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of cells that end within voxels, of payloads."""
    chunks, old = dense_chunks(spark, sf_dir)
    return voxels(*chunked.mean_chunks(chunks, old, _areas(old.shape), chunk=(3, 4, 8)))


@query(dense("SELECT * FROM area", "c z y x v", area_sql("vox", "area", ("8", "16", XS), ("6", "11", f"{XS} * 2 // 3"))))
def area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of voxels."""
    v = volume(spark, sf_dir)
    shape = shape_of(v)
    return reduce.area_mean(v, shape, _areas(shape)).drop("t")


PYRAMID = (area_sql("dense", "l1", ("8", "16", XS), ("8", "8", f"{XS} // 2")), area_sql("l1", "l2", ("8", "8", f"{XS} // 2"), ("5", "6", f"{XS} // 4")))


@query(dense("SELECT 1 AS r, * FROM l1 UNION ALL SELECT 2 AS r, * FROM l2", "r c z y x v", *PYRAMID))
def chunk_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anisotropic pyramid, level from level, each with chunks of its own."""
    chunks, old = dense_chunks(spark, sf_dir)
    n = old.shape[2]
    plan = (Level(0, old.shape, CHUNK), Level(1, (8, 8, n // 2), (4, 4, 16)), Level(2, (5, 6, n // 4), (5, 6, 16)))
    ds = ArrayDataset("orders", "uint16", 1, 2, plan)
    _, first, second = chunked.build_chunks(chunks, ds, plan)
    made = [voxels(levels, ChunkGrid.of(ds, r)).withColumn("r", F.lit(r)) for r, levels in ((1, first), (2, second))]
    return made[0].unionByName(made[1])


# halos


@query(sql("SELECT c, z, y, x, round(v, 3) AS v FROM b3", "c z y x", "v", ctes=BLURRED))
def chunk_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that get packed faces of their neighbours."""
    chunks, old = dense_chunks(spark, sf_dir)
    return voxels(*halo.gaussian_chunks(chunks, old, SIGMA, dtype="float64")).withColumn("v", F.round("v", 3))


@query(sql(BOX3, "c z y x v", ctes=(VOX, DENSE)))
def chunk_box3_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, old = dense_chunks(spark, sf_dir)
    return voxels(*halo.box_chunks(chunks, old, dtype="float64")).withColumn("v", F.col("v").cast("long"))


# Imaris files


def _imaris_files(spark: SparkSession, sf_dir: str) -> list[tuple[str, dict[str, int]]]:
    """The volume as Imaris files, one for each row of chunks along z: path and offset."""
    from ..sources.hdf5_write import write_imaris_slabs

    chunks, old = dense_chunks(spark, sf_dir)
    ds = ArrayDataset("orders", "uint16", 1, 2, (Level(0, old.shape, CHUNK),))
    made = write_imaris_slabs(chunks, ds, scratch_path(spark, "imaris"))
    return [(r["path"], {"z": r["z"]}) for r in made.orderBy("z").collect()]


@query(dense("SELECT c, z, y, x, v FROM dense", "c z y x v"))
def imaris_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that tasks write, read as one volume by their chunk trees."""
    from ..sources.config import virtual_dataset

    return virtual_dataset(spark, _imaris_files(spark, sf_dir)).select("c", "z", "y", "x", "v")


@query(dense("SELECT z // 4 AS slab, c, min(v) AS vmin, max(v) AS vmax, count(*) AS n FROM dense GROUP BY ALL", "slab c vmin vmax n"))
def imaris_stored_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and numbers of voxels that the files state, without a look at their voxels."""
    from ..sources.imaris import stored_histograms, stored_ranges

    parts = []
    for uri, offset in _imaris_files(spark, sf_dir):
        counts = stored_histograms(spark, uri).groupBy("c").agg(F.sum("n").alias("n"))
        ranges = stored_ranges(spark, uri).select("c", F.col("vmin").cast("long").alias("vmin"), F.col("vmax").cast("long").alias("vmax"))
        parts.append(ranges.join(counts, "c").withColumn("slab", F.lit(offset["z"] // CHUNK[0])))
    return reduce_frames(DataFrame.unionByName, parts)


# files and folders


@query(dense("SELECT c, z, y, x, v FROM dense WHERE z BETWEEN 2 AND 5 AND y >= 8 AND y < 12", "c z y x v"))
def tiff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows of some planes of a stack that tasks write in strips of four rows: only their strips are read."""
    from ..sources import tiff
    from ..sources.stores import Store
    from ..sources.tiff_chunks import read_tiff

    chunks, old = dense_chunks(spark, sf_dir)
    whole, planes = chunked.rechunk(chunks, old, (1, *old.shape[1:]), "null")
    uri = scratch_path(spark, "strips")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n = Store(uri), 0
        for at, block in chunked.blocks(batches, planes):
            _, t, c, z, *_ = at
            store.write(f"T{t}/CH{c}/plane{z:05d}.tif", tiff.encode(block[0], 4, deflate=z % 2 == 1))
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    whole.select(*chunked.PLACE, "codec", "payload").mapInArrow(write, "n long").groupBy().sum("n").collect()
    got, made = read_tiff(spark, uri, 4)
    return voxels(got.where("cz BETWEEN 2 AND 5 AND cy = 2"), made)


@query(
    """WITH d AS (SELECT DISTINCT lang, 'y' || CAST(n_chars % 7 AS VARCHAR) AS y, 'source=' || source AS s FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL)
    SELECT '' AS path, count(DISTINCT s) AS dirs FROM d UNION ALL SELECT s, count(DISTINCT lang) FROM d GROUP BY s UNION ALL SELECT DISTINCT s || '/lang=' || lang, count(DISTINCT y) FROM d GROUP BY s, lang
    UNION ALL SELECT DISTINCT s || '/lang=' || lang || '/part=' || y, 0 FROM d"""
)
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a write of the documents makes, listed round by round."""
    from ..session import load
    from ..sources.listing import folder_counts, walk

    uri = scratch_path(spark, "folders")
    docs = load(spark, sf_dir, "documents").where("lang is not null and source is not null and n_chars is not null")
    docs.select("source", "lang", F.concat(F.lit("y"), F.col("n_chars") % 7).alias("part"), "doc_id").write.partitionBy("source", "lang", "part").parquet(uri)
    return folder_counts(walk(spark, uri)).select("path", "dirs")


GRIDS = """WITH levels AS (SELECT p_partkey, p_size % 5 + 1 AS z, p_size AS y, p_partkey % 40 + 1 AS x FROM part)
    SELECT p_partkey, cz, cy, cx, z1, y1, x1, z1 - z0 = 2 AND y1 - y0 = 8 AND x1 - x0 = 16 AS "full" FROM (SELECT p_partkey, cz, cy, cx, cz * 2 AS z0, least(cz * 2 + 2, z) AS z1, cy * 8 AS y0, least(cy * 8 + 8, y) AS y1, cx * 16 AS x0, least(cx * 16 + 16, x) AS x1
    FROM (SELECT *, unnest(range(0, (x + 15) // 16)) AS cx FROM (SELECT *, unnest(range(0, (y + 7) // 8)) AS cy FROM (SELECT *, unnest(range(0, (z + 1) // 2)) AS cz FROM levels))))"""


@query(sql(f"SELECT * FROM ({GRIDS})", "p_partkey cz cy cx z1 y1 x1", rest='"full"'))
def sql_chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of many levels, one a part, by SQL alone."""
    from ..functions.sql import register
    from ..session import load

    register(spark)
    load(spark, sf_dir, "part").createOrReplaceTempView("level_parts")
    return spark.sql("""SELECT p_partkey, cz, cy, cx, z1, y1, x1, full FROM level_parts, LATERAL chunk_grid(1L, 1L, p_size % 5 + 1, p_size, p_partkey % 40 + 1, 1L, 1L, 2L, 8L, 16L)""")


@query(dense("SELECT c, z, y, x, CASE WHEN c = 1 AND z < 4 THEN v // 2 ELSE v END AS v FROM dense", "c z y x v"))
def zarr_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk tables put into a group by two transactions, the second over some chunks of the first."""
    from ..sources.zarr import create_zarr, read_zarr, write_chunks

    chunks, old = dense_chunks(spark, sf_dir)
    uri = f"{scratch_path(spark, 'sink')}.ome.zarr"
    create_zarr(ArrayDataset("orders", "uint16", 1, 2, (Level(0, old.shape, CHUNK),)), uri, "blosc")
    write_chunks(chunks, uri)
    halved, _ = halo.map_chunks(chunks.where("c = 1 and cz = 0"), old, lambda block: np.floor(block / 2))
    write_chunks(halved, uri)
    return read_zarr(spark, uri).select("c", "z", "y", "x", F.col("v").cast("long").alias("v"))
