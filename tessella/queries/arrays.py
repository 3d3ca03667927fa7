"""Queries on arrays: slices, grids, values, reductions, pyramids, neighbourhoods, metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..model import ArrayDataset, Level
from ..operators import grid, metadata, neighborhood, pyramid, reduce, slicing
from ..session import load, scratch_path
from .common import CHUNK, DENSE, EMB, STORED, VOX, Y, Z, Query, float_matrix, plain, shape_of, sql, volume

XS = "(SELECT max(x) + 1 FROM vox)"
QUERIES: dict[str, tuple[Query, str | None]] = {}
GRID = f"""grid AS (SELECT c, cz, cy, cx, cz * 4 AS z0, cz * 4 + 4 AS z1, cy * 8 AS y0, cy * 8 + 8 AS y1, cx * 8 AS x0, least(cx * 8 + 8, n) AS x1 FROM
    (SELECT unnest(range(0, 2)) AS c), (SELECT unnest(range(0, 2)) AS cz), (SELECT unnest(range(0, 2)) AS cy),
    (SELECT n, unnest(range(0, (n + 7) // 8)) AS cx FROM (SELECT {XS} AS n)))"""


def query(sql_text: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (lambda spark, sf_dir: plain(fn(spark, sf_dir)), sql_text)
        return fn

    return add


def vox(body: str, longs: str = "", doubles: str = "", rest: str = "") -> str:
    return sql(body, longs, doubles, rest, (VOX,))


def spec(voxels: DataFrame, key: object, stop_only: str = "prefix") -> slicing.SliceSpec:
    return slicing.SliceSpec.of(key, (1, 2, *shape_of(voxels)), stop_only=stop_only)


# slices


@query(vox("SELECT t, 0 AS c, z, y - 2 AS y, x - 1 AS x, v FROM vox WHERE c = 1 AND z < 4 AND y >= 2 AND y < 12 AND x >= 1 AND x < 3", "t c z y x v"))
def slice_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return spec(v, (0, 1, slice(0, 4), slice(2, 12), slice(1, 3))).apply(v)


@query(vox("SELECT t, c, (z - 1) // 2 AS z, y // 3 AS y, x // 2 AS x, v FROM vox WHERE z >= 1 AND (z - 1) % 2 = 0 AND y % 3 = 0 AND x < 5 AND x % 2 = 0", "t c z y x v"))
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return spec(v, (slice(None), slice(None), slice(1, 8, 2), slice(0, 16, 3), slice(0, 5, 2))).apply(v)


@query(vox("SELECT c, y, x - 1 AS x, v FROM vox WHERE z = 3 AND x = 1", "c y x v"))
def slice_stop_only_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    request = {k: "None" for k in slicing.WIRE_KEYS} | {"dset": "orders", "zstop": "3", "xstart": "1", "xstop": "2"}
    _, wanted = slicing.SliceSpec.from_query(request, (1, 2, *shape_of(v)))
    return wanted.apply(v).drop("t", "z")


@query(sql("SELECT o_orderkey, (stop - start + step - 1) // step AS n FROM (SELECT o_orderkey, o_orderkey % 7 AS start, o_orderkey % 7 + o_orderkey % 101 AS stop, o_orderkey % 5 + 1 AS step FROM orders)", "o_orderkey n"))
def slice_out_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start, step = k % 7, k % 5 + 1
    return load(spark, sf_dir, "orders").select(k, slicing.out_size(start, start + k % 101, step).alias("n"))


@query(vox("SELECT y, x, max(CASE WHEN c = 0 THEN v END) AS c0, max(CASE WHEN c = 1 THEN v END) AS c1 FROM vox WHERE z = 0 GROUP BY y, x", "y x c0 c1"))
def combine_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return spec(v, (0, slice(None), 0)).apply(v, squeeze=True).groupBy("y", "x").pivot("c", [0, 1]).max("v").toDF("y", "x", "c0", "c1")


@query(vox("SELECT c, z, y, x, v FROM vox WHERE x IN (SELECT CAST(round_even(i * (n - 1) / 3.0, 0) AS BIGINT) FROM (SELECT unnest(range(0, 4)) AS i, (SELECT max(x) + 1 FROM vox) AS n))", "c z y x v"))
def even_spaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    wanted = v.agg((F.max("x") + 1).alias("n")).select(F.explode(slicing.evenly_spaced(F.col("n"), 4)).alias("x")).distinct()
    return v.join(F.broadcast(wanted), "x", "left_semi").drop("t")


@query(sql("SELECT cc, cz, cy, cx, z0, y0, x0 FROM (SELECT c AS cc, cz, cy, cx, z0, y0, x0, x1 - x0 = 8 AS whole FROM grid) WHERE whole ORDER BY md5('42.0.' || cc || '.' || cz || '.' || cy || '.' || cx) LIMIT 5", "cc cz cy cx z0 y0 x0", ctes=(VOX, GRID)))
def full_chunk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.full_chunk_sample(_chunks(spark, sf_dir), 5).select("cc", "cz", "cy", "cx", "z0", "y0", "x0")


# grids


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = volume(spark, sf_dir).agg((F.max("x") + 1).cast("long").alias("x_size"))
    return size.select(*(F.lit(n).cast("long").alias(f"{a}_size") for a, n in (("t", 1), ("c", 2), ("z", Z), ("y", Y))), "x_size")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.enumerate_grid(_levels(spark, sf_dir), (1, 1, *CHUNK))
    return out.withColumns({"t": F.col("ct"), "c": F.col("cc")})


@query(sql("SELECT c AS cc, cz, cy, cx, z0, z1, y0, y1, x0, x1, x1 - x0 = 8 AS \"full\" FROM grid", "cc cz cy cx z0 z1 y0 y1 x0 x1", rest='"full"', ctes=(VOX, GRID)))
def grid_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("cc", "cz", "cy", "cx", "z0", "z1", "y0", "y1", "x0", "x1", "full")


@query(vox(f"SELECT 1 * 2 * 2 * 2 * ((n + 7) // 8) AS n_chunks, n % 8 AS x_rest, 8 % 4 AS z_rest FROM (SELECT {XS} AS n)", "n_chunks x_rest z_rest"))
def grid_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [F.col(f"{a}_size") for a in "tczyx"]
    n = F.lit(1)
    for size, k in zip(sizes, (1, 1, *CHUNK), strict=True):
        n = n * grid.grid_size(size, k)
    return _levels(spark, sf_dir).select(n.alias("n_chunks"), F.pmod("x_size", F.lit(8)).alias("x_rest"), F.pmod("z_size", F.lit(4)).alias("z_rest"))


NAMES = "names AS (SELECT DISTINCT '0.' || c || '.' || z // 4 || '.' || y // 8 || '.' || x // 8 AS name, c, z // 4 * 4 AS z0, y // 8 * 8 AS y0, x // 8 * 8 AS x0 FROM vox)"


def _names(v: DataFrame) -> DataFrame:
    n = grid.with_chunks(v, CHUNK)
    return n.select(F.concat_ws(".", "t", "c", "cz", "cy", "cx").alias("name")).distinct()


@query(sql(f"SELECT name, c AS c0, c + 1 AS c1, z0, z0 + 4 AS z1, y0, y0 + 8 AS y1, x0, CASE WHEN x0 + 8 < n THEN x0 + 8 END AS x1_open, least(x0 + 8, n) AS x1 FROM names, (SELECT {XS} AS n)", "c0 c1 z0 z1 y0 y1 x0 x1 x1_open", rest="name", ctes=(VOX, NAMES)))
def chunk_name_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    shape = [F.lit(n) for n in (1, 2, *shape_of(v))]
    box = grid.name_to_box(F.col("name"), shape, (1, 1, *CHUNK))
    open_x = grid.name_to_box(F.col("name"), shape, (1, 1, *CHUNK), open_end=True)["x1"]
    return _names(v).select("name", *(box[k].alias(k) for k in ("c0", "c1", "z0", "z1", "y0", "y1", "x0", "x1")), open_x.alias("x1_open"))


NG = "SELECT DISTINCT x0 || '-' || x1 || '_' || y0 || '-' || y1 || '_' || z0 || '-' || z1 AS name FROM grid"


def _box_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, stop = ([F.col(f"{a}{e}") for a in "zyx"] for e in (0, 1))
    return _chunks(spark, sf_dir).where("c = 0").select(grid.box_name(start, stop).alias("name"))


@query(sql(NG, rest="name", ctes=(VOX, GRID)))
def ng_chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_names(spark, sf_dir)


@query(sql(f"SELECT DISTINCT name, x0, x1, y0, y1, z0, z1 FROM grid JOIN ({NG}) ON name = x0 || '-' || x1 || '_' || y0 || '-' || y1 || '_' || z0 || '-' || z1", "x0 x1 y0 y1 z0 z1", rest="name", ctes=(VOX, GRID)))
def ng_name_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_names(spark, sf_dir).select("name", *(c.alias(k) for k, c in grid.box_of_name(F.col("name")).items()))


PADDED = """SELECT c, cz, cy, cx, count(*) AS n, CAST(sum(coalesce(v, 0)) AS BIGINT) AS total, count(*) FILTER (v IS NULL) AS padded
    FROM grid, (SELECT unnest(range(0, 4)) AS dz), (SELECT unnest(range(0, 8)) AS dy), (SELECT unnest(range(0, 8)) AS dx)
    LEFT JOIN (SELECT c AS vc, z, y, x, v FROM vox) AS w ON w.vc = c AND w.z = z0 + dz AND w.y = y0 + dy AND w.x = x0 + dx GROUP BY ALL"""


@query(sql(PADDED, "c cz cy cx n total padded", ctes=(VOX, GRID)))
def pad_chunk_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grid.with_chunks(volume(spark, sf_dir), CHUNK)
    local = v.select("c", "cz", "cy", "cx", *(F.pmod(a, F.lit(k)).alias(a) for a, k in zip("zyx", CHUNK, strict=True)), F.col("v"), F.lit(1).alias("there"))
    dense = grid.densify(local, CHUNK, ["c", "cz", "cy", "cx"])
    return dense.groupBy("c", "cz", "cy", "cx").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count_if(F.col("there").isNull()).alias("padded"))


@query(vox(f"SELECT z0 AS start, least(3, n - z0) AS depth FROM (SELECT n, unnest(range(0, n, 3)) AS z0 FROM (SELECT {XS} AS n))", "start depth"))
def shard_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select(F.inline(grid.shards(F.col("x_size"), 3)))


@query(vox("SELECT x, y, x - x % 3 AS shard, x % 3 AS place, count(*) AS n FROM vox GROUP BY ALL", "x y shard place n"))
def index_to_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard, at = grid.shard_of(F.col("x"), 3)
    return volume(spark, sf_dir).groupBy("x", "y", shard.alias("shard"), at.alias("place")).agg(F.count("*").alias("n"))


@query(vox("SELECT cz, cy, cx, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT z // 2 AS cz, y // 4 AS cy, x // 3 AS cx, c, v FROM vox) GROUP BY ALL", "cz cy cx c n total"))
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.with_chunks(volume(spark, sf_dir), (2, 4, 3)).groupBy("cz", "cy", "cx", "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(sql("SELECT c, cz, cy, cx, greatest(z0 - 2, 0) AS z_low, least(z1 + 2, 8) AS z_high, greatest(x0 - 2, 0) AS x_low, least(x1 + 2, n) AS x_high, x0 - greatest(x0 - 2, 0) AS x_before, least(x1 + 2, n) - x1 AS x_after FROM grid, (SELECT (SELECT max(x) + 1 FROM vox) AS n)", "c cz cy cx z_low z_high x_low x_high x_before x_after", ctes=(VOX, GRID)))
def halo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = grid.halo(F.col("z0"), F.col("z1"), F.col("z_size"), 2)
    x = grid.halo(F.col("x0"), F.col("x1"), F.col("x_size"), 2)
    return _chunks(spark, sf_dir).select("c", "cz", "cy", "cx", z[0].alias("z_low"), z[1].alias("z_high"), x[0].alias("x_low"), x[1].alias("x_high"), x[2].alias("x_before"), x[3].alias("x_after"))


@query(sql("SELECT c, cz, cy, cx, (z1 - z0) * (y1 - y0) * (x1 - x0) * 2 AS bytes FROM grid", "c cz cy cx bytes", ctes=(VOX, GRID)))
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.array(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "zyx"))
    return _chunks(spark, sf_dir).select("c", "cz", "cy", "cx", F.aggregate(sides, F.lit(2).cast("long"), lambda a, n: a * n).alias("bytes"))


@query("SELECT conv_id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) // 3 AS BIGINT) AS batch, turn FROM conversations")
def group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return load(spark, sf_dir, "conversations").select("conv_id", F.floor((F.row_number().over(order) - 1) / 3).alias("batch"), "turn")


@query(vox("SELECT src, t, c, z, y, x, v FROM (SELECT 0 AS src, t, c, z, y, x, v FROM vox WHERE z < 4 UNION ALL SELECT 1 AS src, t, c, z - 4 + 4 AS z, y, x, v FROM vox WHERE z >= 4) WHERE y = 3", "src t c z y x v"))
def virtual_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    parts = [v.where("z < 4").withColumn("src", F.lit(0)), v.where("z >= 4").withColumn("z", F.col("z") - 4).withColumn("src", F.lit(1)).withColumn("z", F.col("z") + 4)]
    return parts[0].unionByName(parts[1]).where("y = 3")


# values


@query(vox("SELECT c, z, y, x, v >> 8 AS v FROM vox", "c z y x v"))
def u16_to_u8_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select("c", "z", "y", "x", values.convert(F.col("v"), "uint16", "uint8").alias("v"))


SMALL = "small AS (SELECT c, z, y, x, CASE WHEN x // 8 % 2 = 0 THEN v % 200 ELSE v END AS v FROM vox)"


@query(sql("SELECT c, z, y, x, CASE WHEN max(v) OVER (PARTITION BY c, z // 4, y // 8, x // 8) < 256 THEN v ELSE v >> 8 END AS v FROM small", "c z y x v", ctes=(VOX, SMALL)))
def u16_to_u8_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grid.with_chunks(volume(spark, sf_dir), CHUNK).withColumn("v", F.when(F.col("cx") % 2 == 0, F.col("v") % 200).otherwise(F.col("v")))
    top = values.chunk_max(F.col("v"), "c", "cz", "cy", "cx")
    return v.select("c", "z", "y", "x", values.convert(F.col("v"), "uint16", "uint8", top).alias("v"))


@query(vox("SELECT c, z, y, x, (v >> 8) * 257 AS v FROM vox", "c z y x v"))
def u8_to_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = volume(spark, sf_dir).withColumn("v", values.convert(F.col("v"), "uint16", "uint8"))
    return low.select("c", "z", "y", "x", values.convert(F.col("v"), "uint8", "uint16").alias("v"))


@query(vox("SELECT c, z, y, x, v / 65535.0::DOUBLE AS v FROM vox", "c z y x", "v"))
def u16_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select("c", "z", "y", "x", values.convert(F.col("v"), "uint16", "float64").alias("v"))


@query(sql("SELECT y, x, least(greatest(round_even(v * 65535, 0), 0), 65535) AS v FROM emb", "y x v", ctes=(EMB,)))
def float_to_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return float_matrix(spark, sf_dir).select("y", "x", values.convert(F.col("v"), "float64", "uint16").alias("v"))


@query(vox("SELECT c, z, y, x, round_even(v * 254.0::DOUBLE / 65534.0::DOUBLE, 0) AS v FROM vox", "c z y x v"))
def rescale_value_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select("c", "z", "y", "x", values.rescale(F.col("v").cast("double"), "uint16", "uint8").alias("v"))


@query(vox("SELECT c, y, greatest(min(v) // 2, 0) AS low, least(max(v) * 2, 65535) AS high FROM vox GROUP BY c, y", "c y low high"))
def display_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = values.integer_window(F.col("vmin"), F.col("vmax"), 65535)
    return reduce.channel_range(volume(spark, sf_dir), ("c", "y")).select("c", "y", low.alias("low"), high.alias("high"))


@query(sql("SELECT x, CASE WHEN s > 1 THEN s / 2 WHEN s <= 0 THEN s * 2 ELSE s END AS low, CASE WHEN e > 1 THEN e * 2 WHEN e < 1 THEN e / 2 ELSE e END AS high FROM (SELECT x, min(v) AS s, max(v) AS e FROM emb GROUP BY x)", "x", "low high", ctes=(EMB,)))
def display_window_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = values.float_window(F.col("vmin"), F.col("vmax"))
    return reduce.channel_range(float_matrix(spark, sf_dir), ("x",)).select("x", low.alias("low"), high.alias("high"))


@query(sql("SELECT y, x, least(greatest(round_even(v * 100, 0), 0), 9) AS i FROM emb", "y x i", ctes=(EMB,)))
def clamp_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return float_matrix(spark, sf_dir).select("y", "x", values.clamp_index(F.col("v") * 100, 10).alias("i"))


# reductions


@query(vox("SELECT t, c, min(v) AS vmin, max(v) AS vmax, count(*) AS n FROM vox GROUP BY t, c", "t c vmin vmax n"))
def channel_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.channel_range(volume(spark, sf_dir))


@query(vox("SELECT c - 1 AS c, min(CASE WHEN v > 0 THEN v END) AS vmin, max(CASE WHEN v > 0 THEN v END) AS vmax, count(*) AS n FROM vox WHERE c = 1 AND z < 4 AND y >= 2 AND y < 12 AND x >= 1 AND x < 4 AND (x - 1) % 2 = 0 GROUP BY c", "c vmin vmax n"))
def channel_minmax_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return reduce.channel_range(spec(v, (0, 1, slice(0, 4), slice(2, 12), slice(1, 4, 2))).apply(v), ("c",), nonzero=True)


@query(vox("SELECT t, c, min(CASE WHEN v > 0 THEN v END) AS vmin, max(CASE WHEN v > 0 THEN v END) AS vmax, count(*) AS n FROM vox GROUP BY t, c", "t c vmin vmax n"))
def channel_range_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.channel_range(volume(spark, sf_dir), nonzero=True)


@query(vox("SELECT c, y, CASE WHEN y % 3 = 0 THEN y ELSE min(v) END AS vmin, CASE WHEN y % 3 = 0 THEN y + 100 ELSE max(v) END AS vmax, y % 3 <> 0 AS computed FROM vox GROUP BY c, y", "c y", "vmin vmax", "computed"))
def channel_range_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    kept = v.where("y % 3 = 0").select("c", "y").distinct().select("c", "y", F.col("y").alias("vmin"), (F.col("y") + 100).alias("vmax"))
    return reduce.stored_range(v, kept, ("c", "y"))


@query(vox("SELECT c, v // 4096 AS bin, count(*) AS n FROM vox GROUP BY ALL", "c bin n"))
def channel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.histogram(volume(spark, sf_dir), 16, 65535, ("c",))


@query(sql("SELECT t, c, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, event_type AS c, value FROM events) GROUP BY t, c", "t n", "vmin vmax", "c"))
def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = load(spark, sf_dir, "events").select(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), F.col("event_type").alias("c"), F.col("value").alias("v"))
    return reduce.channel_range(cube)


# pyramids


@query(vox("SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, v FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0", "c z y x v"))
def decimate_from_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.decimate(volume(spark, sf_dir)).drop("t")


@query(vox("SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, v FROM vox WHERE z % 2 = 1 AND y % 2 = 1 AND x % 2 = 1", "c z y x v"))
def decimate_from_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.decimate(volume(spark, sf_dir), offset=1).drop("t")


@query(vox("SELECT r, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT r, c, v FROM vox, (SELECT unnest(range(0, 3)) AS r) WHERE z % (1 << r) = 0 AND y % (1 << r) = 0 AND x % (1 << r) = 0) GROUP BY r, c", "r c n total"))
def decimated_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.decimated_pyramid(volume(spark, sf_dir), 3).groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _mean_sql(levels: int) -> str:
    ctes, n = [VOX, f"m0 AS (SELECT c, z, y, x, v, 8 AS nz, 16 AS ny, {XS} AS nx FROM vox)"], levels
    for k in range(1, n + 1):
        ctes.append(f"m{k} AS (SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, CAST(round_even(sum(v) / 8.0::DOUBLE, 0) AS BIGINT) AS v, any_value(nz) // 2 AS nz, any_value(ny) // 2 AS ny, any_value(nx) // 2 AS nx FROM m{k - 1} WHERE z < nz // 2 * 2 AND y < ny // 2 * 2 AND x < nx // 2 * 2 GROUP BY c, z // 2, y // 2, x // 2)")
    return sql(f"SELECT c, z, y, x, v FROM m{n}", "c z y x v", ctes=tuple(ctes))


def _mean(levels: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = volume(spark, sf_dir)
        return pyramid.mean_levels(v, shape_of(v), levels)[-1][0].drop("t")

    run.__name__ = f"mean_pyramid_l{levels}"
    return run


for _k in (1, 2, 3):
    query(_mean_sql(_k))(_mean(_k))


@query(vox("SELECT c, z // 4 AS z, y // 4 AS y, x // 4 AS x, round_even(sum(v) / 64.0::DOUBLE, 0) AS v FROM vox GROUP BY c, z // 4, y // 4, x // 4", "c z y x v"))
def block_mean_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.block_reduce(volume(spark, sf_dir), (4, 4, 4), edge="zero_pad").drop("t")


@query(vox("SELECT c, z // 3 AS z, y // 3 AS y, x // 3 AS x, round_even(sum(v) / CAST(count(*) AS DOUBLE), 0) AS v FROM vox GROUP BY c, z // 3, y // 3, x // 3", "c z y x v"))
def block_mean_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.block_reduce(volume(spark, sf_dir), (3, 3, 3), edge="partial").drop("t")


# neighbourhoods


BOX3 = """SELECT g.c, g.z, g.y, g.x, CAST(sum(w.v) AS BIGINT) AS v FROM dense g, (SELECT unnest(range(-1, 2)) AS dz), (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)
    JOIN (SELECT c AS wc, z AS wz, y AS wy, x AS wx, v FROM dense) w ON w.wc = g.c AND w.wz = g.z + dz AND w.wy = g.y + dy AND w.wx = g.x + dx GROUP BY ALL"""


@query(sql(BOX3, "c z y x v", ctes=(VOX, DENSE)))
def box3_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return neighborhood.box_sum(v, shape_of(v)).drop("t").withColumn("v", F.col("v").cast("long"))


@query(vox(f"SELECT c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(z) AS z0, max(z) AS z1, min(x) AS x0, max(x) - n AS x1 FROM (SELECT c, unnest(list_filter([z, CASE WHEN z < 1 THEN -1 - z END, CASE WHEN z >= 7 THEN 15 - z END], lambda q: q IS NOT NULL)) AS z, y, x, v, n FROM (SELECT c, z, unnest(list_filter([y, CASE WHEN y < 1 THEN -1 - y END, CASE WHEN y >= 15 THEN 31 - y END], lambda q: q IS NOT NULL)) AS y, x, v, n FROM (SELECT c, z, y, unnest(list_filter([x, CASE WHEN x < 1 THEN -1 - x END, CASE WHEN x >= n - 1 THEN 2 * n - 1 - x END], lambda q: q IS NOT NULL)) AS x, v, n FROM vox, (SELECT {XS} AS n)))) GROUP BY c, n", "c n total z0 z1 x0 x1"))
def mirror_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    shape = shape_of(v)
    return neighborhood.mirror_pad(v, shape, 1).groupBy("c").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("x").alias("x0"), (F.max("x") - shape[2]).alias("x1"))


SIGMA = 0.5
def _blur(axis: str, n: str, source: str, name: str) -> str:
    rest = [a for a in "zyx" if a != axis]
    rows = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in zip(range(-2, 3), neighborhood.gaussian_weights(SIGMA), strict=True))
    return f"""{name} AS (SELECT g.c, {', '.join(f'g.{a}' for a in rest)}, g.{axis}, sum(s.v * w) AS v FROM {source} g, (VALUES {rows}) k(d, w)
        JOIN {source} s ON s.c = g.c AND {' AND '.join(f's.{a} = g.{a}' for a in rest)} AND s.{axis} = least(greatest(g.{axis} + d, 0), {n} - 1) GROUP BY g.c, g.z, g.y, g.x)"""


BLURRED = (VOX, DENSE, _blur("z", "8", "dense", "b1"), _blur("y", "16", "b1", "b2"), _blur("x", "(SELECT max(x) + 1 FROM vox)", "b2", "b3"))


@query(sql("SELECT c, z, y, x, round(v, 3) AS v FROM b3", "c z y x", "v", ctes=BLURRED))
def gaussian_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return neighborhood.gaussian(v, shape_of(v), SIGMA).select("c", "z", "y", "x", F.round("v", 3).alias("v"))


@query(sql("SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(v, 3) AS v FROM b3 WHERE z % 2 = 1 AND y % 2 = 1 AND x % 2 = 1", "c z y x", "v", ctes=BLURRED))
def blur_and_decimate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian in small tiles with halos, then every second voxel from 1 on."""
    v = volume(spark, sf_dir)
    blurred = neighborhood.gaussian(v, shape_of(v), SIGMA, tile=(4, 8, 16))
    return pyramid.decimate(blurred, offset=1).select("c", "z", "y", "x", F.round("v", 3).alias("v"))


@query(vox(f"SELECT c, z, y, x, CASE WHEN z = 3 OR y = 7 OR x = n // 2 - 1 AND n % 2 = 0 THEN 0 ELSE v END AS v FROM (SELECT c, z // 2 AS z, y // 2 AS y, x // 2 AS x, any_value(n) AS n, round_even(sum(v) / 8.0::DOUBLE, 0) AS v FROM vox, (SELECT {XS} AS n) WHERE x < n // 2 * 2 GROUP BY c, z // 2, y // 2, x // 2)", "c z y x v"))
def mean_even_edge_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    return pyramid.mean_once(v, shape_of(v), even_edge_zero=True)[0].drop("t")


FIELD = "field AS (SELECT DISTINCT z, y, x, z * 1.5::DOUBLE AS fz, y * 0.5::DOUBLE AS fy, x + 2.0::DOUBLE AS fx FROM vox)"


@query(sql(f"SELECT c, tz AS z, ty AS y, tx AS x, arg_max(v, (z * 16 + y) * n + x) AS v FROM (SELECT c, z, y, x, v, n, least(greatest(round_even(fz, 0), 0), 7) AS tz, least(greatest(round_even(fy, 0), 0), 15) AS ty, least(greatest(round_even(fx, 0), 0), n - 1) AS tx FROM vox JOIN field USING (z, y, x), (SELECT {XS} AS n)) GROUP BY c, tz, ty, tx", "c z y x v", ctes=(VOX, FIELD)))
def deform_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    field = v.select("z", "y", "x").distinct().select("*", (F.col("z") * 1.5).alias("fz"), (F.col("y") * 0.5).alias("fy"), (F.col("x") + 2.0).alias("fx"))
    return neighborhood.scatter(v, field, shape_of(v)).drop("t")


@query(vox(f"SELECT c, oz AS z, oy AS y, x, v FROM vox, (SELECT unnest(range(0, 5)) AS oz), (SELECT unnest(range(0, 20)) AS oy) WHERE z = CAST(floor((oz + 0.5) * 8 / 5) AS BIGINT) AND y = CAST(floor((oy + 0.5) * 16 / 20) AS BIGINT)", "c z y x v"))
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    shape = shape_of(v)
    return neighborhood.resize_nearest(v, shape, (5, 20, shape[2])).drop("t")


def _spline(name: str, n: int, m: int) -> str:
    """Weights of a cubic spline of n voxels at m places, as ``neighborhood.cubic_weights`` makes them."""
    period = 2 * n - 2
    return f"""{name} AS (SELECT least(q, {period} - q) AS source, i AS target, sum(basis * sqrt(3.0) * CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END * pow(2 - sqrt(3.0), abs(step))) AS w
        FROM (SELECT *, ((k + step) % {period} + {period}) % {period} AS q FROM (SELECT *, CASE WHEN d < 1 THEN 2 / 3.0::DOUBLE - d * d + d * d * d / 2 WHEN d < 2 THEN (2 - d) * (2 - d) * (2 - d) / 6 ELSE 0 END AS basis
        FROM (SELECT *, abs(place - k) AS d FROM (SELECT *, CAST(floor(place) AS BIGINT) + more AS k FROM (SELECT i, (i + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE AS place FROM (SELECT unnest(range(0, {m})) AS i)), (SELECT unnest(range(-1, 3)) AS more)))),
        (SELECT unnest(range(-27, 28)) AS step) WHERE basis > 0) GROUP BY least(q, {period} - q), i)"""


SPLINED = (VOX, DENSE, _spline("wz", 8, 5), _spline("wy", 16, 20), "bounds AS (SELECT min(v) AS low, max(v) AS high FROM dense)", "az AS (SELECT c, target AS z, y, x, sum(v * w) AS v FROM dense JOIN wz ON source = z GROUP BY c, target, y, x)")


@query(sql("SELECT c, z, y, x, round(least(greatest(v, low), high), 3) AS v FROM (SELECT c, z, target AS y, x, sum(v * w) AS v FROM az JOIN wy ON source = y GROUP BY c, z, target, x), bounds", "c z y x", "v", ctes=SPLINED))
def resize_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic splines along two axes."""
    v = volume(spark, sf_dir)
    shape = shape_of(v)
    dense = grid.densify(v.drop("t"), shape, ["c"]).withColumn("t", F.lit(0))
    return neighborhood.resize_cubic(dense, shape, (5, 20, shape[2])).select("c", "z", "y", "x", F.round("v", 3).alias("v"))


# metadata


LEVELS = f"levels AS (SELECT 'orders' AS dataset, 'uint16' AS dtype, '<u2' AS code, r, 8 >> r AS Z, 16 >> r AS Y, n >> r AS X, 0.3::DOUBLE * (1 << r) AS res, 1.0::DOUBLE * (1 << r) AS res_z FROM (SELECT {XS} AS n), (SELECT unnest(range(0, 3)) AS r))"


def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = volume(spark, sf_dir).agg((F.max("x") + 1).alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2))))
    two = F.pow(F.lit(2), F.col("r"))
    shift = lambda n: F.floor(n / two).cast("int")
    return one.select(F.lit("orders").alias("dataset"), F.lit("uint16").alias("dtype"), F.lit("<u2").alias("dtype_code"), "r", F.lit(1).alias("T"), F.lit(2).alias("C"), shift(F.lit(Z)).alias("Z"), shift(F.lit(Y)).alias("Y"), shift(F.col("n")).alias("X"), *(F.lit(k).alias(f"k{a}") for a, k in zip("zyx", CHUNK, strict=True)), values.synthetic_resolution(1.0, F.col("r")).alias("res_z"), *(values.synthetic_resolution(0.3, F.col("r")).alias(f"res_{a}") for a in "yx"))


@query(sql("SELECT dataset, r, res, CASE WHEN r = 0 THEN 0 ELSE lag(res) OVER (PARTITION BY dataset ORDER BY r) END AS translation FROM levels", "r", "res translation", "dataset", ctes=(VOX, LEVELS)))
def level_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.level_translation(level_table(spark, sf_dir).select("dataset", "r", F.col("res_x").alias("res")))


@query(sql("""SELECT r, '{"chunks":[1,1,4,8,8],"compressor":null,"dimension_separator":"/","dtype":"' || code || '","fill_value":0,"filters":null,"order":"C","shape":[1,2,' || Z || ',' || Y || ',' || X || '],"zarr_format":2}' AS zarray FROM levels""", "r", rest="zarray", ctes=(VOX, LEVELS)))
def zarray_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.zarray(level_table(spark, sf_dir)).select("r", "zarray")


@query(sql("""SELECT r, '[' || X || ',' || Y || ',' || Z || ']' AS size, res * 1000 AS nm_x, res_z * 1000 AS nm_z, 'raw' AS encoding, 2 AS num_channels, 'uint16' AS data_type FROM levels""", "r num_channels", "nm_x nm_z", "size encoding data_type", ctes=(VOX, LEVELS)))
def info_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = metadata.precomputed_info(level_table(spark, sf_dir))
    schema = "data_type string, num_channels int, type string, scales array<struct<chunk_sizes:array<array<int>>,encoding:string,key:string,resolution:array<double>,size:array<int>,voxel_offset:array<int>>>"
    doc = info.select(F.from_json("info", schema).alias("i")).select("i.data_type", "i.num_channels", F.explode("i.scales").alias("s"))
    return doc.select(F.col("s.key").cast("long").alias("r"), F.to_json("s.size").alias("size"), F.col("s.resolution")[0].alias("nm_x"), F.col("s.resolution")[2].alias("nm_z"), "s.encoding", "num_channels", "data_type")


# encoded chunks


BYTES = """bytes AS (SELECT c, z // 4 AS cz, y // 8 AS cy, x // 8 AS cx, string_agg(lpad(to_hex(v % 256), 2, '0') || lpad(to_hex(v // 256), 2, '0'), '' ORDER BY z, y, x) AS h FROM stored GROUP BY ALL)"""


@query(sql("SELECT c, cz, cy, cx, md5(unhex(h)) AS digest FROM bytes", "c cz cy cx", rest="digest", ctes=(VOX, DENSE, STORED, BYTES)))
def chunk_payload_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.encode import chunks_of

    v = volume(spark, sf_dir)
    return chunks_of(v, CHUNK, "uint16", shape=shape_of(v)).select("c", "cz", "cy", "cx", F.md5("payload").alias("digest"))


@query(sql("SELECT c, z, y, x, v FROM stored", "c z y x v", ctes=(VOX, DENSE, STORED)))
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.encode import chunks_of, voxels_of

    v = volume(spark, sf_dir)
    shape = shape_of(v)
    return voxels_of(chunks_of(v, CHUNK, "uint16", "blosc"), CHUNK, shape, "uint16").select("c", "z", "y", "x", "v")


@query(sql("SELECT c, cz, cy, cx, 128 + 2 * 256 AS raw_bytes, n FROM (SELECT c, z // 4 AS cz, y // 8 AS cy, x // 8 AS cx, count(*) AS n FROM vox GROUP BY ALL)", "c cz cy cx raw_bytes n", ctes=(VOX,)))
def npy_payload_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.encode import chunks_of, npy_payload

    chunks = chunks_of(volume(spark, sf_dir), CHUNK, "uint16")
    return npy_payload(chunks, CHUNK).select("c", "cz", "cy", "cx", "raw_bytes").join(chunks.select("c", "cz", "cy", "cx", "n"), ["c", "cz", "cy", "cx"])


def _orders(v: DataFrame, levels: int = 1) -> ArrayDataset:
    z, y, x = shape_of(v)
    return ArrayDataset("orders", "uint16", 1, 2, tuple(Level(r, (z >> r, y >> r, x >> r), CHUNK) for r in range(levels)))


@query(sql("SELECT c, z, y, x, v FROM stored WHERE c = 1 AND z >= 4", "c z y x", "v", ctes=(VOX, DENSE, STORED)))
def zarr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.zarr import read_zarr, write_zarr

    v = volume(spark, sf_dir)
    uri = scratch_path(spark, "orders.ome.zarr")
    write_zarr([v], _orders(v), uri)
    return read_zarr(spark, uri).where("r = 0 and c = 1 and cz >= 1").select("c", "z", "y", "x", "v")


@query(sql("SELECT c, z, y, x, CASE WHEN z = 3 THEN 65535 - v ELSE v END AS v FROM stored", "c z y x", "v", ctes=(VOX, DENSE, STORED)))
def zarr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that are no whole chunks, written one after the other into a store of dotted names, Fortran order and Blosc chunks."""
    from ..sources.zarr import create_zarr, read_zarr, write_region

    v = volume(spark, sf_dir)
    uri = scratch_path(spark, "regions.ome.zarr")
    create_zarr(_orders(v), uri, "blosc", separator=".", order="F")
    dense = grid.densify(v.drop("t"), shape_of(v), ["c"]).withColumn("t", F.lit(0))
    chunks = grid.with_chunks(dense, CHUNK).join(grid.with_chunks(v, CHUNK).select("c", "cz", "cy", "cx").distinct(), ["c", "cz", "cy", "cx"], "left_semi")
    write_region(chunks.where("z < 6"), uri)
    write_region(chunks.where("z >= 5"), uri)
    write_region(chunks.where("z = 3").withColumn("v", F.lit(65535) - F.col("v")), uri)
    return read_zarr(spark, uri).where("r = 0").select("c", "z", "y", "x", "v")


@query(sql("SELECT c, z, y, x, CASE WHEN z BETWEEN 3 AND 4 THEN 65535 - v ELSE v END AS v FROM dense", "c z y x", "v", ctes=(VOX, DENSE)))
def virtual_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume over two stores, one above the other, also written as one where they meet."""
    from ..sources.config import virtual_dataset, write_virtual
    from ..sources.zarr import create_zarr

    v = volume(spark, sf_dir)
    shape = shape_of(v)
    parts = [(f"{scratch_path(spark, 'part')}.ome.zarr", {"z": 4 * k}) for k in range(2)]
    for uri, _ in parts:
        create_zarr(ArrayDataset("part", "uint16", 1, 2, (Level(0, (4, *shape[1:]), CHUNK),)), uri)
    dense = grid.densify(v.drop("t"), shape, ["c"]).withColumn("t", F.lit(0))
    write_virtual(dense, parts)
    write_virtual(dense.where("z BETWEEN 3 AND 4").withColumn("v", F.lit(65535) - F.col("v")), parts)
    return virtual_dataset(spark, parts).select("c", "z", "y", "x", "v")


@query(sql("SELECT r, c, z, y, x, v FROM (SELECT 0 AS r, c, z, y, x, v FROM stored UNION ALL SELECT 1 AS r, c, z // 2, y // 2, x // 2, v FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0) WHERE v > 0", "r c z y x", "v", ctes=(VOX, DENSE, STORED)))
def multiscale_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lazy table a level of a store, and all of them under a registered name."""
    from ..sources.config import level_views, register_dataset
    from ..sources.zarr import write_zarr

    v = volume(spark, sf_dir)
    uri, small = f"{scratch_path(spark, 'views')}.ome.zarr", pyramid.decimate(v)
    ds = _orders(v, 2)
    ds = replace(ds, levels=(ds.levels[0], replace(ds.levels[1], shape=tuple(-(-n // 2) for n in ds.levels[0].shape))))
    write_zarr([v, small], ds, uri, "null")
    views, key = level_views(spark, uri), register_dataset(spark, uri)
    both = views[0].unionByName(spark.table(key).where("r = 1"))
    return both.where("v > 0").select("r", "c", "z", "y", "x", "v")


@query(sql("SELECT c, z, y, x, v FROM stored", "c z y x v", ctes=(VOX, DENSE, STORED)))
def zsharded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.zshard import read_zsharded, write_zsharded

    v = volume(spark, sf_dir)
    uri = scratch_path(spark, "orders.z_sharded")
    write_zsharded([v], _orders(v), uri)
    return read_zsharded(spark, uri).select("c", "z", "y", "x", "v")


@query(vox("SELECT c, z, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM vox GROUP BY c, z", "c z n total"))
def tiff_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.encode import planes
    from ..sources.tiff import planes_to_voxels

    v = volume(spark, sf_dir)
    files = planes(v, shape_of(v), "uint16").withColumnRenamed("tiff", "content")
    return planes_to_voxels(files).join(v.select("c", "z", "y", "x"), ["c", "z", "y", "x"], "left_semi").groupBy("c", "z").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(sql("SELECT c, z, y, x, v FROM dense", "c z y x v", ctes=(VOX, DENSE)))
def tiff_stack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as files by tasks, in folders of times and channels, and read back as a stack."""
    from ..operators.encode import planes
    from ..sources.stores import Store
    from ..sources.tiff import read_stack

    v = volume(spark, sf_dir)
    uri = scratch_path(spark, "stack")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n = Store(uri), 0
        for batch in batches:
            for t, c, z, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                store.write(f"T{t}/CH{c}/plane{z:05d}.tif", data)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    planes(v, shape_of(v), "uint16").mapInArrow(write, "n long").collect()
    return read_stack(spark, uri).select("c", "z", "y", "x", "v")


@query(sql("SELECT t, c, z - 2 AS z, y // 2 AS y, x - 1 AS x, v FROM (SELECT 0 AS t, * FROM dense) WHERE z >= 2 AND z < 7 AND y % 2 = 0 AND x >= 1", "t c z y x", "v", ctes=(VOX, DENSE)))
def remote_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of an array whose chunks lie behind URLs: only those that it touches are fetched."""
    from ..operators.encode import chunks_of, npy_payload
    from ..sources.remote import read_remote
    from ..sources.stores import Store

    v = volume(spark, sf_dir)
    uri, ds = scratch_path(spark, "remote"), _orders(v)
    dense = grid.densify(v.drop("t"), shape_of(v), ["c"]).withColumn("t", F.lit(0))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n = Store(uri), 0
        for batch in batches:
            for c, cz, cy, cx, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                store.write(f"{c}-{cz}-{cy}-{cx}", data)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    npy_payload(chunks_of(dense, CHUNK, "uint16"), CHUNK).select("c", "cz", "cy", "cx", "payload").mapInArrow(write, "n long").collect()
    wanted = spec(v, (0, slice(None), slice(2, 7), slice(0, 16, 2), slice(1, shape_of(v)[2])))
    place = uri if "://" in uri else f"file://{uri}"
    return read_remote(spark, ds, f"{place}/{{c}}-{{cz}}-{{cy}}-{{cx}}", wanted, 128 + 2 * 256)


@query(vox("""SELECT string_agg('#uicontrol bool channel' || c || '_visible checkbox(default=true);' || chr(10) || '#uicontrol vec3 channel' || c || '_color color(default="#' || CASE c WHEN 0 THEN 'FF0000' ELSE '00FF00' END || '");' || chr(10) ||
    '#uicontrol invlerp channel' || c || '(range=[' || low || ', ' || high || '], window=[0, 65535], channel=' || c || ');', chr(10) ORDER BY c) || chr(10) || 'void main() {' || chr(10) || '    vec3 total = vec3(0.0);' || chr(10) ||
    string_agg('    if (channel' || c || '_visible) total += channel' || c || '_color * channel' || c || '();', chr(10) ORDER BY c) || chr(10) || '    emitRGB(min(total, vec3(1.0)));' || chr(10) || '}' AS shader
    FROM (SELECT c, min(v) FILTER (v > 0) AS low, max(v) FILTER (v > 0) AS high FROM vox GROUP BY c)""", rest="shader"))
def shader_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the non-zero range of each channel, of which there are few."""
    ranges = reduce.channel_range(volume(spark, sf_dir), ("c",), nonzero=True).orderBy("c").collect()
    return spark.createDataFrame([(metadata.shader([{"vmin": r["vmin"], "vmax": r["vmax"]} for r in ranges]),)], "shader string")


@query(sql("SELECT x, round_even((hi - lo) / n, 3) AS size, round_even((hi - lo) / n, 3) * 1000 AS nm FROM (SELECT x, min(v) AS lo, max(v) AS hi, count(*) AS n FROM emb GROUP BY x)", "x", "size nm", ctes=(EMB,)))
def voxel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = reduce.channel_range(float_matrix(spark, sf_dir), ("x",))
    size = values.voxel_size(F.col("vmin"), F.col("vmax"), F.col("n"))
    return by.select("x", size.alias("size"), values.nanometres(F.array(size))[0].alias("nm"))
