"""Arrays and entries derived from the supplied tables, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import load

Query = Callable[[SparkSession, str], DataFrame]
CHUNK = (4, 8, 8)
Z, Y = 8, 16

#: A volume over orders: two channels, 8 x 16 x (a 256th of the orders), 16-bit values.
VOX = """vox AS (SELECT CAST(0 AS BIGINT) AS t, o_orderkey % 2 AS c, o_orderkey // 2 % 8 AS z, o_orderkey // 16 % 16 AS y, o_orderkey // 256 AS x,
    CAST(floor(o_totalprice) AS BIGINT) % 65536 AS v FROM orders)"""
#: Every place of that volume, 0 where there is no voxel; and its chunks that hold any.
DENSE = """dense AS (SELECT g.c, g.z, g.y, g.x, coalesce(vox.v, 0) AS v FROM (SELECT c, z, y, x FROM (SELECT unnest(range(0, 2)) AS c), (SELECT unnest(range(0, 8)) AS z),
    (SELECT unnest(range(0, 16)) AS y), (SELECT unnest(range(0, (SELECT max(x) + 1 FROM vox))) AS x)) g LEFT JOIN vox ON vox.c = g.c AND vox.z = g.z AND vox.y = g.y AND vox.x = g.x)"""
STORED = "stored AS (SELECT dense.* FROM dense WHERE (c, z // 4, y // 8, x // 8) IN (SELECT DISTINCT (c, z // 4, y // 8, x // 8) FROM vox))"
#: Floats: one row a vector, one column a component.
EMB = "emb AS (SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
#: Files and folders: root / language / name.
ENTRIES = """entries AS (SELECT '/' || source || '/' || lang AS parent, '/' || source || '/' || lang || '/' || name AS path, name, doc_id % 5 = 0 AS is_dir, n_chars AS size, doc_id
    FROM (SELECT *, 'scan ' || doc_id || CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '.OME.zarr' ELSE '' END WHEN 1 THEN '.ims' WHEN 2 THEN '.tif' WHEN 3 THEN '.txt' ELSE '.z_sharded' END AS name FROM documents))"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    half = lambda n: F.floor(k / n).cast("int")
    return load(spark, sf_dir, "orders").select(
        F.lit(0).alias("t"), (k % 2).cast("int").alias("c"), (half(2) % 8).alias("z"), (half(16) % 16).alias("y"), half(256).alias("x"),
        (F.floor("o_totalprice").cast("int") % 65536).alias("v"),
    )


def shape_of(voxels: DataFrame) -> tuple[int, int, int]:
    """z, y, x of the volume; one small aggregate, as opening a dataset is."""
    return (Z, Y, voxels.agg(F.max("x")).first()[0] + 1)


def float_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    end = F.when(kind == 0, F.when(F.col("doc_id") % 2 == 0, ".OME.zarr").otherwise("")).when(kind == 1, ".ims").when(kind == 2, ".tif").when(kind == 3, ".txt").otherwise(".z_sharded")
    name = F.concat(F.lit("scan "), F.col("doc_id"), end)
    parent = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    modified = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600)
    return load(spark, sf_dir, "documents").select(parent.alias("parent"), F.concat(parent, F.lit("/"), name).alias("path"), name.alias("name"), (kind == 0).alias("is_dir"), F.col("n_chars").alias("size"), "doc_id", modified.alias("modified"))


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as longs and floats as doubles rounded to 6 digits, so that both engines print them alike."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql(body: str, longs: str = "", doubles: str = "", rest: str = "", ctes: tuple[str, ...] = ()) -> str:
    """``body`` with its columns cast: whole numbers, doubles to 6 digits, and the rest as they are."""
    names = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()] + rest.split()
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(names)} FROM ({body})"
