"""New planes of a stack as a stream of voxels. Slices, conversions and chunk numbers are per-row expressions, so they apply
to it as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tiff import planes_to_voxels

PLACE = r"/T(\d+)/CH(\d+)/[^/]*?(\d+)\.tif$"
FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_planes(spark: SparkSession, uri: str, files_per_batch: int = 100) -> DataFrame:
    """Voxels of planes as they land under ``uri``; z is the number that ends the file's name, since a rank needs all files."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").option("maxFilesPerTrigger", files_per_batch).load(uri)
    return planes_to_voxels(files.select(*(F.regexp_extract("path", PLACE, i + 1).cast("int").alias(k) for i, k in enumerate("tcz")), "content"))
