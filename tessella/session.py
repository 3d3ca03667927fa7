"""Session, table loading and lineage cutting shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bounds the Arrow batches that Python workers get, where the session doesn't.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lets Spark delete the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = builder.config(map=defaults | conf).getOrCreate()
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import the package without an install.

    On a cluster the package comes with ``--py-files`` or the image; an unknown folder in the path does no harm.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")  # long texts in batches of ten thousand rows fill a worker's memory
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process
    (tests) a temporary folder takes its place; anywhere else a folder of the driver's machine would be lost on the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of its own under the shared one, which goes with all in it when the driver ends."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    place, fs = _path(spark, folder)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str, *spent: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a directory for each value of ``by``, and read it back.

    Cuts the lineage like a reliable checkpoint, survives lost executors, and keeps column pruning for later reads. The
    write's shuffle files go as soon as it has ended, and so do the tables of ``spent``: earlier results of this
    function that nothing reads any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of results of ``materialize``, which nothing may read any more."""
    for t in tables:
        place, fs = _path(t.sparkSession, t._scratch)
        fs.delete(place.getParent(), True)


def _path(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
