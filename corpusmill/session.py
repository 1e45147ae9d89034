"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", memory: str = "8g", app: str = "corpusmill") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor."""
    root = Path(__file__).resolve().parent
    shipped = {os.path.basename(f) for f in spark.sparkContext.listFiles}
    if f"{root.name}.zip" not in shipped:
        target = os.path.join(tempfile.mkdtemp(prefix="ship-"), root.name)
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root.parent, root.name))
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, empty-so-far path inside the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a session that
    names none (a local test run) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and a function that makes its path objects."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a Python-heavy step enough tasks when its input is a few unsplittable files.

    ``scan`` must be a file scan (with filters or projections at most).  A scan that already has
    a task per core is returned as it is, so large inputs are never shuffled by this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *[F.col(k) for k in keys])


#: Rows of a task whose rows become many.
FEW_ROWS = 50_000


def finely(rows: DataFrame, *keys: str) -> DataFrame:
    """Give narrow rows that a later step turns into many tasks of about ``FEW_ROWS`` rows, however large the splits.

    What a task sorts or holds is then bounded, whatever the size of the table.  The rows are counted first.
    """
    wanted = -(-rows.count() // FEW_ROWS)
    return rows.repartition(wanted, *[F.col(k) for k in keys]) if rows.rdd.getNumPartitions() < wanted else rows
