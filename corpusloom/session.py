"""Session settings and the shared folder for tables that a job writes on its way."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = 8, **extra: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


#: Folder for stored tables of each running application. Its application id changes with every restart.
_FOLDERS: dict[str, str] = {}


def _application_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; the driver's JVM drops it when it ends."""
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = _local_root()
        folder = f"{root.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a stored table. A single-JVM run without ``spark.checkpoint.dir`` gets a temporary one."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark drop the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Spark the real size, so that it broadcasts the
    table only when it is small.  Nothing reads the shuffles behind the table again, so they go with the write.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Spark estimates a stored table by its compressed files, and an exploded one as if it kept its rows; so a join side of a few
#: estimated MB may be hundreds. Only small estimates are trusted; adaptive execution measures the others.
BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
#: Rows in an Arrow batch: a batch of whole texts or vectors, and what Python makes of it, is held by each core at once.
BATCH_ROWS = 1024


def bounded_memory(spark: SparkSession) -> SparkSession:
    """Broadcast what is estimated at a megabyte at most, or measured by a shuffle at ten; short batches to Python."""
    for key, value in BROADCASTS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def estimated_broadcasts(spark: SparkSession) -> SparkSession:
    """What the session began with."""
    for key in BROADCASTS:
        spark.conf.unset(key)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for an application, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
