"""Helpers of the training-text operators: stored tables, session settings, names and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import estimated_broadcasts, shared_dir

#: Fixed values of the contracts: white space that separates words, and the same as a character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows in an Arrow batch. Texts have no length limit, so batches are kept short.
BATCH_ROWS = 400


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on; they stay set, since the result runs after the call."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return estimated_broadcasts(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark drop the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, has a known size.

    Nothing reads the shuffles behind the written table again, so they go with the write.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z only; ``lower`` would also change other letters."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in the given order without a window over all rows: sort by range, add the offsets of ranges.

    Only one count per range goes through the driver. Rows must differ in ``order`` for a result that reruns repeat.
    """
    placed = saved(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_at")),
        "ranked",
    )
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_range").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    start = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0)
    return placed.withColumn(name, (start + F.col("_at")).cast("long")).drop("_range", "_at")
