"""The bounded history fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom import fixed
from corpusloom.operators.memory import newest

#: Batches after which their folders are merged into the base.
MERGE_EVERY = 16


def _folders(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}={n}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _live(spark: SparkSession, table: str, up_to: int | None = None) -> list[str]:
    """The last base and the batches after it, up to a batch."""
    bases = [b for b in _folders(spark, table, "base") if up_to is None or b <= up_to]
    base = bases[-1] if bases else -1
    batches = [b for b in _folders(spark, table, "batch") if b > base and (up_to is None or b <= up_to)]
    return [f"{table}/base={base}"] * bool(bases) + [f"{table}/batch={b}" for b in batches]


def start_memory_stream(
    entries: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "repo_id",
    order: str = "ord",
    keep: int = fixed.MEMORY_ENTRIES,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Append arriving entries to a Parquet table; the newest ``keep`` per key stay, older ones are evicted.

    A batch writes its own newest entries into its own folder.  Every ``merge_every`` batches the base and the folders after
    it become the next base, cut to ``keep`` entries per key, and what it replaces is deleted one merge later; so the table
    follows the number of keys, not of batches, and a batch pays a small part of a merge.  A batch that runs again rewrites
    its folder and, if it merges, the same base from the same folders; a folder that a base covers is never read.  ``order``
    is the insertion order, there is no event time.
    """
    schema = entries.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest(batch, key, order, keep).drop("rank").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if (batch_id + 1) % merge_every:
            return
        parts = _live(spark, table, batch_id)
        if not parts[0].endswith(f"/base={batch_id}"):
            merged = newest(spark.read.schema(schema).parquet(*parts), key, order, keep).drop("rank")
            merged.write.mode("overwrite").parquet(f"{table}/base={batch_id}")
        before = batch_id - merge_every  # the base that this one replaces; it and its readers stay until the next merge
        for kind, last in (("base", before - 1), ("batch", before)):
            for old in _folders(spark, table, kind):
                if old <= last:
                    _delete(spark, f"{table}/{kind}={old}")

    return (
        entries.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_memory(
    spark: SparkSession,
    table: str,
    schema: StructType,
    key: str = "repo_id",
    order: str = "ord",
    keep: int = fixed.MEMORY_ENTRIES,
) -> DataFrame:
    """Current history: the last base and the batches after it."""
    parts = _live(spark, table)
    if not parts:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*parts), key, order, keep).drop("rank")
