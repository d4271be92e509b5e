"""Parquet tables in hash buckets of repositories: graph output and the embedding index with its life cycle.

A repository belongs to one of ``BUCKETS`` buckets, however many repositories there are, and a bucket's files are sorted by
repository, so that a look-up skips row groups. A change rewrites the buckets it touches into a new version folder and then
creates a manifest that names the version of each bucket; until that one file exists, readers see the state before. Creating a
manifest that exists fails, so of two writers that start from one version only one gets through. Old versions stay readable
until :func:`vacuum_index`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.session import stored

BUCKETS = 64


def bucket_of(repo_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repo_id), F.lit(buckets)).cast("int")


def _write_buckets(
    df: DataFrame, path: str, buckets: int, finish: Callable[[DataFrame], DataFrame] | None = None, mode: str = "overwrite"
) -> None:
    """Cluster rows by bucket; adaptive execution splits a bucket with a large repository over several tasks.

    ``finish`` adds columns to rows that are dealt and sorted, so that wide ones are neither shuffled nor sorted.
    """
    dealt = df.withColumn("bucket", bucket_of(F.col("repo_id"), buckets)).hint("rebalance", "bucket")
    rows = dealt.sortWithinPartitions("bucket", "repo_id")
    (finish(rows) if finish else rows).write.partitionBy("bucket").mode(mode).parquet(path)


def write_graph(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    for name, table in tables.items():
        _write_buckets(table, f"{root}/{name}", buckets)


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, path: str) -> list[str]:
    files, jpath = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(jpath)] if files.exists(jpath) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[1:-5]) for n in _names(spark, f"{root}/manifests") if n.startswith("v") and n.endswith(".json"))


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Version, number of buckets, and the version that each filled bucket was last written in."""
    versions = _versions(spark, root)
    if not versions:
        return {"version": 0, "buckets": BUCKETS, "held": {}}
    text = spark.read.text(f"{root}/manifests/v{versions[-1] if version is None else version}.json", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    files, jpath = _files(spark, f"{root}/manifests/v{manifest['version']}.json")
    out = files.create(jpath, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()


def _read(spark: SparkSession, root: str, manifest: dict, schema: StructType, only: set[int] | None = None) -> DataFrame:
    held = {int(b): v for b, v in manifest["held"].items()}
    paths = [f"{root}/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _touched(repos: DataFrame, buckets: int) -> set[int]:
    """The buckets of some repositories; never more than there are buckets."""
    return {r[0] for r in repos.select(bucket_of(F.col("repo_id"), buckets)).distinct().collect()}


def load_index(spark: SparkSession, root: str, schema: StructType, repos: DataFrame | None = None) -> DataFrame:
    """Read the index, optionally only the repositories listed in ``repos``, from their buckets; nothing saved gives no rows."""
    manifest = _manifest(spark, root)
    if repos is None:
        return _read(spark, root, manifest, schema)
    wanted = stored(repos.select("repo_id").distinct(), "repos")  # its real size is known, so that a few don't move the index
    return _read(spark, root, manifest, schema, _touched(wanted, manifest["buckets"])).join(wanted, "repo_id", "left_semi")


def replace_repos(
    spark: SparkSession, root: str, gone: DataFrame, index: DataFrame | None, schema: StructType, finish: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Drop the repositories in ``gone`` and in ``index``, add the rows of ``index``: one new version of the touched buckets.

    With ``finish``, ``index`` lacks the columns that it adds, see :func:`_write_buckets`; the rows that stay have them.
    """
    manifest = _manifest(spark, root)
    buckets = manifest["buckets"]
    gone = gone.select("repo_id") if index is None else gone.select("repo_id").unionByName(index.select("repo_id"))
    gone = stored(gone.distinct(), "repos")
    touched = _touched(gone, buckets)
    if not touched:
        return
    rest = _read(spark, root, manifest, schema, touched).join(gone, "repo_id", "left_anti")
    columns = schema.names
    version = manifest["version"] + 1
    path = f"{root}/version={version}"
    if finish:
        if again := any(int(b) in touched for b in manifest["held"]):
            _write_buckets(rest.select(*columns), path, buckets)
        _write_buckets(index, path, buckets, finish, "append" if again else "overwrite")
    else:
        _write_buckets(rest.select(*columns) if index is None else rest.select(*columns).unionByName(index.select(*columns)), path, buckets)
    written = {int(n[7:]) for n in _names(spark, f"{root}/version={version}") if n.startswith("bucket=")}
    held = {b: v for b, v in manifest["held"].items() if int(b) not in touched} | {str(b): version for b in written}
    _commit(spark, root, {"version": version, "buckets": buckets, "held": held})


def save_index(
    index: DataFrame, root: str, schema: StructType | None = None, finish: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Write or replace the repositories that occur in ``index``; all others stay as they are.

    ``finish`` adds what ``schema`` has and ``index`` lacks to the dealt rows, such as vectors.
    """
    replace_repos(index.sparkSession, root, index.select("repo_id").limit(0), index, schema or index.schema, finish)


def delete_index(spark: SparkSession, root: str, repos: DataFrame, schema: StructType) -> None:
    """Remove repositories in bulk; missing ones are fine."""
    replace_repos(spark, root, repos, None, schema)


def rebuild_index(index: DataFrame, root: str, repos: DataFrame | None = None) -> None:
    """Delete and build in one step. ``repos`` are the rebuilt repositories; one without entries any more disappears."""
    replace_repos(index.sparkSession, root, index.select("repo_id").limit(0) if repos is None else repos, index, index.schema)


def vacuum_index(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete the manifests but for the last ``keep``, and the bucket folders that none of these names."""
    versions = _versions(spark, root)
    kept = [_manifest(spark, root, v) for v in versions[-keep:]]
    named = {f"version={v}/bucket={b}" for m in kept for b, v in m["held"].items()}
    for version in versions:
        for name in _names(spark, f"{root}/version={version}"):
            if name.startswith("bucket=") and f"version={version}/{name}" not in named:
                files, jpath = _files(spark, f"{root}/version={version}/{name}")
                files.delete(jpath, True)
    for version in versions[:-keep]:
        files, jpath = _files(spark, f"{root}/manifests/v{version}.json")
        files.delete(jpath, False)


def index_exists(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Flag each requested repository by whether the index holds it."""
    held = index.select("repo_id").distinct().withColumn("exists", F.lit(True))
    return requests.join(held, "repo_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def without_repos(index: DataFrame, repos: DataFrame) -> DataFrame:
    """The index without some repositories."""
    return index.join(repos.select("repo_id").distinct(), "repo_id", "left_anti")
