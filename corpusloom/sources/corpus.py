"""Code files: from folder trees or from tables, with the selection rules of the analysed and the context set."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as tx
from corpusloom.session import stored


def _skipped(path: Column, names: list[str], dot_dirs: bool) -> Column:
    alternatives = [re.escape(n) for n in names] + ([r"\.[^/]*"] if dot_dirs else [])
    return path.rlike(r"(^|/)(" + "|".join(alternatives) + r")/")


def is_code_file(path: Column, size: Column, max_size: int = fixed.MAX_FILE_BYTES) -> Column:
    """The analysed set: 13 case-sensitive extensions, no skipped or hidden folder, at most 100,000 bytes."""
    return (
        tx.extension(path).isin(fixed.CODE_EXTENSIONS)
        & ~_skipped(path, fixed.CODE_SKIP_DIRS, dot_dirs=True)
        & (size <= max_size)
    )


def is_context_file(path: Column) -> Column:
    """The wider set for import context: other extensions, hidden folders kept, no size cap."""
    return tx.extension(path).isin(fixed.CONTEXT_EXTENSIONS) & ~_skipped(
        path, fixed.CONTEXT_SKIP_DIRS, dot_dirs=False
    )


def scan_code_files(files: DataFrame, max_size: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    return files.filter(is_code_file(F.col("path"), F.col("size"), max_size))


def rejected_files(files: DataFrame, max_size: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Code files that the scan leaves out because of their size: ``(repo_id, path, size, problem)``."""
    right = is_code_file(F.col("path"), F.lit(0).cast("long"))
    return files.filter(right & (F.col("size") > max_size)).select("repo_id", "path", "size", F.lit("too_large").alias("problem"))


def scan_context_files(files: DataFrame) -> DataFrame:
    """Per repository the context set where it has more files than the analysed set, else the analysed set."""
    flagged = files.withColumn("_code", is_code_file(F.col("path"), F.col("size"))).withColumn(
        "_context", is_context_file(F.col("path"))
    )
    wider = (
        flagged.groupBy("repo_id")
        .agg(F.count_if("_code").alias("_n_code"), F.count_if("_context").alias("_n_context"))
        .filter(F.col("_n_context") > F.col("_n_code"))
        .select("repo_id", F.lit(True).alias("_wider"))
    )
    return (
        flagged.filter("_code or _context")
        .join(wider, "repo_id", "left")
        .filter(F.when(F.col("_wider"), F.col("_context")).otherwise(F.col("_code")))
        .drop("_code", "_context", "_wider")
    )


def scan_subpath(files: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Files below a folder with paths relative to it, and one status row per repository.

    The status is ``path_not_found`` where no file lies below the folder, ``no_files_found`` where none of those
    is a code file, else ``ok``.
    """
    folder = prefix.strip("/") + "/"
    below = F.col("path").startswith(folder)
    relative = F.substring(F.col("path"), len(folder) + 1, 1 << 30)
    inside = scan_code_files(files.filter(below).withColumn("path", relative))
    status = (
        files.select("repo_id", below.alias("b"), (below & is_code_file(relative, F.col("size"))).alias("c"))
        .groupBy("repo_id")
        .agg(F.count_if("b").alias("n_below"), F.count_if("c").alias("n_code"))
        .select(
            "repo_id",
            F.when(F.col("n_below") == 0, "path_not_found")
            .when(F.col("n_code") == 0, "no_files_found")
            .otherwise("ok")
            .alias("status"),
        )
    )
    return inside, status


def read_bodies(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Attach file bodies to ``(repo_id, path)`` rows; a missing file leaves NULL and keeps the row."""
    return requests.join(files.select("repo_id", "path", "content"), ["repo_id", "path"], "left")


# -- folder trees ------------------------------------------------------------------
# Spark's own file listing leaves out names that start with "_" or "." (``__init__.py``, ``.eslintrc.js``), so trees
# are listed and read in tasks through pyarrow file systems, which cover local paths, HDFS and object stores.

_LISTED = "repo_id string, root string, path string, size long, folder boolean, problem string"


def _list_folders(skip: set[str], dot_dirs: bool):
    """Rows of the entries of each folder; a folder that can't be listed is one row with its problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("repo_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_()), ("problem", pa.string())]
        )
        for batch in batches:
            for repo_id, root, folder in zip(*(batch[c].to_pylist() for c in ("repo_id", "root", "path"))):
                row = {"repo_id": repo_id, "root": root, "size": None, "folder": False, "problem": None}
                rows = []
                try:
                    filesystem, top = pafs.FileSystem.from_uri(root)
                    top = top.rstrip("/")
                    for entry in filesystem.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top)):
                        path = entry.path[len(top) + 1 :]
                        if entry.type == pafs.FileType.Directory:
                            if entry.base_name not in skip and not (dot_dirs and entry.base_name.startswith(".")):
                                rows.append({**row, "path": path, "folder": True})
                        elif entry.type == pafs.FileType.File:
                            rows.append({**row, "path": path, "size": entry.size})
                except (OSError, pa.ArrowInvalid) as error:
                    rows = [{**row, "path": folder, "problem": f"folder: {error}"}]
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 5000], schema=schema)

    return run


def list_tree(roots: DataFrame, context: bool = False, partitions: int | None = None) -> DataFrame:
    """(repo_id, root, path, size, problem): the files below ``roots(repo_id, root)``, and the folders that can't be listed.

    Folders are expanded level by level.  Each level is dealt by folder, so one large tree is listed by many tasks, and written
    before the next begins.
    """
    skip = fixed.CONTEXT_SKIP_DIRS if context else fixed.CODE_SKIP_DIRS
    n = partitions or int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = roots.select("repo_id", "root", F.lit("").alias("path"))
    found = None
    while True:
        dealt = level.repartition(n, "root", "path")
        listed = stored(dealt.mapInArrow(_list_folders(set(skip), dot_dirs=not context), _LISTED), "tree_level")
        files = listed.filter(~F.col("folder")).drop("folder")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("folder").select("repo_id", "root", "path")
        if level.isEmpty():
            return found


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    systems: dict[str, tuple[pafs.FileSystem, str]] = {}
    schema = pa.schema(
        [("repo_id", pa.string()), ("path", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("problem", pa.string())]
    )
    for batch in batches:
        rows: list[dict] = []
        held = 0
        for row in batch.to_pylist():
            root = row.pop("root")
            if root not in systems:
                systems[root] = pafs.FileSystem.from_uri(root)
            filesystem, folder = systems[root]
            try:
                with filesystem.open_input_stream(f"{folder.rstrip('/')}/{row['path']}") as stream:
                    body = stream.read()
                rows.append({**row, "content": body.decode("utf-8", "replace"), "problem": None})
                held += len(body)
            except OSError as error:
                rows.append({**row, "content": None, "problem": f"file: {error}"})
            if held > 32_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def scan_tree(roots: DataFrame, context: bool = False, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The code files below ``roots(repo_id, root)`` and what was left out for a reason other than its name.

    ``root`` is a URI or an absolute path.  Size and name rules apply to the listing, before any body is opened.  The listing is
    then spread by path, so the bodies of one large repository are read by many tasks.  The second table has a row for each
    folder that could not be listed, file over the size limit, and file that could not be read: ``(repo_id, path, size,
    problem)``; asking for it reads the bodies.
    """
    listed = list_tree(roots, context, partitions)
    n = partitions or int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = F.col("problem").isNull()
    wanted = is_context_file(F.col("path")) if context else is_code_file(F.col("path"), F.col("size"))
    spread = listed.filter(good & wanted).drop("problem").repartition(n, "repo_id", "path")
    read = spread.mapInArrow(_reading, "repo_id string, path string, content string, size long, problem string")
    problems = listed.filter(~good).select("repo_id", "path", "size", "problem").unionByName(
        read.filter(~good).select("repo_id", "path", "size", "problem")
    )
    if not context:
        problems = problems.unionByName(rejected_files(listed.filter(good)))
    return read.filter(good).drop("problem"), problems


def read_tree(roots: DataFrame, context: bool = False, partitions: int | None = None) -> DataFrame:
    """The files of :func:`scan_tree`."""
    return scan_tree(roots, context, partitions)[0]
