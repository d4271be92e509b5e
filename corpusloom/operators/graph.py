"""The symbol graph as tables: symbols, files and edges, and look-ups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.once import evaluated_once
from corpusloom.operators.extract import SYMBOL_FIELDS


def symbol_dedup(symbols: DataFrame) -> DataFrame:
    """One row per ``file::name``: the values of the last declaration at the position of the first.

    ``ord`` is the place of the first declaration.  Rows are spread by file, a bounded unit, and later groupings by file
    find them in place.
    """
    fields = ["language", *[k for k in SYMBOL_FIELDS if k not in ("name", "ord")]]
    return (
        symbols.repartition("repo_id", "file")
        .groupBy("repo_id", "file", "name")
        .agg(F.max_by(F.struct(*fields), "ord").alias("_last"), F.min("ord").alias("ord"))
        .select(
            "repo_id", tx.symbol_id(F.col("file"), F.col("name")).alias("symbol_id"), "file", "name", "_last.*", "ord"
        )
    )


def with_distinct(rows: DataFrame) -> DataFrame:
    """``extract.file_symbols`` with ``distinct``: per name the values of the last declaration at the position of the first, in
    order.  A fold over the sorted symbols of a file in its own row; nothing is shuffled."""
    keep = rows.columns
    by_name = F.array_sort(F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["ord"].alias("ord"), s.alias("s"))))
    rows = evaluated_once(rows, {"_sorted": by_name}, keep)
    at = F.col("_sorted")
    starts = F.transform(at, lambda x, i: F.when((i == 0) | (x["name"] != F.get(at, i - 1)["name"]), i))
    rows = evaluated_once(rows, {"_starts": F.filter(starts, lambda i: i.isNotNull())}, [*keep, "_sorted"])

    def row(start: Column, j: Column) -> Column:
        last = F.get(at, F.coalesce(F.get("_starts", j + 1), F.size(at)) - 1)["s"]
        return F.struct(F.get(at, start)["ord"].alias("ord"), *(last[k].alias(k) for k in SYMBOL_FIELDS if k != "ord"))

    return evaluated_once(rows, {"distinct": F.array_sort(F.transform("_starts", row))}, keep)


def distinct_symbols(rows: DataFrame) -> DataFrame:
    """The rows of :func:`symbol_dedup`, from :func:`with_distinct`."""
    fields = [k for k in SYMBOL_FIELDS if k not in ("name", "ord")]
    given = rows.select("repo_id", F.col("path").alias("file"), "language", F.inline("distinct"))
    return given.select("repo_id", tx.symbol_id(F.col("file"), F.col("name")).alias("symbol_id"), "file", "name", "language", *fields, "ord")


def _named(symbols: Column, type_: str) -> Column:
    return F.filter(symbols, lambda s: s["type"] == type_)


def metadata_of(rows: DataFrame, **more: Column) -> DataFrame:
    """The rows of :func:`file_metadata`, from ``extract.file_symbols``, with more columns on demand."""
    pair = lambda s: F.struct(s["name"].alias("name"), s["from_module"].alias("from_module"))
    return rows.select(
        "repo_id",
        "path",
        "language",
        F.size("symbols").alias("symbol_count"),
        "size",
        F.transform(_named(F.col("symbols"), "import"), pair).alias("imports"),
        F.transform(_named(F.col("symbols"), "export"), lambda s: F.struct(s["name"].alias("name"))).alias("exports"),
        *(column.alias(name) for name, column in more.items()),
    )


def hierarchy_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`symbol_hierarchy`, from :func:`with_distinct`."""
    names = lambda t: F.transform(_named(F.col("distinct"), t), lambda s: s["name"])
    return rows.filter(F.size("distinct") > 0).select(
        "repo_id", F.col("path").alias("file"), *(names(t).alias(c) for t, c in (("class", "classes"), ("function", "functions"), ("import", "imports"), ("export", "exports")))
    )


def import_edges(symbols: DataFrame) -> DataFrame:
    """``file::name`` to ``module::name``; a bare import points into ``null``."""
    module = F.coalesce("from_module", F.lit("null"))
    return symbols.filter(F.col("type") == "import").select(
        "repo_id",
        tx.symbol_id(F.col("file"), F.col("name")).alias("src"),
        tx.symbol_id(module, F.col("name")).alias("dst"),
        F.lit("imports").alias("type"),
        F.col("file").alias("src_file"),
        "name",
        F.col("from_module").alias("module"),
        "ord",
    )


def extends_edges(symbols: DataFrame) -> DataFrame:
    """Class to superclass within the same file."""
    return symbols.filter((F.col("type") == "class") & F.col("extends").isNotNull()).select(
        "repo_id",
        tx.symbol_id(F.col("file"), F.col("name")).alias("src"),
        tx.symbol_id(F.col("file"), F.col("extends")).alias("dst"),
        F.lit("extends").alias("type"),
        F.col("file").alias("src_file"),
        "name",
        F.lit(None).cast("string").alias("module"),
        "ord",
    )


def build_edges(symbols: DataFrame) -> DataFrame:
    """All edges in one pass over the symbols."""
    is_import = F.col("type") == "import"
    target = F.when(is_import, F.coalesce("from_module", F.lit("null"))).otherwise(F.col("file"))
    name = F.when(is_import, F.col("name")).otherwise(F.col("extends"))
    return symbols.filter(is_import | ((F.col("type") == "class") & F.col("extends").isNotNull())).select(
        "repo_id",
        tx.symbol_id(F.col("file"), F.col("name")).alias("src"),
        tx.symbol_id(target, name).alias("dst"),
        F.when(is_import, "imports").otherwise("extends").alias("type"),
        F.col("file").alias("src_file"),
        "name",
        F.when(is_import, F.col("from_module")).alias("module"),
        "ord",
    )


def file_metadata(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Language, size in characters, symbol count before duplicates are removed, import and export names.

    Only ``(path, size)`` of the files takes part in the join, never the body.
    """
    entry = F.struct("ord", "name", "from_module")
    per_file = symbols.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.count("*").alias("n"),
        F.collect_list(F.when(F.col("type") == "import", entry)).alias("i"),
        F.collect_list(F.when(F.col("type") == "export", entry)).alias("e"),
    )
    pairs = lambda c: F.transform(
        F.array_sort(c), lambda x: F.struct(x["name"].alias("name"), x["from_module"].alias("from_module"))
    )
    names = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["name"].alias("name")))
    heads = files.select(
        "repo_id",
        "path",
        tx.language(tx.extension(F.col("path"))).alias("language"),
        tx.utf16_length(F.col("content")).alias("size"),
    )
    empty_i = F.expr("cast(array() as array<struct<name:string,from_module:string>>)")
    empty_e = F.expr("cast(array() as array<struct<name:string>>)")
    return heads.join(per_file, ["repo_id", "path"], "left").select(
        "repo_id",
        "path",
        "language",
        F.coalesce("n", F.lit(0)).cast("int").alias("symbol_count"),
        "size",
        F.coalesce(pairs(F.col("i")), empty_i).alias("imports"),
        F.coalesce(names(F.col("e")), empty_e).alias("exports"),
    )


def graph_metadata(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct symbols and files per repository, from raw or deduplicated symbols."""
    ids = symbols.select("repo_id", "file", "name").distinct()
    n_symbols = ids.groupBy("repo_id").agg(F.count("*").alias("total_symbols"))
    n_files = files.groupBy("repo_id").agg(F.count("*").alias("total_files"))
    return n_files.join(n_symbols, "repo_id", "left").select(
        "repo_id", F.coalesce("total_symbols", F.lit(0)).alias("total_symbols"), "total_files"
    )


def find_symbols_by_name(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.filter(F.lower("name").contains(query.lower()))


def find_references(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("dst").contains(name) | F.col("src").contains(name))


def symbol_hierarchy(symbols: DataFrame) -> DataFrame:
    """Classes, functions, imports and exports per file, each in order; other types are left out."""
    listed = lambda t: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("ord", "name")))), lambda x: x["name"]
    )
    return symbols.groupBy("repo_id", "file").agg(
        listed("class").alias("classes"),
        listed("function").alias("functions"),
        listed("import").alias("imports"),
        listed("export").alias("exports"),
    )


def attach_fixes(files: DataFrame, semantic: DataFrame, syntax: DataFrame) -> DataFrame:
    """Both fix lists of each file; a file without fixes keeps NULL."""
    return files.join(
        semantic.select("repo_id", "path", "semantic_fixes"), ["repo_id", "path"], "left"
    ).join(syntax.select("repo_id", "path", "fixes"), ["repo_id", "path"], "left")
