"""The embedding index: texts of symbols and files, their vectors, and look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom import fixed
from corpusloom.functions import text as tx
from corpusloom.functions.vectors import embed_text
from corpusloom.operators import graph
from corpusloom.operators.ranking import top_n
from corpusloom.session import stored
from corpusloom.sources import tables

INDEX_SCHEMA = (
    "entry_kind int, file string, ord bigint, id string, symbol_name string, symbol_type string, line int, "
    "text string, documentation string, signature string, language string, symbol_count int, "
    "embedding array<float>, repo_id string"
)
ENTRY_ORDER = ["entry_kind", "file", "ord"]
#: What a search for names needs of an entry: its vector, its order and how it is called.
SEARCHED = ["repo_id", *ENTRY_ORDER, "id", "symbol_name", "embedding"]


def symbol_text() -> Column:
    """Type, name, signature, parameters, documentation, place and owning class of a symbol as one text."""
    filled = lambda c: F.when(F.length(c) > 0, F.col(c))
    return F.concat_ws(
        " ",
        F.concat_ws(" ", "type", "name"),
        filled("signature"),
        F.when(F.size("params") > 0, F.concat(F.lit("parameters: "), F.array_join("params", ", "))),
        filled("documentation"),
        F.concat(F.lit("in "), tx.parent_name(F.col("file")), F.lit("/"), tx.base_name(F.col("file"))),
        F.when(F.length("class_name") > 0, F.concat(F.lit("method of class "), F.col("class_name"))),
    )


def first_n_names(symbols: DataFrame, n: int = fixed.NAMES_PER_FILE) -> DataFrame:
    """First ``n`` symbol names per file, in order; one file holds at most its own declarations."""
    listed = F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, n)
    return symbols.groupBy("repo_id", F.col("file").alias("path")).agg(
        F.transform(listed, lambda x: x["name"]).alias("contains")
    )


def names_of(rows: DataFrame, n: int = fixed.NAMES_PER_FILE) -> DataFrame:
    """The rows of :func:`first_n_names`, from ``graph.with_distinct``; nothing is shuffled."""
    named = rows.filter(F.size("distinct") > 0)
    return named.select("repo_id", "path", F.transform(F.slice("distinct", 1, n), lambda s: s["name"]).alias("contains"))


def _with_text(described: DataFrame) -> DataFrame:
    """Path, language and the first names of imports, exports and contained symbols; adds ``text``."""
    first = lambda c: F.transform(F.slice(c, 1, fixed.NAMES_PER_FILE), lambda x: x["name"])
    part = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(names, ", ")))
    text = F.concat_ws(
        " ",
        "path",
        F.concat("language", F.lit(" file")),
        part("imports", first("imports")),
        part("exports", first("exports")),
        part("contains", F.col("contains")),
    )
    return described.withColumn("text", text)


def file_text(meta: DataFrame, symbols: DataFrame) -> DataFrame:
    """File texts from file metadata and deduplicated symbols."""
    return _with_text(meta.join(first_n_names(symbols), ["repo_id", "path"], "left"))


def text_of(rows: DataFrame) -> DataFrame:
    """File texts from ``graph.with_distinct``."""
    contains = F.transform(F.slice("distinct", 1, fixed.NAMES_PER_FILE), lambda s: s["name"])
    return _with_text(graph.metadata_of(rows, contains=contains))


def symbol_entries(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "repo_id",
        F.lit(0).alias("entry_kind"),
        "file",
        "ord",
        F.col("symbol_id").alias("id"),
        F.col("name").alias("symbol_name"),
        F.col("type").alias("symbol_type"),
        "line",
        symbol_text().alias("text"),
        F.nullif("documentation", F.lit("")).alias("documentation"),
        "signature",
    )


def _file_entries(described: DataFrame) -> DataFrame:
    return described.select(
        "repo_id",
        F.lit(1).alias("entry_kind"),
        F.col("path").alias("file"),
        F.lit(0).cast("bigint").alias("ord"),
        tx.symbol_id(F.lit("file"), F.col("path")).alias("id"),
        tx.base_name(F.col("path")).alias("symbol_name"),
        F.lit("file").alias("symbol_type"),
        F.lit(0).alias("line"),
        "text",
        "language",
        "symbol_count",
    )


def index_entries(symbols: DataFrame, meta: DataFrame) -> DataFrame:
    """Symbol entries and file entries, still without vectors; ``symbols`` without duplicates."""
    return symbol_entries(symbols).unionByName(_file_entries(file_text(meta, symbols)), allowMissingColumns=True)


def entries_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`index_entries`, from ``graph.with_distinct``; nothing is shuffled."""
    symbols = symbol_entries(graph.distinct_symbols(rows))
    return symbols.unionByName(_file_entries(text_of(rows)), allowMissingColumns=True)


def with_embedding(entries: DataFrame, embed: Callable[[Column], Column] = embed_text) -> DataFrame:
    return entries.withColumn("embedding", embed(F.col("text")))


def build_index_of(rows: DataFrame, embed: Callable[[Column], Column] = embed_text) -> DataFrame:
    """The rows of :func:`build_embedding_index`, from ``graph.with_distinct``."""
    return with_embedding(entries_of(rows), embed)


def build_embedding_index(
    symbols: DataFrame, meta: DataFrame, embed: Callable[[Column], Column] = embed_text
) -> DataFrame:
    """Entries with unit vectors; ``embed`` may be another text-to-vector column function."""
    return with_embedding(index_entries(symbols, meta), embed)


def save_entries(entries: DataFrame, root: str, schema: StructType, embed: Callable[[Column], Column] = embed_text) -> None:
    """Save entries without vectors; each gets its vector where it is written, so no vector is shuffled or sorted."""
    columns = [c for c in schema.names if c != "embedding"]
    tables.save_index(entries.select(*columns), root, schema, lambda rows: with_embedding(rows, embed))


def index_build_missing(
    spark: SparkSession, root: str, files: DataFrame, build: Callable[[DataFrame], DataFrame], schema: StructType
) -> DataFrame:
    """Reuse what the stored index holds, build and store only the repositories of ``files`` that it lacks, and read it back.

    ``build`` turns the files of the missing repositories into entries, with vectors or without; it doesn't see the others.
    """
    held = stored(tables.load_index(spark, root, schema).select("repo_id").distinct(), "held")
    built = build(files.join(held, "repo_id", "left_anti"))
    if set(schema.names) <= set(built.columns):
        tables.save_index(built.select(*schema.names), root)
    else:
        save_entries(built, root, schema)
    return tables.load_index(spark, root, schema, files.select("repo_id"))


def index_stats(index: DataFrame) -> DataFrame:
    """Entry counts per repository: in all, per symbol type and per language, from one aggregation."""
    return (
        index.groupingSets(
            [["repo_id"], ["repo_id", "symbol_type"], ["repo_id", "language"]], "repo_id", "symbol_type", "language"
        )
        .agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
        .withColumn(
            "statistic", F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "symbol_type").otherwise("language")
        )
        .withColumn("value", F.coalesce("symbol_type", "language"))
        .filter((F.col("statistic") == "total") | F.col("value").isNotNull())
        .select("repo_id", "statistic", "value", "n")
    )


def symbols_by_type(index: DataFrame, symbol_type: str, limit: int = fixed.LISTING_LIMIT) -> DataFrame:
    """First entries of a type per repository, in index order."""
    chosen = index.filter(F.col("symbol_type") == symbol_type)
    return top_n(chosen, ["repo_id"], [F.col(c) for c in ENTRY_ORDER], limit)


def symbols_in_file(index: DataFrame, limit: int = fixed.LISTING_LIMIT) -> DataFrame:
    """First entries of every file, in index order; the file's own entry comes last."""
    return top_n(index, ["repo_id", "file"], [F.col("entry_kind"), F.col("ord")], limit)
