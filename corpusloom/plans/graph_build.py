"""From files to a symbol graph, an index and search contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators import context as ctx
from corpusloom.operators import graph, index, search, typos
from corpusloom.operators.extract import exploded, file_symbols, route_files
from corpusloom.operators.ranking import top_n
from corpusloom.session import stored


def semantic_fix(files: DataFrame, context: DataFrame | None = None, mode: str = "contains") -> tuple[DataFrame, DataFrame]:
    """Files with renamed exports, and the rename table they came from."""
    found = stored(typos.typo_dedup(typos.typo_candidates(files, context, mode, importers=2)), "typos")
    return typos.apply_typo_fixes(files, found), found


def build_symbol_graph(files: DataFrame, context: DataFrame | None = None, mode: str = "contains") -> dict[str, DataFrame]:
    """Naming repair, syntax repair, extraction, then the graph tables.

    ``symbols``, ``files``, ``edges``, ``fixes``, ``typos`` and ``metadata``.  The extracted symbols are written once,
    one row per file, because four of the tables start from them.
    """
    renamed, found = semantic_fix(files, context, mode)
    routed = route_files(renamed)
    rows = stored(graph.with_distinct(file_symbols(routed)), "file_symbols")
    raw = exploded(rows)
    fixes = routed.filter((F.size("fixes") > 0) | F.col("fixed")).select(
        "repo_id",
        "path",
        "original_content",
        F.coalesce("fixed_content", "content").alias("fixed_content"),
        "fixes",
        "semantic_fixes",
    )
    return {
        "symbols": graph.distinct_symbols(rows),
        "files": graph.metadata_of(rows),
        "edges": graph.build_edges(raw),
        "fixes": fixes,
        "typos": found,
        "metadata": graph.graph_metadata(files, raw),
    }


def pattern_query(
    spark: SparkSession, names: list[str], idx: DataFrame, meta: DataFrame, edges: DataFrame, files: DataFrame
) -> DataFrame:
    """Contexts for named patterns, or for raw texts where the name is unknown; one scan for all of them."""
    queries = search.text_queries(spark, {n: fixed.PATTERN_QUERIES.get(n, n) for n in names})
    hits = stored(search.vector_search(queries, idx, fixed.PATTERN_SYMBOLS), "hits")
    return ctx.retrieve_context(hits, meta, edges, files, fixed.PATTERN_FILES)


def review_context(
    spark: SparkSession, idx: DataFrame, meta: DataFrame, edges: DataFrame, files: DataFrame, max_tokens: int = 30000
) -> DataFrame:
    """The compact context of the review query for every repository."""
    queries = search.text_queries(spark, {"review": fixed.REVIEW_QUERY})
    hits = stored(search.vector_search(queries, idx, fixed.CONTEXT_SYMBOLS), "hits")
    return ctx.compact_context(ctx.retrieve_context(hits, meta, edges, files), max_tokens)


def find_all_usages(spark: SparkSession, name: str, symbols: DataFrame, edges: DataFrame, idx: DataFrame) -> DataFrame:
    """Definitions, similar entries and references of a name, tagged by ``kind``."""
    names = spark.createDataFrame([(name, name)], "query_id string, name string")
    row = lambda df, kind, id_, other: df.select(
        "repo_id", F.lit(kind).alias("kind"), F.col(id_).alias("id"), other.cast("string").alias("detail")
    )
    definitions = row(graph.find_symbols_by_name(symbols, name), "definition", "symbol_id", F.col("type"))
    similar = row(search.similar_symbols(names, idx, fixed.TOP_K), "similar", "id", F.col("rank"))
    references = row(graph.find_references(edges, name), "reference", "src", F.col("dst"))
    return definitions.unionByName(similar).unionByName(references)


def usage_totals(usages: DataFrame) -> DataFrame:
    """Definitions plus references per repository; similar entries do not count."""
    return usages.groupBy("repo_id").agg(
        F.count_if(F.col("kind") == "definition").alias("definitions"),
        F.count_if(F.col("kind") == "similar").alias("similar"),
        F.count_if(F.col("kind") == "reference").alias("references"),
        F.count_if(F.col("kind") != "similar").alias("total_usages"),
    )


def related_to_targets(targets: DataFrame, idx: DataFrame) -> DataFrame:
    """Entries of other files of the repository close to the first five entries of each target ``(repo_id, file)``.

    Every target's names are queries that only meet their own repository, so all files may be targets at once.
    """
    entries = idx.drop("embedding").join(targets.select("repo_id", "file").distinct(), ["repo_id", "file"])
    first = top_n(entries, ["repo_id", "file"], [F.col("entry_kind"), F.col("ord")], fixed.SNIPPET_HITS, "entry_rank")
    names = stored(
        first.select(
            F.concat_ws("|", "repo_id", "file", "entry_rank").alias("query_id"),
            F.col("file").alias("target"),
            "entry_rank",
            F.col("symbol_name").alias("name"),
            F.col("repo_id").alias("scope"),
        ),
        "related",
    )
    hits = search.similar_symbols(names, idx, fixed.SIMILAR_K, carry=("target", "entry_rank"))
    return ctx.related_symbols(hits)


def focused_context(
    targets: DataFrame, idx: DataFrame, meta: DataFrame, edges: DataFrame, files: DataFrame
) -> DataFrame:
    """One row for each target ``(repo_id, file)``: its own entries with snippets, its imports, and related entries of other
    files in the order of the entries that they resemble.

    A target that the index does not know keeps its row, with an empty file context.
    """
    targets = targets.select("repo_id", "file").distinct()
    # Neither vectors nor texts of entries take part.
    entries = idx.drop("embedding", "text").join(targets, ["repo_id", "file"])
    own = index.symbols_in_file(entries).withColumn("query_id", F.col("file")).withColumn(
        "similarity", F.lit(None).cast("double")
    )
    found = ctx.retrieve_context(stored(own.select(*ctx.HIT), "hits"), meta, edges, files)
    row = F.struct("entry_rank", "rank", "id", "file", F.col("symbol_name").alias("name"), "similarity")
    related = (
        related_to_targets(targets, idx.select(*index.SEARCHED))
        .groupBy("repo_id", F.col("target").alias("query_id"))
        .agg(F.array_sort(F.collect_list(row)).alias("related"))
    )
    empty = F.struct(
        F.lit(1).alias("file_rank"), F.col("query_id").alias("path"), F.lit("unknown").alias("language"), F.array().alias("symbols"),
        F.array().alias("imports"), F.array().alias("exports"), F.lit(None).alias("snippets"), F.lit(None).alias("full_content"),
    )
    none = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    return (
        targets.withColumnRenamed("file", "query_id")
        .join(found.select("query_id", "repo_id", "files", "dependencies"), ["query_id", "repo_id"], "left")
        .join(related, ["query_id", "repo_id"], "left")
        .withColumn("known", F.col("files").isNotNull())
        .withColumn("files", F.coalesce("files", F.array(empty).cast(found.schema["files"].dataType)))
        .withColumn("dependencies", none("dependencies", found))
        .withColumn("related", none("related", related))
    )


def sources(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Index, file metadata, edges and symbols of a corpus, without the naming repair.

    One row per file with its symbols is written once; all four are folds of such rows or explode them.
    """
    rows = stored(graph.with_distinct(file_symbols(files)), "file_symbols")
    return index.build_index_of(rows), graph.metadata_of(rows), graph.build_edges(exploded(rows)), graph.distinct_symbols(rows)
