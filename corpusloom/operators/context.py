"""Review contexts: hits gathered per file with snippets, dependencies and references, as one nested row per query and
repository.

Every list in such a row is bounded by the search depth, the file limit or the size cap of a single file, so the nested
form stays small; everything that grows with the corpus is reached by equality joins on ``(repo_id, path)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as tx
from corpusloom.operators.containing import containing
from corpusloom.operators.ranking import top_n
from corpusloom.operators.search import hits_by_file, rank_files
from corpusloom.session import stored

KEYS = ["query_id", "repo_id"]
#: What a context needs of a hit.
HIT = [*KEYS, "file", "rank", "symbol_name", "symbol_type", "line", "similarity", "documentation", "signature"]
_HIT = "array<struct<rank:int,name:string,type:string,line:int,similarity:double,documentation:string,signature:string>>"


def file_hits(hits: DataFrame, max_files: int = fixed.CONTEXT_FILES) -> DataFrame:
    """Hits grouped per file, best files only: ``file_rank`` and the hits in rank order."""
    entry = F.struct(
        "rank",
        F.col("symbol_name").alias("name"),
        F.col("symbol_type").alias("type"),
        "line",
        "similarity",
        "documentation",
        "signature",
    )
    # Dealt by query and repository, so that the ranking finds the files of each in place.
    grouped = hits.repartition(*KEYS).groupBy(*KEYS, F.col("file").alias("path")).agg(
        F.count("*").alias("hits"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_list(entry)).alias("symbols")
    )
    return rank_files(grouped, max_files).drop("best_rank")


def snippets(text: Column, hits: Column) -> Column:
    """Numbered lines around the first five hits; a line belongs to the first hit that covers it.

    A hit without a line (a file entry) takes one of the five places and gives nothing.
    """
    reach = fixed.SNIPPET_LINES
    first = F.slice(hits, 1, fixed.SNIPPET_HITS)
    lines = tx.split_lines(text)

    def code(h: Column, i: Column) -> Column:
        start, end = F.greatest(h["line"] - reach, F.lit(1)), F.least(h["line"] + reach, F.size(lines))
        earlier = F.slice(first, F.lit(1), i)
        free = F.filter(
            F.sequence(start, F.greatest(start, end)),
            lambda n: (n <= end) & ~F.exists(earlier, lambda e: (e["line"] > 0) & (F.abs(n - e["line"]) <= reach)),
        )
        numbered = F.transform(free, lambda n: F.concat(n.cast("string"), F.lit(": "), F.get(lines, n - 1), F.lit("\n")))
        return F.when(h["line"] > 0, F.array_join(numbered, "")).otherwise(F.lit(""))

    rows = F.transform(
        first, lambda h, i: F.struct(h["name"].alias("name"), h["line"].alias("line"), code(h, i).alias("code"))
    )
    return F.filter(rows, lambda s: s["code"] != "")


def file_context(grouped: DataFrame, meta: DataFrame, files: DataFrame, full: bool = False) -> DataFrame:
    """Language, import and export names and snippets (or the whole text) for each grouped file.

    The grouped files are written once, so that Spark knows their size.  They go to the bodies, not the bodies to them: the
    snippets are cut where a body is read, and only these move on.  Where the list is too long to be sent to all tasks, the
    join shuffles and filters the bodies by the keys of the list first.
    """
    return _stored_file_context(stored(grouped, "grouped_files"), meta, files, full)


def _stored_file_context(grouped: DataFrame, meta: DataFrame, files: DataFrame, full: bool) -> DataFrame:
    names = lambda c: F.transform(F.col(c), lambda x: x["name"])
    known = meta.select("repo_id", "path", "language", names("imports").alias("imports"), names("exports").alias("exports"))
    wanted = grouped.select(*KEYS, "path", F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["line"].alias("line"))).alias("_at"))
    text = F.col("content")
    read = F.lit(None).cast("string") if not full else text
    cut = files.select("repo_id", "path", "content").join(wanted, ["repo_id", "path"]).select(
        *KEYS, "path", F.when(text.isNotNull() & F.lit(not full), snippets(text, F.col("_at"))).alias("snippets"), read.alias("full_content")
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        grouped.join(known, ["repo_id", "path"], "left")
        .join(cut, [*KEYS, "path"], "left")
        .withColumn("language", F.coalesce("language", F.lit("unknown")))
        .withColumn("imports", F.coalesce("imports", none))
        .withColumn("exports", F.coalesce("exports", none))
    )


def dependencies(ranked_files: DataFrame, edges: DataFrame, parity: bool = False) -> DataFrame:
    """Import edges of the kept files, one row per import; parity mode pairs every import with every edge of the file."""
    imports = edges.filter(F.col("type") == "imports").select(
        "repo_id", F.col("src_file").alias("path"), "dst", F.col("name").alias("symbol"), "ord"
    )
    if parity:
        per_file = imports.groupBy("repo_id", "path").agg(
            F.array_sort(F.collect_list(F.struct("ord", "symbol", "dst"))).alias("e")
        )
        pairs = F.flatten(
            F.transform(
                "e",
                lambda a, i: F.transform(
                    "e",
                    lambda b, j: F.struct(
                        b["dst"].alias("dst"), a["symbol"].alias("symbol"), (i * F.size("e") + j).cast("long").alias("ord")
                    ),
                ),
            )
        )
        imports = per_file.select("repo_id", "path", F.inline(pairs))
    return ranked_files.select(*KEYS, "path", "file_rank").join(imports, ["repo_id", "path"])


def call_graph(symbols: DataFrame, edges: DataFrame, n: int = fixed.REFERENCES_PER_SYMBOL) -> DataFrame:
    """First edges per function or method hit whose source or target contains its name.

    ``symbols(query_id, repo_id, symbol_ord, name, type)``.  Distinct names meet distinct edge ends through an index of short
    pieces; the edges of the matching ends follow by equality, and the first ones per hit are kept by a group limit that
    also runs before the shuffle.
    """
    wanted = symbols.filter(F.col("type").isin("function", "method")).select(*KEYS, "symbol_ord", "name")
    ends = F.explode(F.array_distinct(F.array("src", "dst"))).alias("text")
    by_end = edges.select("repo_id", "src", "dst", "src_file", "ord", ends)
    matches = stored(containing(wanted.select("repo_id", "name").distinct(), by_end.select("repo_id", "text").distinct(), few=True), "references")
    referring = by_end.join(matches, ["repo_id", "text"]).drop("text").distinct()
    found = referring.join(wanted, ["repo_id", "name"]).select("repo_id", "src", "dst", "src_file", "ord", "query_id", "symbol_ord", "name")
    return top_n(found, [*KEYS, "symbol_ord"], [F.col("src_file"), F.col("ord")], n, "ref_rank")


def retrieve_context(
    hits: DataFrame,
    meta: DataFrame,
    edges: DataFrame,
    files: DataFrame,
    max_files: int = fixed.CONTEXT_FILES,
    full: bool = False,
    parity: bool = False,
) -> DataFrame:
    """One nested row per query and repository.

    ``hits`` is read several times; hand in a stored table.  ``files``: path, language, symbols, imports, exports, snippets, full_content in rank order; ``symbols``: hits of the
    kept files; ``dependencies``, ``calls`` and ``summary``.
    """
    ranked = stored(file_hits(hits, max_files), "ranked")
    detailed = _stored_file_context(ranked, meta, files, full)
    block = F.struct(
        "file_rank", "path", "language", "symbols", "imports", "exports", "snippets", "full_content"
    )
    per_query = detailed.groupBy(*KEYS).agg(F.array_sort(F.collect_list(block)).alias("files"))
    flat_hits = F.flatten(
        F.transform("files", lambda f: F.transform(f["symbols"], lambda s: s.withField("path", f["path"])))
    )
    per_query = per_query.withColumn("symbols", flat_hits)
    # The same list from the ranked hits alone, so that the references do not repeat the joins above.
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_rank", "symbols"))), lambda f: f["symbols"]))
    listed = (
        ranked.groupBy(*KEYS)
        .agg(in_order.alias("_all"))
        .select(*KEYS, F.posexplode("_all").alias("symbol_ord", "_s"))
        .select(*KEYS, "symbol_ord", "_s.name", "_s.type")
    )
    deps = (
        dependencies(ranked, edges, parity)
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(F.struct("file_rank", "ord", "path", "dst", "symbol"))).alias("dependencies"))
    )
    calls = (
        call_graph(listed, edges)
        .groupBy(*KEYS)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("symbol_ord", "ref_rank", F.col("src").alias("caller"), F.col("dst").alias("callee"), "name"))
            ).alias("calls")
        )
    )
    none = lambda c, t: F.coalesce(F.col(c), F.expr(f"cast(array() as {t})"))
    return (
        per_query.join(deps, KEYS, "left")
        .join(calls, KEYS, "left")
        .withColumn(
            "dependencies",
            none("dependencies", "array<struct<file_rank:int,ord:bigint,path:string,dst:string,symbol:string>>"),
        )
        .withColumn(
            "calls", none("calls", "array<struct<symbol_ord:int,ref_rank:int,caller:string,callee:string,name:string>>")
        )
        .withColumn("summary", context_summary(F.col("files"), F.col("symbols")))
    )


def context_summary(files: Column, symbols: Column) -> Column:
    """Totals, languages and types in order of appearance, counts per type, the first five files."""
    types = F.transform(symbols, lambda s: s["type"])
    return F.struct(
        F.size(files).alias("total_files"),
        F.size(symbols).alias("total_symbols"),
        F.array_distinct(F.transform(files, lambda f: f["language"])).alias("languages"),
        F.transform(
            F.array_distinct(types),
            lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")),
        ).alias("symbol_types"),
        F.transform(
            F.slice(files, 1, 5),
            lambda f: F.struct(
                f["path"].alias("path"), F.size(f["symbols"]).alias("symbol_count"), f["language"].alias("language")
            ),
        ).alias("top_files"),
    )


def render_context(contexts: DataFrame, out: str = "text") -> DataFrame:
    """The text form of a context, sections in fixed order."""
    join = lambda parts, sep="\n": F.array_join(parts, sep)
    fmt = F.format_string
    summary = F.col("summary")

    # fixed values: section titles and line formats
    def symbol_line(s: Column) -> Column:
        return F.concat_ws(
            "\n",
            fmt("  - %s (%s) at line %d", s["name"], s["type"], s["line"]),
            F.when(s["documentation"] != "", F.concat(F.lit("    Doc: "), s["documentation"])),
            F.when(s["signature"] != "", F.concat(F.lit("    Signature: "), s["signature"])),
            F.when(s["similarity"].isNull(), F.lit("    Relevance: NaN%")).otherwise(
                fmt("    Relevance: %.1f%%", s["similarity"] * 100)
            ),
        )

    def snippet_lines(s: Column) -> Column:
        return F.concat_ws(
            "\n", fmt("\n  Symbol: %s (line %d)", s["name"], s["line"]), F.lit("  ```"), s["code"], F.lit("  ```")
        )

    def file_block(f: Column) -> Column:
        some = lambda items, part: F.when(F.size(items) > 0, part)
        return F.concat_ws(
            "\n",
            fmt("\n--- File: %s (%s) ---", f["path"], f["language"]),
            some(f["imports"], F.concat(F.lit("Imports: "), join(f["imports"], ", "))),
            some(f["exports"], F.concat(F.lit("Exports: "), join(f["exports"], ", "))),
            F.lit("\nRelevant Symbols:"),
            some(f["symbols"], join(F.transform(F.slice(f["symbols"], 1, 10), symbol_line))),
            some(
                f["snippets"],
                F.concat(
                    F.lit("\nCode Snippets:\n"), join(F.transform(F.slice(f["snippets"], 1, 3), snippet_lines))
                ),
            ),
        )

    types = F.when(F.size(summary["symbol_types"]) == 0, F.lit("{}")).otherwise(
        F.concat(
            F.lit("{\n"),
            join(F.transform(summary["symbol_types"], lambda t: fmt('  "%s": %d', t["type"], t["n"])), ",\n"),
            F.lit("\n}"),
        )
    )
    top = F.transform(
        summary["top_files"], lambda f: fmt("- %s (%s, %d relevant symbols)", f["path"], f["language"], f["symbol_count"])
    )
    deps = F.transform(
        F.slice("dependencies", 1, 20), lambda d: fmt("%s -> %s (%s)", d["path"], d["dst"], d["symbol"])
    )
    some = lambda items: F.when(F.size(items) > 0, join(items))
    text = F.concat_ws(
        "\n",
        F.lit("=== CODE CONTEXT SUMMARY ==="),
        fmt("Total Files: %d", summary["total_files"]),
        fmt("Total Symbols: %d", summary["total_symbols"]),
        F.concat(F.lit("Languages: "), join(summary["languages"], ", ")),
        F.concat(F.lit("Symbol Types: "), types),
        F.lit(""),
        F.lit("=== TOP RELEVANT FILES ==="),
        some(top),
        F.lit(""),
        F.lit("=== FILE DETAILS ==="),
        some(F.transform("files", file_block)),
        F.when(F.size("dependencies") > 0, F.lit("\n=== DEPENDENCIES ===")),
        some(deps),
    )
    return contexts.withColumn(out, text)


def compact_context(contexts: DataFrame, max_tokens: int = 10000) -> DataFrame:
    """Shorten the contexts whose text is over the token budget; the summary keeps the uncut totals."""
    sized = render_context(contexts, "_text").withColumn("tokens", tx.estimate_tokens(F.col("_text"))).drop("_text")
    over = F.col("tokens") > max_tokens
    shorter = F.transform(
        F.slice("files", 1, 5),
        lambda f: f.withField("full_content", F.lit(None).cast("string")).withField(
            "snippets", F.slice(f["snippets"], 1, 2)
        ),
    )
    cut = lambda c, n: F.when(over, F.slice(c, 1, n)).otherwise(F.col(c))
    return (
        sized.withColumn("files", F.when(over, shorter).otherwise(F.col("files")))
        .withColumn("symbols", cut("symbols", 20))
        .withColumn("calls", cut("calls", 10))
        .withColumn("dependencies", cut("dependencies", 10))
    )


def related_symbols(hits: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Similar entries of other files; hits in the target's own file are dropped after the cut.

    ``targets(query_id, target, entry_rank)``; hits may have these columns from their search already.
    """
    if targets is not None:
        hits = hits.join(targets.select("query_id", "target", "entry_rank"), "query_id")
    return hits.filter(F.col("file") != F.col("target"))
