"""Bracket and semicolon lint over a whole corpus; every check is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as tx

BRACKETS = [("brace", "{", "}"), ("bracket", "[", "]"), ("paren", "(", ")")]


def net_count(text: Column, opening: str, closing: str) -> Column:
    return tx.count_of(text, opening) - tx.count_of(text, closing)


def bracket_issues(text: Column) -> Column:
    """``array<struct<ord, type, cnt, severity>>`` with the net surplus per bracket kind."""
    found = []
    for sign, label, base in ((1, "unclosed", 0), (-1, "extra-closing", 3)):
        for i, (name, opening, closing) in enumerate(BRACKETS):
            cnt = (net_count(text, opening, closing) * sign).cast("bigint")
            found.append(_issue(base + i, f"{label}-{name}", cnt))
    return F.filter(F.array(*found), lambda x: x["cnt"] > 0)


def _issue(order: int, type_: str, cnt: Column, severity: str | None = None) -> Column:
    return F.struct(
        F.lit(order).alias("ord"),
        F.lit(type_).alias("type"),
        cnt.alias("cnt"),
        F.lit(severity).cast("string").alias("severity"),
    )


def missing_semicolons(text: Column) -> Column:
    """Number of statement lines without an ending; only meaningful for JS and TS."""
    lines = F.transform(tx.split_lines(text), tx.trim_all)
    hits = F.filter(
        lines,
        lambda l: l.rlike(fixed.LINT_STATEMENT) & ~(l.endswith(";") | l.endswith("{") | l.endswith("}")),
    )
    return F.size(hits).cast("bigint")


def semicolon_issues(text: Column, language: Column) -> Column:
    issue = _issue(6, "missing-semicolons", missing_semicolons(text), "warning")
    empty = F.filter(F.array(issue), lambda x: F.lit(False))
    return F.when(
        language.isin("javascript", "typescript"), F.filter(F.array(issue), lambda x: x["cnt"] > 0)
    ).otherwise(empty)


def lint_brackets(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per text and bracket kind that does not balance."""
    return texts.select(*keys, F.inline(bracket_issues(F.col(text)))).drop("ord")


def lint_semicolons(files: DataFrame) -> DataFrame:
    lang = tx.language(tx.extension(F.col("path")))
    return files.select("repo_id", "path", F.inline(semicolon_issues(F.col("content"), lang))).drop("ord")


def lint_report(files: DataFrame) -> DataFrame:
    """One text per file that lists its issues in a fixed order."""
    lang = tx.language(tx.extension(F.col("path")))
    issues = F.concat(bracket_issues(F.col("content")), semicolon_issues(F.col("content"), lang))
    # fixed values: report lines
    line = lambda x: (
        F.when(x["type"] == "unclosed-brace", F.format_string("  - %d unclosed brace(s) {", x["cnt"]))
        .when(x["type"] == "unclosed-bracket", F.format_string("  - %d unclosed bracket(s) [", x["cnt"]))
        .when(x["type"] == "unclosed-paren", F.format_string("  - %d unclosed parenthesis(es) (", x["cnt"]))
        .when(x["type"] == "missing-semicolons", F.format_string("  - %d missing semicolon(s) (warning)", x["cnt"]))
        .otherwise(F.format_string('  - %s: {"type":"%s","count":%d}', x["type"], x["type"], x["cnt"]))
    )
    report = F.when(F.size("issues") == 0, F.lit("No syntax errors detected")).otherwise(
        F.concat_ws(
            "\n",
            F.format_string("Found %d syntax issue(s):", F.size("issues")),
            F.array_join(F.transform("issues", line), "\n"),
        )
    )
    return files.select("repo_id", "path", issues.alias("issues")).select("repo_id", "path", report.alias("report"))
