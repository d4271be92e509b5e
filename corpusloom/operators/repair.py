"""Rule-based repair of JS and TS texts: a fixed order of row-local rewrites plus a list of what was changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import js
from corpusloom.functions import text as tx
from corpusloom.functions.once import built_once, evaluated_once
from corpusloom.operators import lint

FIX_TYPE = "array<struct<type:string,line:int,cnt:bigint,before:string,after:string,description:string>>"
NO_FIXES = f"cast(array() as {FIX_TYPE})"


def _fix(type_: str, line=None, cnt=None, before=None, after=None, description: str | None = None) -> Column:
    none = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(
        F.lit(type_).alias("type"),
        none(line, "int").alias("line"),
        none(cnt, "bigint").alias("cnt"),
        none(before, "string").alias("before"),
        none(after, "string").alias("after"),
        F.lit(description).cast("string").alias("description"),
    )


def _fix_if(condition: Column, fix: Column) -> Column:
    return F.when(condition, F.array(fix).cast(FIX_TYPE)).otherwise(F.expr(NO_FIXES))


def repair_incomplete_object(text: Column) -> Column:
    return F.regexp_replace(text, fixed.INCOMPLETE_OBJECT, "export $1 $2 = {\n  async $3")


def needs_semicolon(line: Column, next_line: Column) -> Column:
    """Whether a line is a statement that lacks its semicolon, given the line below it."""
    t, following = tx.trim_all(line), tx.trim_all(F.coalesce(next_line, F.lit("")))
    settled = (
        (t == "")
        | t.startswith("//")
        | t.startswith("/*")
        | t.startswith("*")
        | t.rlike(r"[;{}\])=,]$")
        | following.startswith("async ")
        | following.startswith("function ")
    )
    return ~settled & (t.rlike(fixed.REPAIR_STATEMENT) | t.rlike(fixed.REPAIR_ASSIGNMENT))


def repair_commas(text: Column) -> Column:
    text = F.regexp_replace(text, fixed.COMMA_BEFORE_METHOD, "},\n  async $1")
    return F.regexp_replace(text, fixed.COMMA_BETWEEN_PROPERTIES, "$1,\n$2")


def repair_types(text: Column) -> Column:
    return F.regexp_replace(text, fixed.INCOMPLETE_TYPE, ": any")


def repair_trailing_commas(text: Column) -> Column:
    text = F.regexp_replace(text, fixed.TRAILING_COMMA_AT_END, "$1")
    return F.regexp_replace(text, fixed.TRAILING_COMMA, "$1")


def repair_brackets(text: Column, parity: bool = False) -> Column:
    """Append missing closings.  After a last ``}`` line they come as ``};``, in parity mode only one brace."""
    missing = lambda o, c: F.greatest(lint.net_count(text, o, c), F.lit(0))
    braces = missing("{", "}")
    last_line = F.element_at(F.split(tx.trim_all(text), "\n", -1), -1)
    closing = F.lit("}") if parity else F.repeat(F.lit("}"), braces)
    closed = (
        F.when(braces == 0, text)
        .when(
            tx.trim_all(last_line).rlike(r"^\},?$"),
            F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"), closing, F.lit(";")),
        )
        .otherwise(F.concat(text, F.lit("\n"), F.repeat(F.lit("}"), braces)))
    )
    return F.concat(
        closed, F.repeat(F.lit(")"), missing("(", ")")), F.repeat(F.lit("]"), missing("[", "]"))
    )


@built_once
def _semicolon_lines() -> Column:
    """``array<struct<line, before>>`` of the lines in ``_lines`` that lack a semicolon.

    The line below comes from the same array, so no window or shuffle is involved.
    """
    found = F.transform(
        "_lines",
        lambda l, i: F.when(
            needs_semicolon(l, F.get(F.col("_lines"), i + 1)), F.struct((i + 1).alias("line"), l.alias("before"))
        ),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _with_semicolons(text: Column, changed: Column) -> Column:
    at = F.transform(changed, lambda x: x["line"])
    lines = F.transform(
        "_lines", lambda l, i: F.when(F.array_contains(at, i + 1), F.concat(l, F.lit(";"))).otherwise(l)
    )
    return F.when(F.size(changed) == 0, text).otherwise(F.array_join(lines, "\n"))


def repair_semicolons(files: DataFrame, text: str = "content", out: str = "repaired") -> DataFrame:
    """Add missing semicolons; ``out`` is the new text and ``<out>_lines`` the changed lines."""
    lined = files.withColumn("_lines", tx.split_lines(F.col(text)))
    lined = evaluated_once(lined, {f"{out}_lines": _semicolon_lines()}, lined.columns)
    return lined.withColumn(out, _with_semicolons(F.col(text), F.col(f"{out}_lines"))).drop("_lines")


def repair_files(files: DataFrame, only: Column | None = None, parity: bool = False) -> DataFrame:
    """Apply all rules in order to JS and TS files; adds ``fixed_content`` and ``fixes``.

    ``only`` selects the rows to repair; the others keep NULL in ``fixed_content`` and cost nothing.
    """
    ext = F.lower(tx.extension(F.col("path")))
    is_ts = ext.isin(fixed.TS_EXTENSIONS)
    wanted = ext.isin(fixed.JS_EXTENSIONS + fixed.TS_EXTENSIONS)
    wanted = wanted if only is None else wanted & only
    steps = [
        {"_0": F.when(wanted, F.col("content"))},
        {"_1": repair_incomplete_object(F.col("_0"))},
        {"_lines": tx.split_lines(F.col("_1"))},
        {"_2_lines": _semicolon_lines()},
        {"_2": _with_semicolons(F.col("_1"), F.col("_2_lines"))},
        {"_3a": F.regexp_replace("_2", fixed.COMMA_BEFORE_METHOD, "},\n  async $1")},
        {"_3": F.regexp_replace("_3a", fixed.COMMA_BETWEEN_PROPERTIES, "$1,\n$2")},
        {"_4": F.when(is_ts, repair_types(F.col("_3"))).otherwise(F.col("_3"))},
        {"_5": F.regexp_replace("_4", fixed.TRAILING_COMMA_AT_END, "$1")},
    ]
    prep = files
    for step in steps:
        prep = prep.withColumns(step)
    repaired = F.regexp_replace(repair_brackets(F.col("_5"), parity), fixed.TRAILING_COMMA, "$1")
    fixes = F.when(F.col("_0").isNotNull(), _fix_list()).otherwise(F.expr(NO_FIXES))
    prep = prep.withColumn("_ts", is_ts)
    return evaluated_once(prep, {"fixed_content": repaired, "fixes": fixes}, files.columns)


@built_once
def _fix_list() -> Column:
    semicolons = F.transform(
        "_2_lines",
        lambda x: _fix("missing-semicolon", x["line"], None, x["before"], F.concat(x["before"], F.lit(";"))),
    ).cast(FIX_TYPE)
    fixes = [
        _fix_if(
            F.col("_0").rlike(fixed.INCOMPLETE_OBJECT),
            _fix(
                "incomplete-object-declaration",
                description=fixed.FIXED_OBJECT,
            ),
        ),
        semicolons,
        _fix_if(
            F.col("_3a").rlike(fixed.COMMA_BETWEEN_PROPERTIES),
            _fix("missing-comma", description=fixed.FIXED_COMMAS),
        ),
        _fix_if(
            F.col("_ts") & F.col("_3").rlike(fixed.INCOMPLETE_TYPE),
            _fix("incomplete-type", description=fixed.FIXED_TYPES),
        ),
    ]
    for name, o, c in (lint.BRACKETS[0], lint.BRACKETS[2], lint.BRACKETS[1]):
        missing = lint.net_count(F.col("_5"), o, c)
        fixes.append(_fix_if(missing > 0, _fix(f"missing-closing-{name}", cnt=missing)))
    return F.concat(*fixes)


def smart_repair(files: DataFrame, parity: bool = False) -> DataFrame:
    """Repair the files that do not parse and keep those where a rule applied and the result parses.

    A file whose brackets nest is never touched, whatever its strings, templates, regex literals and markup hold.
    """
    ext = F.lower(tx.extension(F.col("path")))
    wanted = ext.isin(fixed.JS_EXTENSIONS + fixed.TS_EXTENSIONS)
    scanned = files.withColumn("_scan", js.scan(F.when(wanted, F.col("content")), ext))
    repaired = repair_files(scanned, ~F.col("_scan.ok"), parity).filter(F.size("fixes") > 0)
    return repaired.withColumn("_scan", js.scan(F.col("fixed_content"), ext)).filter("_scan.ok").drop("_scan")


def validate_fix(original: Column, repaired: Column) -> Column:
    """A fix is suspicious when it adds over 10 % lines or moves a bracket count by more than 3."""
    lines = lambda c: tx.count_of(c, "\n") + 1
    ok = lines(repaired) <= lines(original) * 1.1
    for char in "{}[]()":
        ok = ok & (F.abs(tx.count_of(repaired, char) - tx.count_of(original, char)) <= 3)
    return ok
