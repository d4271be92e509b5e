"""Lines of texts and line differences between two versions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.once import evaluated_once


def explode_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return texts.select(*keys, F.posexplode(tx.split_lines(F.col(text))).alias("_pos", "line")).select(
        *keys, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def adjacent_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Each line with the trimmed line below it, taken from the same array instead of a window."""
    lines = texts.select(*keys, tx.split_lines(F.col(text)).alias("_lines"))
    pairs = F.transform(
        "_lines",
        lambda l, i: F.struct(
            (i + 1).alias("line_no"), l.alias("line"), tx.trim_all(F.get(F.col("_lines"), i + 1)).alias("next_line")
        ),
    )
    return lines.select(*keys, F.inline(pairs))


def _diff_lines(text: Column) -> Column:
    """Lines with their endings, so that a missing newline at the end counts as a difference."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def _numbered(name: str) -> Column:
    """The sorted lines in column ``name``, each with its number among equal lines in front: a multiset becomes a set.

    Run starts are in column ``{name}_at``, so that each run is found once and the whole stays linear in the lines.
    """
    lines, at = F.col(name), F.col(f"{name}_at")
    run = lambda s, j: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(lines)) - s - 1),
        lambda k: F.concat(k.cast("string"), F.lit(":"), F.get(lines, s)),
    )
    return F.flatten(F.transform(at, run))


def _run_starts(name: str) -> Column:
    lines = F.col(name)
    places = F.transform(lines, lambda x, i: F.when((i == 0) | (x != F.get(lines, i - 1)), i))
    return F.filter(places, lambda i: i.isNotNull())


def with_line_delta(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Add ``added``, ``removed``, ``total`` and ``real_added`` for two versions of a text.

    Lines are compared as multisets, which equals a minimal line diff unless lines move.  Both versions sit in one row,
    so everything stays local: equal lines are numbered, and set operations by hash do the rest in linear time.
    ``real_added`` tells if an added line is neither blank nor a ``//`` comment.
    """
    is_real = lambda l: (tx.trim_all(l) != "") & ~tx.trim_all(l).startswith("//")
    keep = pairs.columns
    both = ("_old", "_new")
    rows = evaluated_once(
        pairs, {"_old": F.array_sort(_diff_lines(F.col(old))), "_new": F.array_sort(_diff_lines(F.col(new)))}, keep
    )
    rows = evaluated_once(rows, {f"{c}_at": _run_starts(c) for c in both}, [*keep, *both])
    rows = evaluated_once(rows, {c: _numbered(c) for c in both}, keep)
    common = F.size(F.array_intersect("_old", "_new"))
    plain = lambda l: F.regexp_replace(l, r"^\d+:", "")
    delta = {
        "added": (F.size("_new") - common).cast("bigint"),
        "removed": (F.size("_old") - common).cast("bigint"),
        "total": (F.size("_new") + F.size("_old") - common).cast("bigint"),
        "real_added": F.exists(F.array_except("_new", "_old"), lambda l: is_real(plain(l))),
    }
    return evaluated_once(rows, delta, keep)


def with_meaningful(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Add ``meaningful``: not only whitespace, not tiny, and with an added line of real text."""
    flat = lambda c: tx.trim_all(F.regexp_replace(F.col(c), r"\s+", " "))
    changed = F.col("added") + F.col("removed")
    tiny = (F.try_divide(changed, F.col("total")) < 0.02) & (changed < 3)
    return with_line_delta(pairs, old, new).withColumn(
        "meaningful", (flat(old) != flat(new)) & ~F.coalesce(tiny, F.lit(False)) & F.col("real_added")
    )
