"""Text, path, URL and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed


# White space and line ends, beyond the blanks that a plain trim removes.
WHITE = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column) -> Column:
    """Strip leading and trailing white space of any kind."""
    return F.trim(text, F.lit(WHITE))


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing newline yields a last empty line."""
    return F.split(text, "\n", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name; a leading dot alone is not an extension."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def parent_name(path: Column) -> Column:
    """Base name of the directory; ``.`` for a file at the root."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(F.instr(path, "/") > 0, base_name(folder)).otherwise(F.lit("."))


def language(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit("unknown"))


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def sanitize_repo_id(repo_id: Column) -> Column:
    return F.regexp_replace(repo_id, r"[^a-zA-Z0-9_-]", "_")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; plain ASCII takes the cheap branch."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(
        (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")
    )


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("bigint")


def repo_owner_name(url: Column) -> Column:
    """``struct(owner, repo)`` of an https or ssh address; NULL when it is not one."""
    clean = F.regexp_replace(trim_all(url), r"git@github\.com:", "https://github.com/")
    clean = F.regexp_replace(clean, r"\.git$", "")
    pattern = r"github\.com[/:]([^/]+)/([^/\s]+)"
    return F.when(
        clean.rlike(pattern),
        F.struct(
            F.regexp_extract(clean, pattern, 1).alias("owner"),
            F.regexp_extract(clean, pattern, 2).alias("repo"),
        ),
    )


def repo_owner_name_strict(url: Column) -> Column:
    """Variant for request bodies: only ``/`` separates, ``.git`` is cut after matching."""
    pattern = r"github\.com/([^/]+)/([^/]+)"
    return F.when(
        url.rlike(pattern),
        F.struct(
            F.regexp_extract(url, pattern, 1).alias("owner"),
            F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "").alias("repo"),
        ),
    )


def iso_time(millis: Column) -> Column:
    """Epoch milliseconds as ISO-8601 text; needs a UTC session."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def count_of(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def strip_fences(text: Column) -> Column:
    """Drop Markdown code fences around a generated text."""
    opened = F.regexp_replace(text, r"(?m)^```\w*\n?", "")
    return trim_all(F.regexp_replace(opened, r"(?m)\n?```$", ""))
