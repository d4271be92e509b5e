"""Symbols of source files.

One pass: a file's lines stay an array, and only declarations are exploded, together with the few lines above or below that
their documentation may use.  Nothing here shuffles.  JS and TS declarations come as heads from the scan that also tells
whether a text parses (``functions/js.py``), because only top-level declarations and members of classes count, on however
many lines; in other languages a filter keeps the lines that look like declarations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import js
from corpusloom.functions import text as tx
from corpusloom.functions.once import built_once, evaluated_once
from corpusloom.operators import repair

SYMBOL_FIELDS = {
    "name": "string",
    "type": "string",
    "line": "int",
    "ord": "bigint",
    "params": "array<string>",
    "from_module": "string",
    "is_async": "boolean",
    "is_static": "boolean",
    "class_name": "string",
    "kind": "string",
    "exported": "boolean",
    "is_default": "boolean",
    "documentation": "string",
    "signature": "string",
    "extends": "string",
}

_WORD = r"[\w$]+"
_STRING = r"""'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`"""
_DEPTH = 2


def _nested(opening: str, closing: str, inside: str, depth: int = _DEPTH) -> str:
    """Pattern of what may stand between brackets: anything else, strings, and brackets up to ``depth`` levels.  Heads have a
    list and, emptied, the brackets inside of it."""
    text = rf"(?:{_STRING}|[^{opening}{closing}])*+"
    for _ in range(depth):
        text = rf"(?:{_STRING}|[^{opening}{closing}]|[{opening}]{text}[{closing}])*+"
    return text if inside == "any" else rf"([{opening}]){text}([{closing}])"


_IN_PARENS = _nested("(", ")", "any")
_BRACKETED = _nested(r"(\[{", r")\]}", "pair")
_GENERIC_ARGS = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*+>)*+>)*+>"
_PY_DECL = r"^(?:(?:from\s+\S+\s+)?import|def|class)\s"
_GENERIC_DECL = r"function|def|class|interface|type|=>"
_JS_FUNCTION = rf"(?s)^(?:declare\s+)?(async\s+)?function\s*\*?\s*({_WORD})\s*(?:<[^(]*>)?\s*\(({_IN_PARENS})\)"
_JS_CLASS = rf"^(?:declare\s+)?(?:abstract\s+)?class\s+({_WORD})(?:\s*<[^{{]*?>)?(?:\s+extends\s+([\w$.]+))?"
_JS_VARIABLE = r"^(?:declare\s+)?(var|let|const)\b"
_JS_EXPORT = (
    r"^export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    rf"(?:const\s+enum\s+|(?:const|let|var|class|interface|type|enum|namespace)\s+|function\s*\*?\s*)({_WORD})"
)
_JS_DEFAULT = r"^export\s+default\b"
_JS_DEFAULT_DECL = rf"^export\s+default\s+(?:async\s+)?(?:function\s*\*?\s*|(?:abstract\s+)?class\s+)({_WORD})"
_JS_DEFAULT_NAME = r"^export\s+default\s+([A-Za-z_$][\w$]*)\s*;?\s*(?://.*)?$"
_MODIFIERS = r"(?:(?:public|private|protected|override|readonly|abstract)\s+)*"
_JS_METHOD = rf"^{_MODIFIERS}(static\s+)?{_MODIFIERS}(async\s+)?\*?\s*(?:get\s+|set\s+)?(#?{_WORD})\s*\(({_IN_PARENS})\).*\{{$"
_NOT_METHODS = ["if", "for", "while", "switch", "catch", "function", "return", "with"]
_TS_INTERFACE = rf"^(?:declare\s+)?interface\s+({_WORD})"
_TS_TYPE = rf"^(?:declare\s+)?type\s+({_WORD})\s*(?:<[^=]*>)?\s*="
_LINE_STEP = 1_000_000
_HEAD_STEP = 1_000


def _ref(text: Column, pattern: str, group: int = 1) -> Column:
    """A captured group, NULL when the pattern or the group did not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _flat(text: Column) -> Column:
    """The text with strings, the inside of brackets and type arguments gone, so that its commas are separators."""
    flat = F.regexp_replace(text, _STRING, '""')
    flat = F.regexp_replace(flat, _BRACKETED, "$1$2")
    return F.regexp_replace(flat, _GENERIC_ARGS, "")


def declared_names(statement: Column) -> Column:
    """All names that a ``var``, ``let`` or ``const`` line declares, with or without values."""
    flat = _flat(F.regexp_replace(statement, rf"^(?:declare\s+)?(?:var|let|const)\s+", ""))
    flat = F.regexp_replace(flat, r"(?s);.*|//.*|[(\[{](?![)\]}]).*", "")  # also what an open bracket leaves to later lines
    names = F.transform(F.split(flat, ",", -1), lambda p: F.regexp_extract(p, rf"^\s*({_WORD})\s*(?:[=:!?]|$)", 1))
    return F.filter(names, lambda n: n != "")


def param_names(params: Column) -> Column:
    """Parameter names of a JS or TS list: identifier, default and rest forms, ``param`` for patterns."""
    flat = _flat(params)
    ident = lambda p: F.regexp_extract(p, rf"^({_WORD})", 1)
    name = lambda p: (
        F.when(p.rlike(r"^\.\.\.\s*[\{\[]"), F.lit("...param"))
        .when(p.startswith("..."), F.concat(F.lit("..."), F.regexp_extract(p, rf"^\.\.\.\s*({_WORD})", 1)))
        .when(p.rlike(r"^(?:[\{\[]|(?:private|public|protected|readonly)\s)"), F.lit("param"))
        .otherwise(ident(p))
    )
    parts = F.filter(F.transform(F.split(flat, ",", -1), tx.trim_all), lambda p: p != "")
    return F.transform(parts, name)


def py_param_names(params: Column) -> Column:
    cut = lambda p: tx.trim_all(F.substring_index(tx.trim_all(p), "=", 1))
    return F.filter(F.transform(F.split(params, ",", -1), cut), lambda p: p != "")


def signature(is_async: Column, name: Column, params: Column) -> Column:
    return F.concat(
        F.when(is_async, F.lit("async ")).otherwise(F.lit("")),
        F.lit("function "),
        name,
        F.lit("("),
        F.array_join(params, ", "),
        F.lit(")"),
    )


def js_docstring(above: Column, strip_close: bool = True) -> Column:
    """Comment text from up to nine lines above, nearest line first; blank lines are skipped, code ends it.

    By default the end of a block comment is dropped; ``strip_close=False`` keeps its slash in the text.
    """
    is_comment = lambda l: l.startswith("//") | l.startswith("*") | l.startswith("/*")
    lines = F.transform(above, tx.trim_all)
    stop = F.array_position(F.transform(lines, lambda l: ~is_comment(l) & (l != "")), F.lit(True))
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)
    kept = F.filter(F.reverse(kept), is_comment)
    if strip_close:
        kept = F.filter(kept, lambda l: l != "*/")
        kept = F.transform(kept, lambda l: F.when(l.startswith("//"), l).otherwise(F.regexp_replace(l, r"\s*\*/$", "")))
    text = F.array_join(F.transform(kept, lambda l: F.regexp_replace(l, r"^(//|\*|/\*\*?)\s*", "")), " ")
    return F.nullif(tx.trim_all(text), F.lit(""))


def py_docstring(below: Column) -> Column:
    """Docstring that opens on the next line; it ends on that line or within the 18 lines after it."""
    first_line = tx.trim_all(F.get(below, F.lit(0)))
    quote = F.substring(first_line, 1, 3)
    opened = F.substring(first_line, 4, 1 << 30)
    rest = F.slice(below, F.lit(2), F.lit(18))
    end = F.array_position(F.transform(rest, lambda l: F.contains(l, quote)), F.lit(True))
    last = F.substring_index(F.get(rest, (end - 1).cast("int")), '"""', 1)
    last = F.when(quote == "'''", F.substring_index(F.get(rest, (end - 1).cast("int")), "'''", 1)).otherwise(last)
    closed = F.concat(
        F.transform(F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")), tx.trim_all), F.array(last)
    )
    body = F.when(end > 0, closed).otherwise(F.transform(rest, tx.trim_all))
    text = F.when(
        opened.endswith(quote), F.substring(opened, F.lit(1), F.length(opened) - 3)
    ).otherwise(F.concat_ws(" ", opened, body))
    return F.when(quote.isin('"""', "'''"), tx.trim_all(text))


def import_locals(clause: Column) -> Column:
    """Local names of a JS import clause: default, ``{a as b}`` and ``* as ns`` forms, in order."""
    clause = F.regexp_replace(clause, r"^type\s+([\w$*{])", "$1")
    parts = F.split(F.regexp_replace(clause, r"[{}]", ","), ",", -1)
    names = F.transform(parts, lambda p: F.regexp_extract(p, rf"({_WORD})\s*$", 1))
    return F.filter(names, lambda n: n != "")


def _row(line: Column, text: Column, above: Column, below: Column, owner: Column, nth: Column) -> Column:
    return F.struct(
        line.alias("line"), text.alias("text"), above.alias("above"), below.alias("below"), owner.alias("owner"), nth.alias("nth")
    )


_NO_LINES = "cast(null as array<string>)"
_NO_NAME = "cast(null as string)"
_NO_SYMBOLS = "cast(array() as array<struct<" + ", ".join(f"{k}: {t}" for k, t in SYMBOL_FIELDS.items()) + ">>)"


@built_once
def _declarations(include_methods: bool) -> Column:
    """``array<struct<line, text, above, below, owner, nth>>`` of the heads of JS and TS files, or of declaration lines."""
    py, no_lines, no_name = F.col("extractor") == "python", F.expr(_NO_LINES), F.expr(_NO_NAME)
    above = lambda i: F.reverse(F.slice(F.col("_lines"), F.greatest(i - 9, F.lit(1)), F.least(i - 1, F.lit(9))))
    wanted = F.filter("_heads", lambda h: F.lit(include_methods) | h["owner"].isNull())
    heads = F.transform(wanted, lambda h: _row(h["line"], h["text"], above(h["line"]), no_lines, h["owner"], h["nth"]))

    at = lambda i: F.get(F.col("_lines"), i - 1)
    is_decl = lambda l: F.when(py, l.rlike(_PY_DECL)).otherwise(l.rlike(_GENERIC_DECL))
    below = lambda i: F.when(py, F.slice(F.col("_lines"), i + 1, F.lit(19)))
    positions = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: is_decl(at(i)))
    lines = F.transform(positions, lambda i: _row(i, at(i), no_lines, below(i), no_name, F.lit(0)))
    return F.when(F.col("extractor") == "js", heads).otherwise(lines)


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[_ref(text, p) for p in patterns])


def _what(d: Column) -> Column:
    """The kind of a declaration row; the first rule that fits wins."""
    t, ts, full = d["text"], F.col("_ts"), ~F.col("_limited")
    js = (
        F.when(
            d["owner"].isNotNull(),
            F.when(full & t.rlike(_JS_METHOD) & ~F.regexp_extract(t, _JS_METHOD, 3).isin(_NOT_METHODS), "method"),
        )
        .when(t.rlike(r"^import\b"), "import")
        .when(t.rlike(_JS_FUNCTION), "function")
        .when(t.rlike(_JS_CLASS), "class")
        .when(ts & t.rlike(_TS_INTERFACE), "interface")
        .when(ts & t.rlike(_TS_TYPE), "type")
        .when(full & t.rlike(_JS_VARIABLE) & ~t.rlike(r"^const\s+enum\b"), "variable")
        .when(full & t.rlike(_JS_DEFAULT), "default")
        .when(full & t.rlike(_JS_EXPORT), "export")
    )
    py = (
        F.when(t.rlike(fixed.PY_IMPORT), "import")
        .when(t.rlike(fixed.PY_FUNCTION), "function")
        .when(t.rlike(fixed.PY_CLASS), "class")
    )
    return F.when(F.col("extractor") == "js", js).when(F.col("extractor") == "python", py).otherwise(F.lit("generic"))


def _js_names(d: Column, what: Column) -> Column:
    t = d["text"]
    clause = F.regexp_extract(t, r"(?s)^import\s+(.*?)\s*\bfrom\s*['\"]", 1)
    declared = _ref(t, _JS_DEFAULT_DECL)
    ident = _ref(t, _JS_DEFAULT_NAME)
    one = lambda c: F.array(c)
    return (
        F.when(what == "import", import_locals(clause))
        .when(what == "method", one(F.concat(d["owner"], F.lit("."), F.regexp_extract(t, _JS_METHOD, 3))))
        .when(what == "function", one(F.regexp_extract(t, _JS_FUNCTION, 2)))
        .when(what == "class", one(F.regexp_extract(t, _JS_CLASS, 1)))
        .when(what == "interface", one(F.regexp_extract(t, _TS_INTERFACE, 1)))
        .when(what == "type", one(F.regexp_extract(t, _TS_TYPE, 1)))
        .when(what == "variable", declared_names(t))
        .when(what == "export", one(F.regexp_extract(t, _JS_EXPORT, 1)))
        .when(
            what == "default",
            one(
                F.when(declared != "extends", declared)
                .when(~ident.isin("null", "true", "false", "this", "function", "class"), ident)
                .otherwise(F.lit("default"))
            ),
        )
    )


def _py_names(d: Column, what: Column) -> Column:
    t = d["text"]
    parts = F.split(F.regexp_extract(t, fixed.PY_IMPORT, 2), ",", -1)
    return (
        F.when(what == "import", F.transform(parts, lambda p: F.substring_index(tx.trim_all(p), " as ", 1)))
        .when(what == "function", F.array(F.regexp_extract(t, fixed.PY_FUNCTION, 1)))
        .when(what == "class", F.array(F.regexp_extract(t, fixed.PY_CLASS, 1)))
    )


def _items(d: Column, what: Column) -> Column:
    """``array<struct<type, name>>``: an import or a generic line may hold several symbols."""
    t = d["text"]
    named = lambda type_, name: F.struct(type_.alias("type"), name.alias("name"))
    generic = F.array(
        named(F.lit("function"), _first_match(t, fixed.GENERIC_FUNCTIONS)),
        named(F.lit("class"), _first_match(t, fixed.GENERIC_CLASSES)),
    )
    type_ = F.when(what == "default", "export").otherwise(what)
    names = F.when(F.col("extractor") == "js", _js_names(d, what)).otherwise(_py_names(d, what))
    return F.when(what == "generic", F.filter(generic, lambda x: x["name"].isNotNull())).otherwise(
        F.transform(names, lambda n: named(type_, n))
    )


def _symbol_rows(d: Column, what: Column, strip_close: bool) -> Column:
    """``array<struct>`` of the symbols of one declaration row; all but name, type and position is shared."""
    t, full = d["text"], ~F.col("_limited")
    is_js, is_py = F.col("extractor") == "js", F.col("extractor") == "python"
    function, method = what == "function", what == "method"
    js_params = F.when(function, F.regexp_extract(t, _JS_FUNCTION, 3)).when(method, F.regexp_extract(t, _JS_METHOD, 4))
    documented = is_js & full & what.isin("import", "function", "class", "method", "interface", "type")
    module = F.when(is_js, _ref(t, r"(?s)^import\s+.*?\bfrom\s*['\"]([^'\"]*)['\"]")).otherwise(
        _ref(t, fixed.PY_IMPORT)
    )
    bases = F.when(is_js, _ref(t, _JS_CLASS, 2)).otherwise(_ref(t, r"^class\s+\w+\(\s*([\w.]+)"))
    shared = {
        "line": d["line"],
        "params": F.when(is_js, param_names(js_params)).when(
            is_py & function, py_param_names(F.regexp_extract(t, fixed.PY_FUNCTION, 2))
        ),
        "from_module": F.when(what == "import", module),
        "is_async": F.when(is_js & full & function, F.regexp_extract(t, _JS_FUNCTION, 1) != "").when(
            method, F.regexp_extract(t, _JS_METHOD, 2) != ""
        ),
        "is_static": F.when(method, F.regexp_extract(t, _JS_METHOD, 1) != ""),
        "class_name": d["owner"],
        "kind": F.when(what == "variable", F.regexp_extract(t, _JS_VARIABLE, 1)),
        "exported": F.when(what == "variable", False).when(what == "export", True),
        "is_default": F.when(what == "default", True),
        "documentation": F.when(documented, js_docstring(d["above"], strip_close)).when(
            is_py & what.isin("function", "class"), py_docstring(d["below"])
        ),
        "extends": F.when(what == "class", bases),
    }
    signed = F.when(
        is_js & function & full,
        signature(F.regexp_extract(t, _JS_FUNCTION, 1) != "", F.regexp_extract(t, _JS_FUNCTION, 2), param_names(js_params)),
    )

    def row(item: Column, i: Column) -> Column:
        own = {
            **shared,
            "name": item["name"],
            "type": item["type"],
            "ord": d["line"].cast("bigint") * _LINE_STEP + d["nth"] * _HEAD_STEP + i,
            "signature": signed,
        }
        return F.struct(*[own[k].cast(t).alias(k) for k, t in SYMBOL_FIELDS.items()])

    return F.transform(_items(d, what), row)


@built_once
def _file_symbols(include_methods: bool, strip_close: bool) -> Column:
    """The symbols of a file as one array, in order; the kind of a declaration is told once."""
    told = F.transform(_declarations(include_methods), lambda d: F.struct(d.alias("d"), _what(d).alias("what")))
    return F.flatten(F.transform(told, lambda x: F.coalesce(_symbol_rows(x["d"], x["what"], strip_close), F.expr(_NO_SYMBOLS))))


def route_files(files: DataFrame, parity: bool = False) -> DataFrame:
    """Choose an extractor per file and repair JS and TS files that do not parse.

    Adds ``extractor`` (``js``, ``python``, ``generic``), ``source`` (the text to read), ``repaired`` (read from the
    repaired text), ``fixes``, ``fixed_content`` and ``heads`` of JS and TS declarations.  A JS or TS file that still does not parse after the repair is read
    by the generic patterns from its original text, without a fix record.
    """
    ext = F.lower(tx.extension(F.col("path")))
    is_js = ext.isin(fixed.JS_EXTENSIONS + fixed.TS_EXTENSIONS)
    checked = files.withColumn("_scan", js.scan(F.when(is_js, F.col("content")), ext))
    tried = repair.repair_files(checked, ~F.col("_scan.ok"), parity)
    tried = tried.withColumn("_again", js.scan(F.when(F.size("fixes") > 0, F.col("fixed_content")), ext))
    done = F.coalesce(F.col("_again.ok"), F.lit(False))
    extractor = (
        F.when(is_js & (F.col("_scan.ok") | done), F.lit("js"))
        .when(ext.isin(fixed.PY_EXTENSIONS), F.lit("python"))
        .otherwise(F.lit("generic"))
    )
    columns = {
        "repaired": done,
        "extractor": extractor,
        "source": F.when(done, F.col("fixed_content")).otherwise(F.col("content")),
        "fixes": F.when(done, F.col("fixes")).otherwise(F.expr(repair.NO_FIXES)),
        "fixed_content": F.when(done, F.col("fixed_content")),
        "heads": F.when(done, F.col("_again.heads")).otherwise(F.col("_scan.heads")),
    }
    return evaluated_once(tried, columns, files.columns)


def file_symbols(
    files: DataFrame, include_methods: bool = True, strip_close: bool = True, parity: bool = False
) -> DataFrame:
    """(repo_id, path, extractor, language, size, symbols): one row per file of ``files(repo_id, path, content)``.

    ``symbols`` is an array in order, so that what a file needs of its own symbols is folded in its row, without a shuffle.
    Files may come routed already (see :func:`route_files`).
    """
    routed = files if "extractor" in files.columns else route_files(files, parity)
    ext = F.lower(tx.extension(F.col("path")))
    rows = routed.select(
        "repo_id",
        "path",
        "extractor",
        tx.language(ext).alias("language"),
        tx.utf16_length(F.col("content")).alias("size"),
        F.col("repaired").alias("_limited"),
        ext.isin(fixed.TS_EXTENSIONS).alias("_ts"),
        tx.split_lines(F.col("source")).alias("_lines"),
        F.col("heads").alias("_heads"),
    )
    return evaluated_once(rows, {"symbols": _file_symbols(include_methods, strip_close)}, ["repo_id", "path", "extractor", "language", "size"])


def exploded(rows: DataFrame) -> DataFrame:
    """One row per symbol of :func:`file_symbols`."""
    return rows.select("repo_id", F.col("path").alias("file"), "extractor", "language", F.inline("symbols"))


def extract_symbols(
    files: DataFrame, include_methods: bool = True, strip_close: bool = True, parity: bool = False
) -> DataFrame:
    """All symbols of ``files(repo_id, path, content)`` with ``extractor`` and ``language`` columns."""
    return exploded(file_symbols(files, include_methods, strip_close, parity))


def export_scan(files: DataFrame) -> DataFrame:
    """Export declarations anywhere in a text, also over line breaks: name, line of the match and position."""
    nl = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    add = lambda acc, x: acc + x
    text = F.col("content")
    found = files.select(
        "repo_id",
        "path",
        F.regexp_extract_all(text, F.lit(fixed.EXPORT_ANYWHERE), F.lit(1)).alias("_names"),
        F.transform(F.regexp_extract_all(text, F.lit(fixed.EXPORT_ANYWHERE), F.lit(0)), nl).alias("_in"),
        F.transform(F.split(text, fixed.EXPORT_ANYWHERE, -1), nl).alias("_between"),
    ).filter(F.size("_names") > 0)
    rows = F.transform(
        "_names",
        lambda n, i: F.struct(
            n.alias("name"),
            (
                1
                + F.aggregate(F.slice("_between", F.lit(1), i + 1), F.lit(0), add)
                + F.aggregate(F.slice("_in", F.lit(1), i), F.lit(0), add)
            ).alias("line"),
            i.alias("ord"),
        ),
    )
    return found.select("repo_id", "path", F.inline(rows))
