from pyspark.sql import functions as F

from corpusloom.operators import extract, graph


def symbols(files, contents, **kw):
    rows = extract.extract_symbols(files(contents), **kw).orderBy("file", "ord").collect()
    return rows


def test_python_imports_and_functions(files):
    text = "import os, sys as s\n    import hidden\nfrom a.b import c\ndef f(a, b=1, *c):\n    pass\nasync def g():\n    pass\nclass K(Base):\n"
    got = [(r.type, r.name, r.from_module, r.params, r.line) for r in symbols(files, {"a.py": text})]
    assert got == [
        ("import", "os", None, None, 1),
        ("import", "sys", None, None, 1),
        ("import", "c", "a.b", None, 3),
        ("function", "f", None, ["a", "b", "*c"], 4),
        ("class", "K", None, None, 8),
    ]


def test_python_docstrings(files):
    text = (
        'def a():\n    """One."""\n'
        "def b():\n    '''First\n    second\n    third''' + x\n"
        "def c():\n    return 1\n"
        'def d():\n    """Open\n' + "    more\n" * 30
    )
    docs = {r.name: r.documentation for r in symbols(files, {"a.py": text})}
    assert docs["a"] == "One."
    assert docs["b"] == "First second     third"
    assert docs["c"] is None
    assert docs["d"] == "Open" + " more" * 18


def test_js_imports_over_several_lines(files):
    text = (
        "import d, { a as b,\n  c } from './m'\nimport * as ns from \"n\"\nimport './side'\n"
        "import type { T } from './t'\n"
    )
    got = [(r.name, r.from_module, r.line) for r in symbols(files, {"a.ts": text})]
    assert got == [("d", "./m", 1), ("b", "./m", 1), ("c", "./m", 1), ("ns", "n", 3), ("T", "./t", 5)]


def test_js_declarations(files):
    text = (
        "async function f(a, { b }, [c], d = 1, ...e) {}\n"
        "function g(\n  x,\n  y\n) {}\n"
        "let a1, b1;\nconst { z } = o;\nvar w = 2\n"
        "export function h() {}\nexport const { q } = o;\nexport { a1 };\nexport class K {}\n"
        "export default 1\nexport default f\nexport default class Named {}\n"
    )
    got = [(r.type, r.name, r.params, r.signature) for r in symbols(files, {"a.js": text})]
    assert got == [
        ("function", "f", ["a", "param", "param", "d", "...e"], "async function f(a, param, param, d, ...e)"),
        ("function", "g", ["x", "y"], "function g(x, y)"),
        ("variable", "a1", None, None),
        ("variable", "b1", None, None),
        ("variable", "w", None, None),
        ("export", "h", None, None),
        ("export", "K", None, None),
        ("export", "default", None, None),
        ("export", "f", None, None),
        ("export", "Named", None, None),
    ]


def test_typescript_types_only_in_ts(files):
    text = "interface I {\n}\ntype T<A> = string\nabstract class C<X> extends B {\n}\n"
    ts = [(r.type, r.name, r.extends) for r in symbols(files, {"a.ts": text})]
    assert ts == [("interface", "I", None), ("type", "T", None), ("class", "C", "B")]
    js = [(r.type, r.name) for r in symbols(files, {"a.js": text})]
    assert js == [("class", "C")]


def test_methods_and_flag(files):
    text = (
        "class A {\n  /** Makes it. */\n  constructor(x) {\n    if (x) {\n      y();\n    }\n  }\n"
        "  static async load(u) {\n  }\n}\nfunction other() {\n  nested(a) {\n}\n"
    )
    got = [(r.name, r.is_async, r.is_static, r.documentation) for r in symbols(files, {"a.js": text + "}\n"}) if r.type == "method"]
    assert got == [("A.constructor", False, False, "Makes it."), ("A.load", True, True, None)]
    assert not [r for r in symbols(files, {"a.js": text + "}\n"}, include_methods=False) if r.type == "method"]


def test_js_docstring_forms(files):
    text = "code()\n/**\n * Foo\n *   Bar\n */\nfunction f() {}\n// one\n\n// two\nfunction g() {}\n"
    docs = {r.name: r.documentation for r in symbols(files, {"a.js": text}) if r.type == "function"}
    assert docs == {"f": "Foo Bar", "g": "one two"}
    kept = {r.name: r.documentation for r in symbols(files, {"a.js": text}, strip_close=False) if r.type == "function"}
    assert kept["f"] == "Foo Bar /"


def test_generic_patterns_take_the_first_match(files):
    text = "const f = (a) => a\nx: function (b) {\nthe function g( in class K\ntype T = 1\n"
    got = [(r.type, r.name, r.line) for r in symbols(files, {"a.go": text})]
    assert got == [("function", "f", 1), ("function", "x", 2), ("function", "g", 3), ("class", "K", 3), ("class", "T", 4)]


def test_broken_js_is_repaired_or_read_by_patterns(files):
    repaired = "// Doc\nfunction f(a) {\n  return [a]\nlet v = 1;\n"
    hopeless = "function f(a) {\nexport const x = 1;\n"
    crossed = "function f(a) {\n  return [a\n}\nlet v = 1;\n"  # a bracket at the end of the file would not nest
    got = [
        (r.file, r.extractor, r.type, r.name, r.documentation, r.signature)
        for r in symbols(files, {"a.js": repaired, "b.js": hopeless, "c.js": crossed})
    ]
    assert got == [
        ("a.js", "js", "function", "f", None, None),
        ("b.js", "generic", "function", "f", None, None),
        ("c.js", "generic", "function", "f", None, None),
    ]


def test_brackets_in_strings_and_comments_do_not_break_a_file(files):
    text = "const s = '({[';\n// {{\n/* (( */\nconst t = `{`;\nconst u = \"it's (\";\nexport const x = 1;\n"
    assert {r.extractor for r in symbols(files, {"a.js": text})} == {"js"}


def test_export_scan_counts_lines_over_breaks(files):
    text = "a\nexport\nconst first = 1\n\nexport class Second {} export let third\n"
    got = [(r.name, r.line, r.ord) for r in extract.export_scan(files({"a.js": text})).orderBy("ord").collect()]
    assert got == [("first", 2, 0), ("Second", 5, 1), ("third", 5, 2)]


def test_dedup_keeps_last_value_at_first_place(files):
    text = "function f() {}\nlet b = 1;\nexport default f\n"
    rows = graph.symbol_dedup(extract.extract_symbols(files({"a.js": text}))).orderBy("ord").collect()
    assert [(r.name, r.type, r.line) for r in rows] == [("f", "export", 3), ("b", "variable", 2)]


def test_edges_of_bare_imports_point_to_null(files):
    edges = graph.build_edges(extract.extract_symbols(files({"a.py": "import os\n"}))).collect()
    assert [(e.src, e.dst, e.type) for e in edges] == [("a.py::os", "null::os", "imports")]


def test_languages_by_extension(spark):
    from corpusloom.functions import text as tx

    rows = spark.createDataFrame([("a.mjs",), ("a.cs",), ("x/.js",), ("a.b.TSX",), ("none",)], "p string")
    got = [r[0] for r in rows.select(tx.language(tx.extension(F.col("p")))).collect()]
    assert got == ["javascript", "unknown", "unknown", "typescript", "unknown"]


def test_js_nested_parameters_and_declarators(files):
    text = (
        "function f(a = g(1), b = 2) {}\n"
        "function g(\n  a = h(1, (2)),\n  { x: { y }, z },\n  b = 'p, q)'\n) {}\n"
        "let a1 = 1, b1 = f(2, 3), c1;\nconst m: Map<string, Array<number>> = x, n = [1, 2];\n"
        "const open = call(x, y,\n  z)\nconst u = 'a, b'; f(v, w)\nvar r = /a,b/\n"
        "class K {\n  m(a = g(1), b) {\n  }\n}\n"
    )
    got = [(r.type, r.name, r.params) for r in symbols(files, {"a.ts": text})]
    assert got == [
        ("function", "f", ["a", "b"]),
        ("function", "g", ["a", "param", "b"]),
        ("variable", "a1", None),
        ("variable", "b1", None),
        ("variable", "c1", None),
        ("variable", "m", None),
        ("variable", "n", None),
        ("variable", "open", None),
        ("variable", "u", None),
        ("variable", "r", None),
        ("class", "K", None),
        ("method", "K.m", ["a", "b"]),
    ]


def test_js_declarations_over_several_lines(files):
    deep = "q(w(e(r(t(y(u(i(o(p(1))))))))))"
    text = (
        f"function d(a = {deep},\n  b) {{\n}}\n"
        "let a = 1,\n  b = 2,\n  c = function () {\n    let hidden = 1;\n  },\n  d = s => /[(,]/.test(s);\n"
        "class K {\n  /** Doc. */\n  wide(a,\n    b = {}) {\n  }\n  private static async load(x: Map<string, number>, y): Promise<Array<number>> {\n  }\n"
        "  field = (z) => {\n  }\n  get size() { return 1 }\n}\n"
        "let one = 1; let two = 2;\n  function indented() {}\nconst { gone } = o,\n  stays = 1\n"
        "`\nfunction text() {}\n`;\n/*\nlet comment = 1;\n*/\nif (x) {\nlet inner = 1;\n}\n"
    )
    got = [(r.type, r.name, r.params, r.line, r.documentation) for r in symbols(files, {"a.ts": text})]
    assert got == [
        ("function", "d", ["a", "b"], 1, None),
        ("variable", "a", None, 4, None),
        ("variable", "b", None, 4, None),
        ("variable", "c", None, 4, None),
        ("variable", "d", None, 4, None),
        ("class", "K", None, 10, None),
        ("method", "K.wide", ["a", "b"], 12, "Doc."),
        ("method", "K.load", ["x", "y"], 15, None),
        ("method", "K.size", [], 19, None),
        ("variable", "one", None, 21, None),
        ("variable", "two", None, 21, None),
        ("function", "indented", [], 22, None),
        ("variable", "stays", None, 23, None),
    ]
    load = [r for r in symbols(files, {"a.ts": text}) if r.name == "K.load"][0]
    assert load.is_async and load.is_static
