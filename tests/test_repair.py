import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import js
from corpusloom.operators import lines, lint, repair


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_bracket_counts_are_net(spark):
    assert one(spark, ")(", lint.bracket_issues(F.col("t")))[0] == []
    got = one(spark, "{{[)", lint.bracket_issues(F.col("t")))[0]
    assert [(i.type, i.cnt) for i in got] == [("unclosed-brace", 2), ("unclosed-bracket", 1), ("extra-closing-paren", 1)]


def test_semicolon_lint(spark):
    for text, n in (("return x", 1), ("return {", 0), ("  let a = 1;", 0), ("// return x", 0), ("const f", 1), ("constant f", 0)):
        assert one(spark, text, lint.missing_semicolons(F.col("t")))[0] == n, text


def test_report(spark, files):
    rows = {r.path: r.report for r in lint.lint_report(files({"a.js": "let a = (\n", "b.js": "ok()", "c.py": "])"})).collect()}
    assert rows["a.js"] == "Found 2 syntax issue(s):\n  - 1 unclosed parenthesis(es) (\n  - 1 missing semicolon(s) (warning)"
    assert rows["b.js"] == "No syntax errors detected"
    assert rows["c.py"].startswith("Found 2") and '- extra-closing-bracket: {"type":"extra-closing-bracket","count":1}' in rows["c.py"]


def test_missing_braces_full_count_and_parity(spark):
    text = "a {\n b {\n  c {\n }\n"
    assert one(spark, text, repair.repair_brackets(F.col("t")))[0] == "a {\n b {\n  c {\n }\n}};"
    assert one(spark, text, repair.repair_brackets(F.col("t"), True))[0] == "a {\n b {\n  c {\n }\n};"
    assert one(spark, "f(a[{", repair.repair_brackets(F.col("t")))[0] == "f(a[{\n})]"


def test_brackets_close_for_any_text(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("{}[]()a\n ,;") for _ in range(rng.randint(0, 40))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string").select(lint.bracket_issues(repair.repair_brackets(F.col("t"))).alias("i"))
    assert df.filter(F.exists("i", lambda x: x["type"].startswith("unclosed"))).count() == 0


def test_semicolons_respect_the_next_line(spark, files):
    text = "import a from 'a'\nreturn x\nasync f\nlet b = 1\nfunction g\nconst c = a,\nthrow e\nx = 1"
    row = repair.repair_semicolons(files({"a.js": text})).first()
    assert row.repaired == "import a from 'a';\nreturn x\nasync f\nlet b = 1\nfunction g\nconst c = a,\nthrow e;\nx = 1"
    assert [x.line for x in row.repaired_lines] == [1, 7]


def test_repair_only_touches_js_and_ts(files):
    rows = {r.path: r for r in repair.repair_files(files({"a.py": "f(", "b.ts": "let a:\n", "c.js": "let a:\n"})).collect()}
    assert rows["a.py"].fixed_content is None and rows["a.py"].fixes == []
    assert rows["b.ts"].fixed_content == "let a: any" and [f.type for f in rows["b.ts"].fixes] == ["incomplete-type"]
    assert rows["c.js"].fixed_content == "let a:\n"


def test_validate_fix(spark):
    df = spark.createDataFrame([("a\n" * 20, "a\n" * 21), ("a", "a\nb"), ("a", "a{{{{")], "o string, n string")
    assert [r[0] for r in df.select(repair.validate_fix(F.col("o"), F.col("n"))).collect()] == [True, False, False]


def _brute_delta(old, new):
    from collections import Counter
    import re

    split = lambda t: Counter(re.findall(r"[^\n]*\n|[^\n]+", t))
    o, n = split(old), split(new)
    return sum((n - o).values()), sum((o - n).values()), sum((n | o).values())


def test_line_delta_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["a\n", "b\n", "\n", "}\n", "// c\n", "a"]) for _ in range(rng.randint(0, 30)))
    rows = [(i, text(), text()) for i in range(200)]
    df = lines.with_line_delta(spark.createDataFrame(rows, "i int, o string, n string"), "o", "n")
    for r in df.collect():
        assert (r.added, r.removed, r.total) == _brute_delta(r.o, r.n)


def test_meaningful_change_rules(spark):
    long = "".join(f"line {i}\n" for i in range(200))
    cases = [
        ("a b", "a   b\n", False),
        ("a\nb\nc\n", "a\n", False),
        (long, long + "one\n", False),
        (long, long + "one\ntwo\nthree\n", True),
        ("a\n", "a\n// note\n", False),
        ("a\n", "a\nb\n", True),
        ("", "", False),
        ("a\na\n", "a\na\na\n", True),
    ]
    df = lines.with_meaningful(spark.createDataFrame([(o, n) for o, n, _ in cases], "o string, n string"), "o", "n")
    assert [r.meaningful for r in df.collect()] == [m for _, _, m in cases]


def test_adjacent_lines(files):
    rows = lines.adjacent_lines(files({"a": "x\n  y \nz"}), ["path"], "content").collect()
    assert [(r.line_no, r.line, r.next_line) for r in rows] == [(1, "x", "y"), (2, "  y ", "z"), (3, "z", None)]


VALID = [
    "const re = /[(]/;\n", "x.split(/['\"(]/g)\n", "f(a, /[/(]/)\n", "const e = <A b={c} />;\n", "y = (a) / b / (c)\n",
    "export const f = s => /[(]/.test(s);\n", "ys.filter(y => /\\(/.test(y))\n", "typeof /x(/\n", "switch (x) { case /\\{/.test(x): break }\n",
    "const t = `a${f(`b${1}(`)}{`;\n", "const p = <p title='('>it's ( {y.map(z => <b key={z}>{z} )</b>)}</p>;\n", "const q = <></>;\n",
    "if (a) /x(/.test(b)\n", "a = b++ / 2; c = {a: 1} / 2 / (d)\n", "for (let i = 0; i < 2; i++) {}\n", "#!/usr/bin/env node (\nlet a\n",
    "let m: Map<string, (a: {b: string}) => void> = new Map<string, Array<number>>();\n", "const g = <T,>(x: T) => x\n",
]
BROKEN = ["function f() {\n", "a = f(/x/\n", "(]\n", "}\n", "`abc", "/* x", "a = [1;]\n", "function f() {\nimport x from 'y'\n}\n"]


def test_brackets_in_literals_and_markup_are_not_code(files):
    assert [js.scan_text(t)["ok"] for t in VALID] == [True] * len(VALID)
    assert [js.scan_text(t)["ok"] for t in BROKEN] == [False] * len(BROKEN)
    given = files({f"a{i}.tsx": t for i, t in enumerate(VALID)} | {"b.js": "f(a"})
    assert [r.path for r in repair.smart_repair(given).collect()] == ["b.js"]


@pytest.mark.parametrize("piece", ["<a ", "a<", "'", "/", "`${", "(", "\\", "/*", '"\\\n', "<a>", "{", "x = /[", "x = /[a]", "= /[a]b["])
def test_scan_time_follows_the_length(piece):
    started = time.perf_counter()
    js.scan_text(piece * (100_000 // len(piece)))
    assert time.perf_counter() - started < 5


def test_line_delta_of_many_repeated_lines(spark):
    old, new = "a\nb\n" * 50_000, "a\n" * 40_000 + "c\n" * 60_000
    r = lines.with_line_delta(spark.createDataFrame([(old, new), ("", "")], "o string, n string"), "o", "n").collect()
    assert (r[0].added, r[0].removed, r[0].total, r[0].real_added) == (60_000, 60_000, 160_000, True)
    assert (r[1].added, r[1].removed, r[1].total, r[1].real_added) == (0, 0, 0, False)
