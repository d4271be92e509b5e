"""Inputs of the registered queries: the given tables, and code corpora derived from ``part`` by plain SQL.

The same SQL text serves both engines; ``STRING_T`` is the only difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ``dep`` is the next part of the same repository.  It is found in two steps, within key ranges and then between the
# first rows of the ranges, so that a large repository is spread over many tasks.
_CORPUS = """
f AS (
  SELECT p_partkey AS k, p_type AS ty, p_brand AS br, p_partkey % 8 AS m,
         p_partkey - p_partkey % 4096 AS rng,
         'org' || CAST(p_partkey % 5 AS STRING_T) || '/' || replace(lower(p_brand), '#', '') AS repo_id,
         replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING_T) AS sym
  FROM part),
heads AS (
  SELECT repo_id, rng, lead(head) OVER (PARTITION BY repo_id ORDER BY rng) AS next_head
  FROM (SELECT repo_id, rng, min_by(sym, k) AS head FROM f GROUP BY repo_id, rng) h),
g AS (
  SELECT w.*, coalesce(w.near, heads.next_head) AS dep,
         'src/' || substr(lower(ty), 1, 4) || '/' || sym ||
         CASE m WHEN 0 THEN '.js' WHEN 1 THEN '.jsx' WHEN 2 THEN '.ts' WHEN 3 THEN '.tsx'
                WHEN 4 THEN '.py' WHEN 5 THEN '.go' WHEN 6 THEN '.cs' ELSE '.md' END AS path
  FROM (SELECT *, lead(sym) OVER (PARTITION BY repo_id, rng ORDER BY k) AS near FROM f) w
  JOIN heads ON w.repo_id = heads.repo_id AND w.rng = heads.rng)
"""

_BODY = """
CASE WHEN m = 4 THEN
    'import os' || chr(10)
    || coalesce('from ' || dep || ' import ' || dep || ' as d' || chr(10), '')
    || 'def ' || sym || '(a, b=1):' || chr(10)
    || '    ' || repeat(chr(34), 3) || ty || ' part' || repeat(chr(34), 3) || chr(10)
    || '    return a' || chr(10)
    || 'class C' || CAST(k AS STRING_T) || '(Base):' || chr(10) || '    pass' || chr(10)
  ELSE
    coalesce('import { ' || dep || CASE WHEN k % 11 = 0 THEN 'X' ELSE '' END
             || ' } from ' || chr(39) || './' || dep || chr(39) || chr(10), '')
    || '// ' || ty || ' ' || br || chr(10)
    || 'function ' || sym || '(a, b) {' || chr(10)
    || '  return helper(a[0])' || chr(10)
    || CASE WHEN k % 7 = 0 THEN '' ELSE '}' || chr(10) END
    || 'export const ' || CASE WHEN k % 13 = 0 THEN 'zz' ELSE sym END || ' = 1;' || chr(10)
  END
"""

# Declarations that the plain corpus lacks: classes with methods, interfaces, types, block comments, default exports.
_EXTENDED_BODY = """
CASE WHEN m = 4 THEN
    'import os, sys as s' || chr(10)
    || 'class C' || CAST(k AS STRING_T) || '(Base):' || chr(10)
    || '    ' || repeat(chr(34), 3) || ty || ' part' || chr(10) || '    of ' || br || ' ' || repeat(chr(34), 3) || chr(10)
    || 'def f' || CAST(k AS STRING_T) || '(a: int, b=1, *c):' || chr(10) || '    return a' || chr(10)
  WHEN m >= 5 THEN 'type T' || CAST(k AS STRING_T) || ' = 1' || chr(10)
    || 'var f' || CAST(k AS STRING_T) || ' = (a, b) => a' || chr(10)
  ELSE
    'import d' || CAST(k AS STRING_T) || ', { a as b, c } from ' || chr(39) || './lib' || chr(39) || ';' || chr(10)
    || 'import * as ns from ' || chr(39) || 'pkg/ns' || chr(39) || ';' || chr(10)
    || chr(10)
    || '/**' || chr(10) || ' * ' || ty || ' model' || chr(10) || ' */' || chr(10)
    || 'class K' || CAST(k AS STRING_T) || ' extends Base' || CAST(k % 5 AS STRING_T) || ' {' || chr(10)
    || '  constructor(a, b = 2) {' || chr(10) || '    this.a = a;' || chr(10) || '  }' || chr(10)
    || '  // loads' || chr(10)
    || '  static async load(url, ...rest) {' || chr(10) || '    if (url) {' || chr(10) || '      return url;' || chr(10)
    || '    }' || chr(10) || '  }' || chr(10)
    || '  wide(a,' || chr(10) || '    b = [1, 2]) {' || chr(10) || '    return typeof /x(/ + a / b;' || chr(10) || '  }' || chr(10) || '}' || chr(10)
    || CASE WHEN m IN (2, 3) THEN
         'interface I' || CAST(k AS STRING_T) || ' {' || chr(10) || '  a: string;' || chr(10) || '}' || chr(10)
         || 'type T' || CAST(k AS STRING_T) || ' = string;' || chr(10) ELSE '' END
    || 'async function go' || CAST(k AS STRING_T) || '(x, { y }, z = 1) {' || chr(10)
    || '  return x;' || chr(10) || '}' || chr(10)
    || 'let v' || CAST(k AS STRING_T) || ' = 1;' || chr(10)
    || 'let p' || CAST(k AS STRING_T) || ' = 1,' || chr(10) || '    q' || CAST(k AS STRING_T) || ' = call(1, [2, 3]),' || chr(10)
    || '    r' || CAST(k AS STRING_T) || ' = s => /[(]/.test(s);' || chr(10)
    || 'const t' || CAST(k AS STRING_T) || ' = `$' || '{[`(`].map(x => `$' || '{x}]`)} it' || chr(39) || 's`;' || chr(10)
    || CASE WHEN m = 2 THEN '' ELSE 'const el' || CAST(k AS STRING_T) || ' = <p className="x">it' || chr(39) || 's (fine {v}</p>;' || chr(10) END
    || 'function deep' || CAST(k AS STRING_T) || '(a = q(w(e(r(t(y(u(i(o(p(1)))))))))),' || chr(10) || '  b) {' || chr(10)
    || '  return a;' || chr(10) || '}' || chr(10)
    || 'export default ' || CASE WHEN k % 5 = 0 THEN '1' WHEN k % 5 = 1 THEN 'function h' || CAST(k AS STRING_T)
       || '() {}' ELSE 'K' || CAST(k AS STRING_T) END || ';' || chr(10)
  END
"""

# Texts with the defects that the repair rules target, and valid texts that must stay: regex literals after every kind of
# token, templates in templates, markup.
_VALID_BODY = """
    'export const f' || CAST(k AS STRING_T) || ' = s => /[(]/.test(s);' || chr(10)
    || 'const g = ys.filter(y => /' || chr(92) || '(/.test(y)), h = typeof /x(/;' || chr(10)
    || 'switch (h) {' || chr(10) || '  case /' || chr(92) || '{/.test(h): break;' || chr(10)
    || '  default: return /[)' || chr(92) || ']]/.test(h) / 2 / (g);' || chr(10) || '}' || chr(10)
    || 'const t = `a$' || '{[`(`].map(x => `{$' || '{x}`)}{`, u = g++ / 2;' || chr(10)
    || 'if (h) /}(/.exec(t);' || chr(10)
    || CASE WHEN m = 2 THEN 'const list: Array<Map<string, (a: string) => void>> = [];' || chr(10)
       ELSE 'const el = <p title="(">it' || chr(39) || 's ( here {g.map(x => <b key={x}>{x} )</b>)} <br/></p>;' || chr(10) END
"""
_BROKEN_BODY = rf"""
CASE WHEN k % 3 = 0 AND m < 4 THEN {_VALID_BODY} ELSE
    'import {{ a }} from ' || chr(39) || './a' || chr(39) || chr(10)
    || 'const n' || CAST(k AS STRING_T) || ' = a + 1' || chr(10)
    || 'const opts = {{' || chr(10) || '  size: ' || CAST(k AS STRING_T) || chr(10) || '  name: n,' || chr(10)
    || '}}' || chr(10)
    || CASE WHEN m IN (2, 3) THEN 'let later:' || chr(10) ELSE '' END
    || CASE WHEN m = 1 THEN 'const total = sum(n,' || chr(10) || '  2'
      WHEN m = 3 THEN 'const rows = [n,' || chr(10) || '  2,'
      ELSE 'export const api' || CAST(k AS STRING_T) || ' =' || chr(10)
        || 'async load(a) {{' || chr(10) || '  return a[0]' || chr(10) || '}}' || chr(10)
        || 'async save(b) {{' || chr(10) || '  return [b, 1,]' || chr(10) END
  END
"""

# Names in mixed case, several importers and clause forms for a name, names with ``$``, file names that occur inside of other
# module paths, many files called ``index``, exports that both naming rules judge, and some files over the size limit.
_CAMEL = "(upper(substr({0}, 1, 1)) || replace(substr({0}, 2), '_', ''))"
_IMPORTS_PATH = f"""'src/' || CAST(k AS STRING_T) || '/' || CASE k % 9 WHEN 0 THEN 'index' WHEN 1 THEN sym WHEN 2 THEN 'Go' ELSE {_CAMEL.format('sym')} END
  || CASE m WHEN 0 THEN '.js' WHEN 1 THEN '.jsx' WHEN 2 THEN '.ts' WHEN 3 THEN '.tsx' WHEN 4 THEN '.service.js' WHEN 5 THEN '.go' ELSE '.cs' END"""
_IMPORTS_BODY = f"""
CASE WHEN k % 97 = 0 THEN repeat('// more than a file may have' || chr(10), 4000) ELSE
    'import {{ ' || {_CAMEL.format("coalesce(dep, 'none')")} || CASE WHEN k % 11 = 0 THEN 'X' ELSE '' END || ' }} from '
    || chr(39) || './' || {_CAMEL.format("coalesce(dep, 'none')")} || chr(39) || chr(10)
    || CASE WHEN k % 2 = 0 THEN 'import {{ a as b, $' || {_CAMEL.format("coalesce(dep, 'none')")} || ' as c }} from ' || chr(34) || '../pkg/'
       || {_CAMEL.format("coalesce(dep, 'none')")} || '.js' || chr(34) || ';' || chr(10) ELSE '' END
    || CASE WHEN k % 4 = 1 THEN 'import {{ index }} from ' || chr(39) || './' || coalesce(dep, 'none') || '/index' || chr(39) || chr(10) ELSE '' END
    || CASE WHEN k % 3 = 0 THEN 'import * as ' || {_CAMEL.format("coalesce(dep, 'none')")} || ' from ' || chr(39) || 'lib/'
       || {_CAMEL.format("coalesce(dep, 'none')")} || 'Mock' || chr(39) || '; import Go from ' || chr(39) || 'Go' || chr(39) || chr(10) ELSE '' END
    || CASE WHEN k % 6 = 0 THEN 'export class tmp {{}}' || chr(10) ELSE '' END
    || 'export const ' || CASE WHEN k % 5 = 0 THEN 'zz' WHEN k % 7 = 0 THEN sym ELSE {_CAMEL.format('sym')} END || ' = 1;' || chr(10)
  END
"""


def corpus_sql(kind: str = "plain", string_type: str = "STRING") -> str:
    """The WITH list that ends in ``code_files(file_id, repo_id, path, content, size)``."""
    body = {"plain": _BODY, "extended": _EXTENDED_BODY, "broken": _BROKEN_BODY, "imports": _IMPORTS_BODY}[kind]
    path = _IMPORTS_PATH if kind == "imports" else "path"
    octets = "octet_length(content)" if string_type == "STRING" else "strlen(content)"
    text = f"""{_CORPUS},
bodies AS (SELECT k AS file_id, repo_id, {path} AS path, {body} AS content FROM g),
code_files AS (SELECT *, CAST({octets} AS BIGINT) AS size FROM bodies)"""
    return text.replace("STRING_T", string_type)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores."""
    return spread(table(spark, sf_dir, name))


def code_files(spark: SparkSession, sf_dir: str, kind: str = "plain") -> DataFrame:
    """The derived corpus."""
    body = corpus_sql(kind).replace("{", "{{").replace("}", "}}")
    part = spread(table(spark, sf_dir, "part"))
    return spark.sql(f"WITH part AS (SELECT * FROM {{given}}), {body} SELECT * FROM code_files", given=part)


def repo_urls(files: DataFrame) -> DataFrame:
    """One repository address per file, in four spellings; every fourth names another host."""
    form = F.col("file_id") % 4
    return files.select(
        "file_id",
        F.when(form == 0, F.concat(F.lit("https://github.com/"), "repo_id"))
        .when(form == 1, F.concat(F.lit(" https://github.com/"), "repo_id", F.lit(".git")))
        .when(form == 2, F.concat(F.lit("git@github.com:"), "repo_id", F.lit(".git")))
        .otherwise(F.concat(F.lit("https://example.org/"), "repo_id"))
        .alias("url"),
    )


def responses(files: DataFrame) -> DataFrame:
    """One review text per file: JSON inside prose, a no-issues answer, text without JSON, broken JSON."""
    form = F.col("file_id") % 4
    target = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("src/gone_"), F.col("file_id").cast("string"))).otherwise(
        F.col("path")
    )
    good = F.concat(
        F.lit('Here it is: {"summary": "Tidy up", "improvements": [{"file": "'),
        target,
        F.lit('", "description": "Rename", "reason": "Clarity", "changes": "x", "affectedSymbols": ["a", "b"]}]'),
        F.lit(', "priority": "high"} Done.'),
    )
    return files.select(
        "repo_id",
        "file_id",
        F.when(form == 0, good)
        .when(form == 1, F.lit('{"summary": "No issues found", "improvements": [{"file": "a"}], "priority": "low"}'))
        .when(form == 2, F.lit("nothing to report"))
        .otherwise(F.lit("{broken}"))
        .alias("raw"),
    )
