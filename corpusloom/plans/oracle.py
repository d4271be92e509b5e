"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written against the given tables and the derived corpora only; text is read by other means than in the operators (windows
and line tables instead of arrays, sparse joins instead of matrix products), so that both sides check each other.
"""

from __future__ import annotations

from corpusloom import fixed
from corpusloom.plans.inputs import _BODY, corpus_sql


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _skip(names: list[str], dots: bool) -> str:
    return "(^|/)(" + "|".join([n.replace(".", "[.]") for n in names] + (["[.][^/]*"] if dots else [])) + ")/"


_LANGUAGE = "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " ELSE 'unknown' END"

_NAMED = """named AS (
  SELECT *, regexp_extract(base, '^.+([.][^.]*)$', 1) AS ext
  FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM code_files))"""

_FILES = f"""{_NAMED},
files AS (
  SELECT *, {_LANGUAGE} AS language FROM named
  WHERE ext IN ({_list(fixed.CODE_EXTENSIONS)})
    AND NOT regexp_matches(path, '{_skip(fixed.CODE_SKIP_DIRS, True)}') AND size <= {fixed.MAX_FILE_BYTES})"""


def _n(char: str, text: str = "content") -> str:
    return f"(len({text}) - len(replace({text}, '{char}', '')))"


_FIELDS = {
    "params": "VARCHAR[]",
    "from_module": "VARCHAR",
    "is_async": "BOOLEAN",
    "is_static": "BOOLEAN",
    "class_name": "VARCHAR",
    "kind": "VARCHAR",
    "exported": "BOOLEAN",
    "is_default": "BOOLEAN",
    "documentation": "VARCHAR",
    "signature": "VARCHAR",
    "extends": "VARCHAR",
}


def _sym(type_: str, where: str, name: str, pos: str = "0", source: str = "lines", **fields: str) -> str:
    rest = ", ".join(f"CAST({fields.get(k, 'NULL')} AS {t}) AS {k}" for k, t in _FIELDS.items())
    return (
        f"SELECT repo_id, file, extractor, language, {name} AS name, '{type_}' AS type, CAST(no AS BIGINT) AS line, "
        f"CAST(no * 1000000 + {pos} AS BIGINT) AS ord, {rest} FROM {source} WHERE {where}"
    )


_FN = r"^(async\s+)?function\s*\*?\s*([\w$]+)\s*\((.*)\)\s*\{"
_METHOD = r"^  (static\s+)?(async\s+)?([\w$]+)\s*\((.*)\)\s*\{$"


def _bare(text: str) -> str:
    """Innermost round and square brackets go, again and again; the corpus nests them eleven deep."""
    return f"list_reduce([{text}] || list_transform(range(12), lambda i: ''), lambda s, i: regexp_replace(s, '[(\\[][^()\\[\\]]*[)\\]]', '', 'g'))"


_JS_PARAMS = (
    "list_transform(list_filter(string_split({0}, ','), lambda p: trim(p) <> ''), lambda p: CASE "
    "WHEN starts_with(trim(p), '{{') THEN 'param' "
    "WHEN starts_with(trim(p), '...') THEN '...' || regexp_extract(trim(p), '^[.]+([\\w$]+)', 1) "
    "ELSE regexp_extract(trim(p), '^([\\w$]+)', 1) END)"
)
_fn_params = _JS_PARAMS.format(_bare(f"regexp_extract(stmt, '{_FN}', 3)"))
_method_params = _JS_PARAMS.format(_bare(f"regexp_extract(stmt, '{_METHOD}', 4)"))
_py_params = (
    f"list_filter(list_transform(string_split(regexp_extract(t, '{fixed.PY_FUNCTION}', 2), ','), "
    "lambda p: trim(split_part(trim(p), '=', 1))), lambda p: p <> '')"
)
_generic_fn = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in fixed.GENERIC_FUNCTIONS) + ")"
_generic_cl = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in fixed.GENERIC_CLASSES) + ")"
_sig = (
    f"CASE WHEN regexp_extract(stmt, '{_FN}', 1) <> '' THEN 'async ' ELSE '' END || 'function ' || "
    f"regexp_extract(stmt, '{_FN}', 2) || '(' || array_to_string({_fn_params}, ', ') || ')'"
)
_js, _py, _ge = "extractor = 'js'", "extractor = 'python'", "extractor = 'generic'"
_q3 = "chr(34) || chr(34) || chr(34)"

_SYMBOLS_RAW = rf"""
routed AS (
  SELECT *, CASE WHEN ext = '.py' THEN 'python'
    WHEN ext IN ('.js', '.jsx', '.ts', '.tsx') AND {_n('{')} = {_n('}')} THEN 'js' ELSE 'generic' END AS extractor
  FROM files),
split AS (SELECT repo_id, path AS file, extractor, language, ext, string_split(content, chr(10)) AS l FROM routed),
numbered AS (SELECT *, unnest(range(1, len(l) + 1)) AS no FROM split),
texts AS (
  SELECT *, l[no] AS t, array_to_string(l[no:no - 1 + coalesce(nullif(list_position(
      list_transform(l[no:], lambda x: NOT regexp_matches(x, '[,(]$')), true), 0), 1)], ' ') AS stmt,
    list_reverse(list_transform(l[greatest(no - 9, 1):no - 1], lambda x: trim(x))) AS above,
    substr(trim(l[no + 1]), 4) || ' ' || array_to_string(list_transform(l[no + 2:no + 19],
      lambda x: CASE WHEN contains(x, {_q3}) THEN x ELSE trim(x) END), ' ') AS below,
    list_filter(l[1:no - 1], lambda x: regexp_matches(x, '^class '))[-1] AS owner_line
  FROM numbered),
stops AS (
  SELECT *, list_position(list_transform(above, lambda x: x <> '' AND NOT starts_with(x, '//')
    AND NOT starts_with(x, '*') AND NOT starts_with(x, '/*')), true) AS stop FROM texts),
docs AS (
  SELECT *, nullif(trim(array_to_string(list_transform(list_filter(list_reverse(
      CASE WHEN stop > 0 THEN above[1:stop - 1] ELSE above END), lambda x: x <> '' AND x <> '*/'),
      lambda x: regexp_replace(x, '^(//|[*]|/[*][*]?)\s*', '')), ' ')), '') AS js_doc,
    CASE WHEN starts_with(trim(l[no + 1]), {_q3}) THEN trim(split_part(below, {_q3}, 1)) END AS py_doc
  FROM stops),
lines AS (
  SELECT *,
    list_filter(list_transform(string_split({_bare("regexp_replace(stmt, '^(var|let|const)', '')")}, ','),
      lambda p: regexp_extract(p, '^\s*([\w$]+)', 1)), lambda x: x <> '') AS var_names,
    list_filter(list_transform(string_split(regexp_replace(regexp_extract(t, '^import\s+(.*?)\s*\bfrom\s*[''"]', 1),
      '[{{}}]', ',', 'g'), ','), lambda p: regexp_extract(p, '([\w$]+)\s*$', 1)), lambda x: x <> '') AS js_names,
    list_transform(string_split(regexp_extract(t, '{fixed.PY_IMPORT}', 2), ','),
      lambda p: split_part(trim(p), ' as ', 1)) AS py_names
  FROM docs),
js_imports AS (SELECT *, unnest(range(1, len(js_names) + 1)) AS i FROM lines
  WHERE {_js} AND regexp_matches(t, '^import\b')),
py_imports AS (SELECT *, unnest(range(1, len(py_names) + 1)) AS i FROM lines
  WHERE {_py} AND regexp_matches(t, '{fixed.PY_IMPORT}')),
variables AS (SELECT *, unnest(range(1, len(var_names) + 1)) AS i FROM lines
  WHERE {_js} AND regexp_matches(t, '^(var|let|const)\s')),
raw AS (
""" + "\nUNION ALL ".join(
    [
        _sym("import", "true", "js_names[i]", "i - 1", "js_imports", documentation="js_doc",
             from_module=r"regexp_extract(t, '\bfrom\s*[''\"]([^''\"]*)[''\"]', 1)"),
        _sym("import", "true", "py_names[i]", "i - 1", "py_imports",
             from_module=f"nullif(regexp_extract(t, '{fixed.PY_IMPORT}', 1), '')"),
        _sym("function", f"{_js} AND regexp_matches(stmt, '{_FN}')", f"regexp_extract(stmt, '{_FN}', 2)", params=_fn_params,
             is_async=f"regexp_extract(stmt, '{_FN}', 1) <> ''", documentation="js_doc", signature=_sig),
        _sym("class", rf"{_js} AND regexp_matches(t, '^class\s')", r"regexp_extract(t, '^class\s+([\w$]+)', 1)",
             documentation="js_doc", extends=r"nullif(regexp_extract(t, '\sextends\s+([\w$.]+)', 1), '')"),
        _sym("method", f"{_js} AND regexp_matches(stmt, '{_METHOD}')",
             rf"regexp_extract(owner_line, '^class\s+([\w$]+)', 1) || '.' || regexp_extract(stmt, '{_METHOD}', 3)",
             params=_method_params, is_async=f"regexp_extract(stmt, '{_METHOD}', 2) <> ''",
             is_static=f"regexp_extract(stmt, '{_METHOD}', 1) <> ''", documentation="js_doc",
             class_name=r"regexp_extract(owner_line, '^class\s+([\w$]+)', 1)"),
        _sym("interface", rf"{_js} AND regexp_matches(t, '^interface\s')", r"regexp_extract(t, '^interface\s+([\w$]+)', 1)",
             documentation="js_doc"),
        _sym("type", rf"{_js} AND regexp_matches(t, '^type\s')", r"regexp_extract(t, '^type\s+([\w$]+)', 1)",
             documentation="js_doc"),
        _sym("variable", "true", "var_names[i]", "i - 1", "variables", kind=r"regexp_extract(t, '^(\w+)', 1)", exported="false"),
        _sym("export", rf"{_js} AND regexp_matches(t, '^export\s+default\s')",
             r"coalesce(nullif(regexp_extract(t, '^export\s+default\s+function\s+(\w+)', 1), ''), "
             r"nullif(regexp_extract(t, '^export\s+default\s+([A-Za-z]\w*);$', 1), ''), 'default')", is_default="true"),
        _sym("export", rf"{_js} AND regexp_matches(t, '^export\s+const\s')", r"regexp_extract(t, '^export\s+const\s+(\w+)', 1)",
             exported="true"),
        _sym("function", f"{_py} AND regexp_matches(t, '{fixed.PY_FUNCTION}')", f"regexp_extract(t, '{fixed.PY_FUNCTION}', 1)",
             params=_py_params, documentation="py_doc"),
        _sym("class", f"{_py} AND regexp_matches(t, '{fixed.PY_CLASS}')", f"regexp_extract(t, '{fixed.PY_CLASS}', 1)",
             documentation="py_doc", extends=r"nullif(regexp_extract(t, '^class\s+\w+\(\s*([\w.]+)', 1), '')"),
        _sym("function", f"{_ge} AND {_generic_fn} IS NOT NULL", _generic_fn),
        _sym("class", f"{_ge} AND {_generic_cl} IS NOT NULL", _generic_cl,
             pos=f"CASE WHEN {_generic_fn} IS NULL THEN 0 ELSE 1 END"),
    ]
) + ")"

_SYMBOLS = """symbols AS (
  SELECT repo_id, file || '::' || name AS symbol_id, file, name, min(ord) AS ord, arg_max(type, ord) AS type,
    arg_max(line, ord) AS line, arg_max(struct_pack(params, class_name, documentation, signature), ord) AS z
  FROM raw GROUP BY repo_id, file, name)"""

_EDGES = """edges AS (
  SELECT repo_id, file || '::' || name AS src, coalesce(from_module, 'null') || '::' || name AS dst, 'imports' AS type,
    file AS src_file, name, from_module AS module, ord FROM raw WHERE type = 'import'
  UNION ALL
  SELECT repo_id, file || '::' || name, file || '::' || extends, 'extends', file, extends, NULL, ord
  FROM raw WHERE type = 'class' AND extends IS NOT NULL)"""

_META = """meta AS (
  SELECT f.repo_id, f.path, f.language, CAST(len(f.content) AS BIGINT) AS size, f.base,
    count(r.name) AS symbol_count,
    coalesce(array_agg(r.name ORDER BY r.ord) FILTER (r.type = 'import'), []) AS imports,
    coalesce(array_agg(r.name ORDER BY r.ord) FILTER (r.type = 'export'), []) AS exports
  FROM files f LEFT JOIN raw r ON r.repo_id = f.repo_id AND r.file = f.path
  GROUP BY f.repo_id, f.path, f.language, f.content, f.base)"""

_FOLDER = r"regexp_extract('/' || {0}, '([^/]*)/[^/]*$', 1)"
_ENTRIES = rf"""held AS (
  SELECT repo_id, file, array_agg(name ORDER BY ord) AS names FROM symbols GROUP BY repo_id, file),
entries AS (
  SELECT repo_id, 0 AS entry_kind, file, ord, symbol_id AS id, name AS symbol_name, type AS symbol_type, line,
    type || ' ' || name || coalesce(' ' || z.signature, '')
      || CASE WHEN len(z.params) > 0 THEN ' parameters: ' || array_to_string(z.params, ', ') ELSE '' END
      || coalesce(' ' || nullif(z.documentation, ''), '')
      || ' in ' || {_FOLDER.format('file')} || '/' || regexp_extract(file, '([^/]*)$', 1)
      || coalesce(' method of class ' || z.class_name, '') AS text,
    nullif(z.documentation, '') AS documentation, z.signature AS signature, NULL AS language
  FROM symbols
  UNION ALL
  SELECT m.repo_id, 1, m.path, 0, 'file::' || m.path, m.base, 'file', 0,
    m.path || ' ' || m.language || ' file'
      || CASE WHEN len(m.imports) > 0 THEN ' imports: ' || array_to_string(m.imports[1:10], ', ') ELSE '' END
      || CASE WHEN len(m.exports) > 0 THEN ' exports: ' || array_to_string(m.exports[1:10], ', ') ELSE '' END
      || CASE WHEN len(h.names) > 0 THEN ' contains: ' || array_to_string(h.names[1:10], ', ') ELSE '' END,
    NULL, NULL, m.language
  FROM meta m LEFT JOIN held h ON h.repo_id = m.repo_id AND h.file = m.path)"""


def _vectors(name: str, source: str, keys: str, text: str = "text") -> str:
    return f"""{name}_cnt AS (
  SELECT {keys}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {fixed.VECTOR_DIM} AS BIGINT) AS dim, count(*) AS c
  FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT {keys}, dim, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS FLOAT) AS DOUBLE) AS w FROM {name}_cnt)"""


_VEC = _vectors("vec", "entries", "repo_id, id")


def _search(queries: str, k: int, scoped: bool = False) -> str:
    """Hits of ``queries`` (a CTE body with query_id, qt and, when scoped, scope) over all entries."""
    scope = ", scope" if scoped else ""
    match = "AND nq.scope = e.repo_id" if scoped else ""
    return f"""q AS ({queries}),
{_vectors('qvec', 'q', 'query_id' + scope, 'qt')},
nq AS (SELECT query_id{scope}, sqrt(sum(w * w)) AS n FROM qvec GROUP BY ALL),
ne AS (SELECT repo_id, id, sqrt(sum(w * w)) AS n FROM vec GROUP BY ALL),
dots AS (
  SELECT query_id, repo_id, id, sum(qvec.w * vec.w) AS dot FROM vec JOIN qvec ON qvec.dim = vec.dim
  {'AND qvec.scope = vec.repo_id' if scoped else ''} GROUP BY ALL),
scored AS (
  SELECT nq.query_id, e.*, coalesce(round(d.dot / (nq.n * ne.n), 9), 0) AS similarity
  FROM entries e JOIN nq ON true {match}
  LEFT JOIN dots d ON d.query_id = nq.query_id AND d.repo_id = e.repo_id AND d.id = e.id
  LEFT JOIN ne ON ne.repo_id = e.repo_id AND ne.id = e.id),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id, repo_id ORDER BY similarity DESC, entry_kind, file, ord) AS rank FROM scored)
  WHERE rank <= {k})"""


def _context(max_files: int) -> str:
    return f"""grouped AS (
  SELECT query_id, repo_id, file, count(*) AS hits, min(rank) AS best FROM hits GROUP BY ALL),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY hits DESC, best) AS file_rank
    FROM grouped) WHERE file_rank <= {max_files}),
kept AS (
  SELECT h.*, r.file_rank, row_number() OVER (PARTITION BY h.query_id, h.repo_id ORDER BY r.file_rank, h.rank) - 1
    AS symbol_ord, row_number() OVER (PARTITION BY h.query_id, h.repo_id, h.file ORDER BY h.rank) AS file_hit
  FROM hits h JOIN ranked r ON r.query_id = h.query_id AND r.repo_id = h.repo_id AND r.file = h.file),
deps AS (
  SELECT r.query_id, r.repo_id, r.file_rank, e.src_file, e.dst, e.name, e.ord
  FROM ranked r JOIN edges e ON e.repo_id = r.repo_id AND e.src_file = r.file WHERE e.type = 'imports'),
calls AS (
  SELECT * FROM (
    SELECT k.query_id, k.repo_id, k.symbol_ord, e.src AS caller, e.dst AS callee, k.symbol_name AS name,
      row_number() OVER (PARTITION BY k.query_id, k.repo_id, k.symbol_ord ORDER BY e.src_file, e.ord) AS ref_rank
    FROM kept k JOIN edges e ON e.repo_id = k.repo_id
      AND (contains(e.dst, k.symbol_name) OR contains(e.src, k.symbol_name))
    WHERE k.symbol_type IN ('function', 'method')) WHERE ref_rank <= 5),
body AS (
  SELECT repo_id, path AS file, unnest(string_split(content, chr(10))) AS line_text,
    generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files),
owned AS (
  SELECT k.query_id, k.repo_id, k.file, b.line_no, b.line_text, min(k.file_hit) AS file_hit
  FROM kept k JOIN body b ON b.repo_id = k.repo_id AND b.file = k.file AND abs(b.line_no - k.line) <= 5
  WHERE k.file_hit <= 5 AND k.line > 0 GROUP BY ALL),
snips AS (
  SELECT query_id, repo_id, file, file_hit,
    string_agg(line_no || ': ' || line_text || chr(10), '' ORDER BY line_no) AS code FROM owned GROUP BY ALL)"""


def _with(*ctes: str, kind: str = "plain") -> str:
    return "WITH " + ",\n".join([corpus_sql(kind, "VARCHAR"), *ctes]) + "\n"


_F = _with(_FILES)
_R = _with(_FILES, _SYMBOLS_RAW)
_X = _with(_FILES, _SYMBOLS_RAW, kind="extended")
_S = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS)
_SX = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS, kind="extended")
_E = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS, _META, _ENTRIES)
_ALL = [_FILES, _SYMBOLS_RAW, _SYMBOLS, _META, _ENTRIES, _VEC, _EDGES]
_one_query = lambda i, t: f"SELECT '{i}' AS query_id, '{t}' AS qt"
_many = lambda names: " UNION ALL ".join(_one_query(n, fixed.PATTERN_QUERIES[n]) for n in names)
_REVIEW = _with(*_ALL, _search(_one_query("review", fixed.REVIEW_QUERY), 50), _context(10))

ORACLES: dict[str, str] = {}
O = ORACLES

# -- scans, sources, sinks
O["scan_code_files"] = _with(_FILES, kind="imports") + "SELECT repo_id, path, size, md5(content) AS body FROM files"
O["rejected_files"] = _with(_NAMED, kind="imports") + f"""SELECT repo_id, path, size, 'too_large' AS problem FROM named
WHERE ext IN ({_list(fixed.CODE_EXTENSIONS)}) AND NOT regexp_matches(path, '{_skip(fixed.CODE_SKIP_DIRS, True)}') AND size > {fixed.MAX_FILE_BYTES}"""
O["scan_context_files"] = _with(_NAMED) + f"""
, flags AS (SELECT *, ext IN ({_list(fixed.CODE_EXTENSIONS)}) AND size <= {fixed.MAX_FILE_BYTES}
    AND NOT regexp_matches(path, '{_skip(fixed.CODE_SKIP_DIRS, True)}') AS c,
  ext IN ({_list(fixed.CONTEXT_EXTENSIONS)}) AND NOT regexp_matches(path, '{_skip(fixed.CONTEXT_SKIP_DIRS, False)}') AS x
  FROM named),
counted AS (SELECT *, count_if(c) OVER (PARTITION BY repo_id) AS nc, count_if(x) OVER (PARTITION BY repo_id) AS nx FROM flags)
SELECT repo_id, path FROM counted WHERE CASE WHEN nx > nc THEN x ELSE c END"""
O["scan_subpath"] = _F + """
, below AS (SELECT repo_id, count_if(starts_with(path, 'src/econ/')) AS n FROM code_files GROUP BY 1),
code AS (SELECT repo_id, count(*) AS n FROM files WHERE starts_with(path, 'src/econ/') GROUP BY 1)
SELECT repo_id, substr(path, 10) AS path, 'ok' AS status FROM files WHERE starts_with(path, 'src/econ/')
UNION ALL
SELECT b.repo_id, NULL, CASE WHEN b.n = 0 THEN 'path_not_found' ELSE 'no_files_found' END
FROM below b LEFT JOIN code c ON c.repo_id = b.repo_id WHERE c.n IS NULL"""
O["read_bodies"] = _F + """SELECT c.repo_id, c.path, md5(f.content) AS body
FROM code_files c LEFT JOIN files f ON f.repo_id = c.repo_id AND f.path = c.path"""
O["write_graph"] = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS, _EDGES) + """
SELECT 'symbols' AS table_name, repo_id, count(*) AS n FROM symbols GROUP BY ALL
UNION ALL SELECT 'files', repo_id, count(*) FROM files GROUP BY ALL
UNION ALL SELECT 'edges', repo_id, count(*) FROM edges GROUP BY ALL"""
O["index_save"] = _E + f"""SELECT repo_id, id, symbol_type, line, text, CAST({fixed.VECTOR_DIM} AS BIGINT) AS dim,
  CAST(1.0 AS DOUBLE) AS norm FROM entries"""
O["index_load"] = _E + "SELECT repo_id, count(*) AS n FROM entries WHERE starts_with(repo_id, 'org0/') GROUP BY 1"
O["index_exists"] = _F + """, repos AS (SELECT DISTINCT repo_id FROM code_files), asked AS (
  SELECT repo_id FROM repos UNION ALL SELECT repo_id || '-none' FROM repos)
SELECT repo_id, repo_id IN (SELECT repo_id FROM files) AS held FROM asked"""
O["index_delete"] = _E + "SELECT repo_id, count(*) AS n FROM entries WHERE NOT starts_with(repo_id, 'org1/') GROUP BY 1"
_last = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"
O["memory_append"] = f"SELECT conv_id, turn, role, md5(text) AS body FROM conversations QUALIFY {_last} <= 5"
O["memory_append_stream"] = O["memory_append"]
O["memory_recent"] = f"SELECT conv_id, turn, {_last} AS rank, md5(text) AS body FROM conversations QUALIFY {_last} <= 3"
O["memory_clear"] = """SELECT conv_id, turn, md5(text) AS body FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"""
O["memory_all"] = "SELECT conv_id, turn, role, md5(text) AS body FROM conversations"
_CHANGES = """changes AS (
  SELECT repo_id, file_id * 3 AS ord, path AS file, content || '// one' || chr(10) AS content, 'first' AS description FROM files
  UNION ALL SELECT repo_id, file_id * 3 + 1, path, content || '// two' || chr(10), 'second' FROM files WHERE file_id % 3 = 0
  UNION ALL SELECT repo_id, file_id * 3 + 2, path || '.new', 'new' || chr(10), 'created' FROM files WHERE file_id % 5 = 0)"""
O["apply_changes"] = _with(_FILES, _CHANGES) + """
SELECT coalesce(f.repo_id, c.repo_id) AS repo_id, coalesce(f.path, c.file) AS path,
  md5(coalesce(c.content, f.content)) AS body, c.content IS NOT NULL AS modified
FROM files f FULL OUTER JOIN (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY repo_id, file ORDER BY ord DESC) = 1) c
  ON c.repo_id = f.repo_id AND c.file = f.path"""

# -- projections, filters, predicates
O["detect_language"] = _with(_NAMED) + f"SELECT repo_id, path, {_LANGUAGE} AS language FROM named"
O["symbol_id"] = _R + "SELECT repo_id, file || '::' || name AS id, line FROM raw"
O["find_symbols_by_name"] = _S + "SELECT repo_id, symbol_id, type, line FROM symbols WHERE contains(lower(name), 'widget')"
_ED = _with(_FILES, _SYMBOLS_RAW, _EDGES)
O["find_references"] = _ED + """SELECT repo_id, src, dst, type FROM edges
WHERE contains(src, 'hot_gear') OR contains(dst, 'hot_gear')"""
_listed = lambda t: f"coalesce(string_agg(name, ', ' ORDER BY ord) FILTER (type = '{t}'), '')"
O["symbol_hierarchy"] = _S + f"""SELECT repo_id, file, {_listed('class')} AS classes, {_listed('function')} AS functions,
  {_listed('import')} AS imports, {_listed('export')} AS exports FROM symbols GROUP BY repo_id, file"""
O["symbols_by_type"] = _E + """SELECT repo_id, id, row_number() OVER w AS rank FROM entries WHERE symbol_type = 'function'
WINDOW w AS (PARTITION BY repo_id ORDER BY entry_kind, file, ord) QUALIFY row_number() OVER w <= 50"""
O["symbols_in_file"] = _E + """SELECT repo_id, file, id, row_number() OVER w AS rank FROM entries
WINDOW w AS (PARTITION BY repo_id, file ORDER BY entry_kind, ord) QUALIFY row_number() OVER w <= 50"""
O["drop_vector"] = "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings"
O["sanitize_repo_id"] = _with() + """SELECT repo_id, count(*) AS n, regexp_replace(repo_id, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_id
FROM code_files GROUP BY repo_id"""
_URLS = """urls AS (SELECT file_id % 4 AS f, repo_id, split_part(repo_id, '/', 1) AS o, split_part(repo_id, '/', 2) AS r FROM code_files)"""
O["repo_url_parse"] = _with(_URLS) + """SELECT CASE WHEN f = 3 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN f < 3 THEN o END AS owner, CASE WHEN f < 3 THEN r END AS repo, count(*) AS n FROM urls GROUP BY ALL"""
O["repo_url_parse_api"] = _with(_URLS) + """SELECT CASE WHEN f >= 2 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN f < 2 THEN o END AS owner, CASE WHEN f < 2 THEN r END AS repo, count(*) AS n FROM urls GROUP BY ALL"""
O["estimate_tokens"] = """SELECT source, lang, count(*) AS n,
  CAST(sum(ceil((len(text) + len(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4)) AS BIGINT) AS tokens
FROM documents GROUP BY source, lang"""
_TARGET = "CASE WHEN file_id % 3 = 0 THEN 'src/gone_' || file_id ELSE path END"
O["no_change_predicate"] = _F + f"""SELECT file_id, file_id % 4 <> 0 AS no_change,
  CASE WHEN file_id % 4 = 0 THEN 'Tidy up' ELSE '{fixed.CLEAN_SUMMARY}' END AS summary,
  CAST(CASE WHEN file_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_improvements,
  CASE WHEN file_id % 4 = 0 THEN 'high' ELSE 'low' END AS priority FROM files"""
O["parse_review_json"] = _F + f"""SELECT file_id,
  CASE file_id % 4 WHEN 0 THEN 'Tidy up' WHEN 1 THEN 'No issues found' WHEN 2 THEN '{fixed.NO_JSON_SUMMARY}'
    ELSE '{fixed.BAD_JSON_SUMMARY}' END AS summary,
  CASE file_id % 4 WHEN 0 THEN 'high' ELSE 'low' END AS priority,
  CASE file_id % 4 WHEN 2 THEN 'no_json' WHEN 3 THEN 'bad_json' ELSE 'parsed' END AS outcome,
  CAST(CASE WHEN file_id % 4 < 2 THEN 1 ELSE 0 END AS BIGINT) AS n_improvements,
  CASE file_id % 4 WHEN 0 THEN {_TARGET} WHEN 1 THEN 'a' END AS first_file,
  CASE file_id % 4 WHEN 0 THEN 'a,b' END AS affected FROM files"""
O["run_status"] = _F + f""", fixes AS (
  SELECT repo_id, count(*) AS n FROM files WHERE ext IN ('.js', '.jsx', '.ts', '.tsx') AND file_id % 3 <> 0 GROUP BY 1),
latest AS (SELECT repo_id, max(file_id) AS k, arg_max(path, file_id) AS path FROM files GROUP BY 1),
counts AS (
  SELECT r.repo_id, coalesce(f.n, 0) AS n_files, coalesce(x.n, 0) AS n_fixes,
    CAST(CASE WHEN l.k % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_improvements,
    CAST(CASE WHEN l.k % 4 = 0 AND l.k % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_changes
  FROM (SELECT DISTINCT repo_id FROM code_files) r
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM files GROUP BY 1) f ON f.repo_id = r.repo_id
  LEFT JOIN fixes x ON x.repo_id = r.repo_id LEFT JOIN latest l ON l.repo_id = r.repo_id)
SELECT *, CASE WHEN n_files = 0 THEN 'no_files_found' WHEN n_improvements = 0 AND n_fixes > 0 THEN 'syntax_fixes_only'
  WHEN n_improvements = 0 THEN 'no_improvements' WHEN n_changes = 0 THEN 'no_changes' ELSE 'success' END AS status FROM counts"""

# -- extraction
O["explode_lines"] = """SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
O["dispatch_extractors"] = _X + "SELECT repo_id, extractor, type, count(*) AS n FROM raw GROUP BY ALL"


def _extracted(kind: str, where: str, *columns: str) -> str:
    text = {"params": "array_to_string(params, ', ') AS params"}
    rest = "".join(", " + text.get(c, c) for c in columns)
    return (_R if kind == "plain" else _X) + f"SELECT repo_id, file, name, line{rest} FROM raw WHERE {where}"


O["py_imports"] = _extracted("plain", f"{_py} AND type = 'import'", "from_module")
O["py_functions"] = _extracted("extended", f"{_py} AND type = 'function'", "params")
O["py_classes"] = _extracted("plain", f"{_py} AND type = 'class'")
O["py_docstring"] = _extracted("extended", f"{_py} AND documentation IS NOT NULL", "documentation")
O["generic_functions"] = _extracted("plain", f"{_ge} AND type = 'function'")
O["generic_classes"] = _extracted("extended", f"{_ge} AND type = 'class'")
O["generic_fallback"] = _extracted("plain", f"{_ge} AND language IN ('javascript', 'typescript')", "type")
O["js_imports"] = _extracted("extended", f"{_js} AND type = 'import'", "from_module", "ord")
O["js_functions"] = _extracted("extended", f"{_js} AND type = 'function'", "params", "is_async", "signature")
O["js_classes"] = _extracted("extended", f"{_js} AND type = 'class'", "documentation")
O["js_methods"] = _extracted("extended", "type = 'method'", "params", "is_async", "is_static", "class_name", "documentation")
O["js_variables"] = _extracted("extended", "type = 'variable'", "kind", "exported")
O["js_named_exports"] = _extracted("plain", f"{_js} AND type = 'export'", "exported")
O["js_default_exports"] = _extracted("extended", "type = 'export'", "is_default")
O["ts_interfaces"] = _extracted("extended", "type = 'interface'", "documentation")
O["ts_types"] = _extracted("extended", "type = 'type'", "documentation")
O["js_docstring"] = _extracted("plain", f"{_js} AND documentation IS NOT NULL", "documentation")
O["param_names"] = _extracted("extended", "params IS NOT NULL", "params")
O["signature"] = _extracted("plain", "signature IS NOT NULL", "signature")
O["export_scan"] = _F + f"""SELECT repo_id, path, regexp_extract(t, '{fixed.EXPORT_ANYWHERE}', 1) AS name, CAST(no AS BIGINT) AS line,
  row_number() OVER (PARTITION BY repo_id, path ORDER BY no) - 1 AS ord
FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS t,
  generate_subscripts(string_split(content, chr(10)), 1) AS no FROM files) WHERE regexp_matches(t, '{fixed.EXPORT_ANYWHERE}')"""

# -- joins
O["import_edges"] = _ED + "SELECT repo_id, src, dst, module, ord FROM edges WHERE type = 'imports'"
O["extends_edges"] = _with(_FILES, _SYMBOLS_RAW, _EDGES, kind="extended") + "SELECT repo_id, src, dst, type FROM edges WHERE type = 'extends'"
_ATT = f"""clauses AS (
  SELECT repo_id, path AS importer, pos, regexp_extract(s, '{{fixed.IMPORT_CLAUSE_SQL}}', 4) AS module,
    list_transform(string_split(coalesce(nullif(regexp_extract(s, '{{fixed.IMPORT_CLAUSE_SQL}}', 1), ''),
      nullif(regexp_extract(s, '{{fixed.IMPORT_CLAUSE_SQL}}', 2), ''), regexp_extract(s, '{{fixed.IMPORT_CLAUSE_SQL}}', 3)), ','),
      lambda n: trim(split_part(trim(n), ' as ', 1))) AS names
  FROM (SELECT repo_id, path, unnest(l) AS s, generate_subscripts(l, 1) AS pos
    FROM (SELECT *, regexp_extract_all(content, '{{fixed.IMPORT_CLAUSE_SQL}}') AS l FROM files))),
attempts AS (
  SELECT f.repo_id, f.path, c.importer, c.pos, c.module, c.names, regexp_replace(f.base, '^(.+)[.][^.]*$', '\\1') AS stem
  FROM files f JOIN clauses c ON c.repo_id = f.repo_id AND c.importer <> f.path
    AND contains(c.module, regexp_replace(f.base, '^(.+)[.][^.]*$', '\\1')))""".replace("{fixed.IMPORT_CLAUSE_SQL}", fixed.IMPORT_CLAUSE.replace("'", "''"))
_sim = lambda a, b: (
    f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE ELSE "
    f"1 - levenshtein(lower({a}), lower({b})) / greatest(len({a}), len({b})) END)"
)
_TYPOS = f"""exported AS (
  SELECT repo_id, path, regexp_extract(t, '{fixed.EXPORT_ANYWHERE}', 1) AS name, CAST(no AS BIGINT) AS line
  FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS t,
    generate_subscripts(string_split(content, chr(10)), 1) AS no FROM files) WHERE regexp_matches(t, '{fixed.EXPORT_ANYWHERE}')),
named_uses AS (SELECT *, unnest(names) AS imported, generate_subscripts(names, 1) AS name_pos FROM attempts),
close_uses AS (
  SELECT e.line, e.name, a.* FROM exported e JOIN named_uses a ON a.repo_id = e.repo_id AND a.path = e.path
  WHERE {_sim('a.imported', 'a.stem')} > {fixed.HIGH_SIMILARITY}),
cand AS (
  SELECT repo_id, path, line, name AS original, imported AS suggested, 'high' AS confidence, importer AS imported_in,
    'Export name "' || name || '" doesn''t match import "' || imported || '" which is closer to file name "' || stem || '"' AS reason,
    pos, name_pos
  FROM close_uses WHERE {_sim('name', 'imported')} < {fixed.LOW_SIMILARITY}
  UNION ALL
  SELECT repo_id, path, line, name, stem, 'medium', importer,
    'Export name "' || name || '" appears to be a typo. File name is "' || stem || '" and imported as "' || imported || '"', pos, name_pos
  FROM close_uses WHERE len(name) <= {fixed.SHORT_NAME} AND name = lower(name) AND len(stem) > {fixed.SHORT_NAME} AND stem <> lower(stem)),
typos AS (SELECT * FROM cand QUALIFY row_number() OVER (
  PARTITION BY repo_id, path, original || suggested ORDER BY confidence, line, imported_in, pos, name_pos) = 1)"""
_RENAME_ORDER = "ORDER BY line DESC, imported_in, pos, name_pos"
O["import_attempts"] = _with(_FILES, _ATT, kind="imports") + "SELECT repo_id, path, importer, module, array_to_string(names, ', ') AS names FROM attempts"
O["typo_candidates"] = _with(_FILES, _ATT, _TYPOS, kind="imports") + "SELECT * EXCLUDE (pos, name_pos) FROM cand"
O["typo_dedup"] = _with(_FILES, _ATT, _TYPOS, kind="imports") + "SELECT repo_id, path, line, original, suggested, confidence, imported_in FROM typos"
O["sort_typos_desc"] = _with(_FILES, _ATT, _TYPOS, kind="imports") + f"""SELECT repo_id, path,
  row_number() OVER (PARTITION BY repo_id, path {_RENAME_ORDER}) - 1 AS n, line, original, suggested FROM typos WHERE confidence = 'high'"""
_RENAMED = rf"""renames AS (
  SELECT repo_id, path, list(original || '>' || suggested {_RENAME_ORDER}) AS l FROM typos WHERE confidence = 'high' GROUP BY ALL),
renamed AS (
  SELECT f.*, t.l AS renames, coalesce(CASE WHEN t.l IS NOT NULL THEN list_reduce([f.content] || t.l, lambda c, r: regexp_replace(c,
      '(export\s+(?:const|let|var|class|function|interface|type)\s+)' || split_part(r, '>', 1) || '\b', '\1' || split_part(r, '>', 2), 'g')) END,
      f.content) AS new_content
  FROM files f LEFT JOIN renames t ON t.repo_id = f.repo_id AND t.path = f.path),
marked AS (SELECT *, new_content <> content AS fixed, CASE WHEN new_content <> content THEN len(renames) ELSE 0 END AS n_renames FROM renamed)"""
O["apply_typo_fixes"] = _with(_FILES, _ATT, _TYPOS, _RENAMED, kind="imports") + "SELECT file_id, new_content AS content, fixed FROM marked"
O["semantic_fix"] = _with(_FILES, _ATT, _TYPOS, _RENAMED, kind="imports") + """SELECT repo_id, count(*) FILTER (fixed) AS n_fixed,
  CAST(sum(n_renames) AS BIGINT) AS n_renames FROM marked GROUP BY repo_id"""
O["build_symbol_graph"] = _with(
    _FILES, _ATT, _TYPOS, _RENAMED,
    _SYMBOLS_RAW.replace("FROM files)", "FROM (SELECT * REPLACE (new_content AS content) FROM renamed))", 1), _EDGES,
) + """, n AS (SELECT repo_id, count(*) AS total_files FROM files GROUP BY 1),
sy AS (SELECT repo_id, count(DISTINCT (file, name)) AS total_symbols FROM raw GROUP BY 1),
ed AS (SELECT repo_id, count(*) AS n_edges FROM edges GROUP BY 1),
ty AS (SELECT repo_id, count(*) AS n_typos FROM typos GROUP BY 1),
fx AS (SELECT repo_id, count(*) AS n_fixes FROM marked WHERE fixed GROUP BY 1)
SELECT n.repo_id, coalesce(total_symbols, 0) AS total_symbols, total_files, n_edges, n_typos, n_fixes
FROM n LEFT JOIN sy ON sy.repo_id = n.repo_id LEFT JOIN ed ON ed.repo_id = n.repo_id
LEFT JOIN ty ON ty.repo_id = n.repo_id LEFT JOIN fx ON fx.repo_id = n.repo_id"""
O["attach_fixes"] = _with(_FILES, _ATT, _TYPOS, _RENAMED) + """SELECT repo_id, path,
  n_renames AS n_semantic,
  CAST(CASE WHEN m > 3 OR file_id % 3 = 0 THEN 0 ELSE CASE m WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 5 END END AS BIGINT) AS n_syntax
FROM (SELECT *, file_id % 8 AS m FROM marked) WHERE fixed OR (m < 4 AND file_id % 3 <> 0)"""
O["dependency_graph"] = _ED + "SELECT repo_id, src_file AS path, dst, name AS symbol FROM edges WHERE type = 'imports'"
O["call_graph"] = _REVIEW + "SELECT query_id, repo_id, symbol_ord, caller, callee, name FROM calls"
O["file_context"] = _REVIEW + """SELECT r.repo_id, r.file AS path, r.file_rank, r.hits, m.language,
  array_to_string(m.imports, ', ') AS imports, array_to_string(m.exports, ', ') AS exports,
  (SELECT count(*) FROM snips s WHERE s.repo_id = r.repo_id AND s.file = r.file) AS n_snippets
FROM ranked r JOIN meta m ON m.repo_id = r.repo_id AND m.path = r.file"""
_dims = ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65))
_CENTROID = f"""cent AS (SELECT CAST(label AS VARCHAR) AS query_id, list_value({_dims}) AS v FROM embeddings GROUP BY label)"""


def _top_vectors(k: int) -> str:
    return f"""WITH {_CENTROID},
hits AS (
  SELECT c.query_id, e.vec_id, CAST(e.label AS BIGINT) AS label,
    list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS similarity,
    row_number() OVER (PARTITION BY c.query_id ORDER BY
      round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 9) DESC, e.vec_id) AS rank
  FROM embeddings e CROSS JOIN cent c QUALIFY rank <= {k})
"""


O["vector_search"] = _top_vectors(10) + "SELECT query_id, vec_id, label, rank, round(similarity, 6) AS similarity FROM hits"
O["hits_by_file"] = _top_vectors(50) + "SELECT query_id, label, count(*) AS hits, min(rank) AS best_rank FROM hits GROUP BY ALL"
O["rank_files"] = _top_vectors(50) + """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, best_rank) AS file_rank
FROM (SELECT query_id, label, count(*) AS hits, min(rank) AS best_rank FROM hits GROUP BY ALL) QUALIFY file_rank <= 5"""
O["topk_similarity"] = f"""WITH cent AS (SELECT list_value({_dims}) AS v FROM embeddings)
SELECT vec_id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS rank, round(s, 6) AS similarity
FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings CROSS JOIN cent) QUALIFY rank <= 10"""
O["cosine_similarity"] = f"""WITH {_CENTROID} SELECT e.vec_id, CAST(e.label AS BIGINT) AS label,
  round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 6) AS similarity
FROM embeddings e JOIN cent c ON c.query_id = CAST(e.label AS VARCHAR)"""
_RELATED = """SELECT repo_id || '|' || file || '|' || r AS query_id, 'function or class named ' || symbol_name AS qt,
  repo_id AS scope, file AS target, r FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY entry_kind, ord) AS r FROM entries) WHERE r <= 5"""
O["related_symbols"] = _with(*_ALL, _search(_RELATED, 5, scoped=True)) + """
SELECT h.repo_id, h.query_id, q.target, h.id, h.rank FROM hits h JOIN q ON q.query_id = h.query_id WHERE h.file <> q.target"""
_USAGES = _with(*_ALL, _search(_one_query("hot_gear", "function or class named hot_gear"), 10)) + """, usages AS (
SELECT repo_id, 'definition' AS kind, symbol_id AS id, type AS detail FROM symbols WHERE contains(lower(name), 'hot_gear')
UNION ALL SELECT repo_id, 'similar', id, CAST(rank AS VARCHAR) FROM hits
UNION ALL SELECT repo_id, 'reference', src, dst FROM edges WHERE contains(src, 'hot_gear') OR contains(dst, 'hot_gear'))
"""
O["find_all_usages"] = _USAGES + "SELECT * FROM usages"
O["usage_totals"] = _USAGES + """SELECT repo_id, count(*) FILTER (kind = 'definition') AS definitions, count(*) FILTER (kind = 'similar') AS "similar",
  count(*) FILTER (kind = 'reference') AS "references", count(*) FILTER (kind <> 'similar') AS total_usages FROM usages GROUP BY repo_id"""
O["improvements_to_files"] = _F + f"""SELECT a.repo_id, a.file_id, a.file, 'Rename' AS description, b.path IS NOT NULL AS found,
  md5(b.content) AS body
FROM (SELECT repo_id, file_id, {_TARGET} AS file FROM files WHERE file_id % 4 = 0) a
LEFT JOIN files b ON b.repo_id = a.repo_id AND b.path = a.file"""
O["build_edit_prompts"] = _F + """SELECT repo_id, path AS file, 'File: ' || path || chr(10) || chr(10) || 'Current content:' || chr(10)
  || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) || 'Improvement:' || chr(10) || 'Rename' || chr(10)
  || 'Reason: Clarity' || chr(10) || 'Suggested changes: x' || chr(10) || chr(10)
  || 'Change as little as possible, keep the style, and return only the complete new file.' AS prompt
FROM files WHERE file_id % 4 = 0 AND file_id % 3 <> 0"""

# -- aggregations
O["context_summary"] = _REVIEW + """, kinds AS (SELECT repo_id, symbol_type, count(*) AS n FROM kept GROUP BY ALL)
SELECT r.repo_id, count(*) AS total_files, CAST(sum(r.hits) AS BIGINT) AS total_symbols,
  string_agg(DISTINCT m.language, ',' ORDER BY m.language) AS languages,
  (SELECT string_agg(k.symbol_type || '=' || k.n, ',' ORDER BY k.symbol_type || '=' || k.n) FROM kinds k WHERE k.repo_id = r.repo_id)
    AS symbol_types,
  string_agg(r.file, ',' ORDER BY r.file_rank) FILTER (r.file_rank <= 5) AS top_files
FROM ranked r JOIN meta m ON m.repo_id = r.repo_id AND m.path = r.file GROUP BY r.repo_id"""
O["index_stats"] = _E + """SELECT repo_id, 'total' AS statistic, NULL AS value, count(*) AS n FROM entries GROUP BY ALL
UNION ALL SELECT repo_id, 'symbol_type', symbol_type, count(*) FROM entries GROUP BY ALL
UNION ALL SELECT repo_id, 'language', language, count(*) FROM entries WHERE language IS NOT NULL GROUP BY ALL"""
O["graph_metadata"] = _R + """SELECT f.repo_id, (SELECT count(DISTINCT (r.file, r.name)) FROM raw r WHERE r.repo_id = f.repo_id)
  AS total_symbols, count(*) AS total_files FROM files f GROUP BY f.repo_id"""
_M = _with(_FILES, _SYMBOLS_RAW, _META)
O["file_metadata"] = _M + """SELECT repo_id, path, language, symbol_count, size, array_to_string(imports, ', ') AS imports,
  array_to_string(exports, ', ') AS exports FROM meta"""
O["symbol_dedup"] = _S + "SELECT repo_id, symbol_id, type, line, ord, z.documentation AS documentation, z.signature AS signature FROM symbols"
_issue = lambda t, o, c: (
    f"SELECT *, 'unclosed-{t}' AS type, CAST({_n(o, 'text')} - {_n(c, 'text')} AS BIGINT) AS cnt FROM src UNION ALL "
    f"SELECT *, 'extra-closing-{t}', CAST({_n(c, 'text')} - {_n(o, 'text')} AS BIGINT) FROM src"
)
_ISSUES = "issues AS (" + " UNION ALL ".join([_issue("brace", "{", "}"), _issue("bracket", "[", "]"), _issue("paren", "(", ")")]) + ")"
O["lint_brackets"] = _with(_FILES, """src AS (
  SELECT 'code' AS kind, CAST(file_id AS VARCHAR) AS id, content AS text FROM files
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), text FROM documents)""", _ISSUES) + "SELECT kind, id, type, cnt FROM issues WHERE cnt > 0"
_LINT_LINES = """semis AS (
  SELECT repo_id, path, count(*) AS cnt FROM (
    SELECT repo_id, path, trim(unnest(string_split(content, chr(10)))) AS t FROM files
    WHERE language IN ('javascript', 'typescript'))
  WHERE regexp_matches(t, '^(import|export|return|const|let|var)\\s+') AND NOT regexp_matches(t, '[;{}]$') GROUP BY ALL)"""
_BF = _with(_FILES, kind="broken")
O["lint_semicolons"] = _with(_FILES, _LINT_LINES, kind="broken") + """SELECT repo_id, path, 'missing-semicolons' AS type, cnt,
  'warning' AS severity FROM semis"""
O["lint_report"] = _with(_FILES, _LINT_LINES, "src AS (SELECT repo_id, path, content AS text FROM files)", _ISSUES) + """, found AS (
  SELECT repo_id, path, 1 AS o, '  - ' || cnt || ' unclosed brace(s) {' AS line FROM issues WHERE cnt > 0 AND type = 'unclosed-brace'
  UNION ALL SELECT repo_id, path, 2, '  - ' || cnt || ' missing semicolon(s) (warning)' FROM semis)
SELECT f.repo_id, f.path, CASE WHEN count(x.line) = 0 THEN 'No syntax errors detected' ELSE
  'Found ' || count(x.line) || ' syntax issue(s):' || chr(10) || string_agg(x.line, chr(10) ORDER BY x.o) END AS report
FROM files f LEFT JOIN found x ON x.repo_id = f.repo_id AND x.path = f.path GROUP BY f.repo_id, f.path"""
O["file_change_report"] = _with(_FILES, _CHANGES) + """, repos AS (SELECT DISTINCT repo_id FROM code_files)
SELECT repo_id, row_number() OVER w AS n, (row_number() OVER w) || '. ' || file || ': ' || description AS line FROM changes
WINDOW w AS (PARTITION BY repo_id ORDER BY ord)
UNION ALL
SELECT repo_id, 0, 'No changes made' FROM (SELECT repo_id || '-none' AS repo_id FROM repos UNION ALL
  SELECT repo_id FROM repos WHERE repo_id NOT IN (SELECT repo_id FROM changes))"""
_EDITED = r"""edited AS (
  SELECT doc_id, text AS o, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '  ')
    WHEN 1 THEN text || chr(10) || 'One more line.' || chr(10) || 'And one more.' || chr(10) || 'And the last.' || chr(10)
    WHEN 2 THEN '// a note' || chr(10) || '// more notes' || chr(10) || '//' || chr(10) || text
    ELSE regexp_replace(text, '^[^\n]*\n', '') END AS n FROM documents),
side AS (
  SELECT doc_id, l, count(*) AS c, 'o' AS s FROM (SELECT doc_id, unnest(regexp_extract_all(o, '[^\n]*\n|[^\n]+')) AS l FROM edited) GROUP BY ALL
  UNION ALL
  SELECT doc_id, l, count(*), 'n' FROM (SELECT doc_id, unnest(regexp_extract_all(n, '[^\n]*\n|[^\n]+')) AS l FROM edited) GROUP BY ALL),
both_sides AS (
  SELECT doc_id, l, coalesce(sum(c) FILTER (s = 'o'), 0) AS co, coalesce(sum(c) FILTER (s = 'n'), 0) AS cn FROM side GROUP BY ALL),
delta AS (
  SELECT doc_id, CAST(sum(greatest(cn - co, 0)) AS BIGINT) AS added, CAST(sum(greatest(co - cn, 0)) AS BIGINT) AS removed,
    CAST(sum(greatest(co, cn)) AS BIGINT) AS total,
    bool_or(cn > co AND trim(l, chr(10) || ' ') <> '' AND NOT regexp_matches(l, '^\s*//')) AS real
  FROM both_sides GROUP BY 1),
judged AS (
  SELECT e.*, d.added, d.removed, d.total,
    trim(regexp_replace(o, '\s+', ' ', 'g')) <> trim(regexp_replace(n, '\s+', ' ', 'g'))
    AND NOT ((d.added + d.removed) / d.total < 0.02 AND d.added + d.removed < 3) AND d.real AS meaningful
  FROM edited e JOIN delta d ON d.doc_id = e.doc_id)"""
O["line_delta"] = f"WITH {_EDITED} SELECT doc_id, added, removed, total FROM judged"
O["meaningful_change"] = f"WITH {_EDITED} SELECT doc_id, meaningful FROM judged"
O["skip_trivial_changes"] = f"WITH {_EDITED} SELECT doc_id, meaningful, md5(CASE WHEN meaningful THEN n ELSE o END) AS body FROM judged"

# -- ranking, sort, limit
O["snippets"] = _REVIEW + """SELECT s.repo_id, s.file AS path,
  row_number() OVER (PARTITION BY s.repo_id, s.file ORDER BY s.file_hit) - 1 AS n, k.symbol_name AS name, k.line, s.code
FROM snips s JOIN kept k ON k.repo_id = s.repo_id AND k.file = s.file AND k.file_hit = s.file_hit"""
O["first_n_names"] = _SX + """SELECT repo_id, file AS path, string_agg(name, ', ' ORDER BY ord) AS names FROM (
  SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY repo_id, file ORDER BY ord) <= 10) GROUP BY ALL"""
O["first_n_refs"] = _REVIEW + """SELECT h.repo_id, h.id, h.symbol_name AS name, e.src, e.dst, row_number() OVER w AS ref_rank
FROM hits h JOIN edges e ON e.repo_id = h.repo_id AND (contains(e.src, h.symbol_name) OR contains(e.dst, h.symbol_name))
WHERE h.symbol_type IN ('function', 'method')
WINDOW w AS (PARTITION BY h.repo_id, h.id ORDER BY e.src_file, e.ord) QUALIFY row_number() OVER w <= 5"""
O["keep_last_n"] = f"SELECT conv_id, turn, {_last} AS rank FROM conversations QUALIFY {_last} <= 50"
O["recent_n"] = f"SELECT conv_id, turn, {_last} AS rank, role FROM conversations QUALIFY {_last} <= 2"
O["greedy_budget"] = f"""SELECT source, doc_id, CAST(len(text) AS BIGINT) AS chars,
  CAST(sum(len(text)) OVER w AS BIGINT) AS running FROM documents
WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) QUALIFY sum(len(text)) OVER w <= {fixed.SUMMARY_BUDGET}"""
O["adjacent_line"] = _BF + """SELECT file_id, CAST(no AS BIGINT) AS line_no, line,
  trim(lead(line) OVER (PARTITION BY file_id ORDER BY no)) AS next_line
FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line,
  generate_subscripts(string_split(content, chr(10)), 1) AS no FROM files)"""

# -- set operations
O["index_union"] = _E + "SELECT repo_id, CAST(entry_kind AS BIGINT) AS entry_kind, id, symbol_type, line, language FROM entries"
O["distinct_languages"] = "SELECT DISTINCT lang FROM documents"
O["merged_suggestions"] = _with(*_ALL, _search(_many(fixed.SUGGESTION_PATTERNS), 30), _context(15)) + """
SELECT query_id, repo_id, count(*) AS n_files, CAST(sum(hits) AS BIGINT) AS n_symbols FROM ranked GROUP BY ALL"""
O["context_union"] = _REVIEW + """SELECT repo_id, symbol_ord AS ord, file AS path, symbol_name AS name, symbol_type AS type, rank FROM kept"""

# -- scalar, vector, text and JSON functions
O["string_similarity"] = f"""SELECT p_partkey, round({_sim('p_name', 'p_type')}, 6) AS similarity FROM part"""
O["embed_text"] = f"WITH {_vectors('dv', 'documents', 'doc_id')} SELECT doc_id, dim, round(w, 6) AS weight FROM dv"
O["embed_text_symbols"] = _with(*_ALL) + "SELECT repo_id, id, dim, round(w, 6) AS weight FROM vec"
O["symbol_text"] = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS, _META, _ENTRIES, kind="extended") + """
SELECT repo_id, id, text FROM entries WHERE entry_kind = 0"""
O["file_text"] = _E + "SELECT repo_id, file AS path, text FROM entries WHERE entry_kind = 1"
O["build_embedding_index"] = _with(*_ALL) + """SELECT e.repo_id, e.symbol_type, count(DISTINCT e.id) AS n, count(*) AS filled
FROM entries e JOIN vec v ON v.repo_id = e.repo_id AND v.id = e.id GROUP BY ALL"""
O["similar_symbols"] = _with(*_ALL, _search("""SELECT DISTINCT repo_id || '|' || name AS query_id, 'function or class named ' || name AS qt,
  repo_id AS scope FROM symbols""", 5, scoped=True)) + """
SELECT query_id, repo_id, id, rank, round(similarity, 6) AS similarity FROM hits"""
O["pattern_query"] = _with(*_ALL, _search(_many(list(fixed.PATTERN_QUERIES)), 30), _context(15)) + """
SELECT query_id, repo_id, file_rank - 1 AS n, file AS path, hits FROM ranked"""
O["retrieve_context"] = _with(*_ALL, _search(_one_query("default", fixed.DEFAULT_QUERY), 50), _context(10)) + """
SELECT repo_id, count(*) AS n_files, CAST(sum(hits) AS BIGINT) AS n_symbols,
  (SELECT count(*) FROM deps d WHERE d.repo_id = r.repo_id) AS n_dependencies,
  (SELECT count(*) FROM calls c WHERE c.repo_id = r.repo_id) AS n_calls FROM ranked r GROUP BY repo_id"""
O["strip_fences"] = _F + "SELECT file_id, md5(trim(content, chr(10) || ' ')) AS body FROM files"
O["path_parts"] = _with(_NAMED) + f"""SELECT file_id, base, ext, regexp_replace(base, '[.][^.]*$', '') AS stem,
  {_FOLDER.format('path')} AS folder FROM named"""
O["iso_time"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events"

# -- repair
_OBJ = r"regexp_replace({0}, 'export\s+(const|let|var)\s+(\w+)\s*=\s*\n\s*async\s+(\w+)', 'export \1 \2 = {{' || chr(10) || '  async \3', 'g')"
_C1 = r"regexp_replace({0}, '\}}\s*,?\s*\n\s*async\s+(\w+)', '}},' || chr(10) || '  async \1', 'g')"
_C2 = r"regexp_replace({0}, '(\w+:\s*[^,\n]+)\s*\n\s*(\w+:)', '\1,' || chr(10) || '\2', 'g')"
_TY = r"regexp_replace({0}, '(?m):\s*$', ': any', 'g')"
_TE = r"regexp_replace({0}, '(?m),(\s*\}}\s*;?\s*)$', '\1', 'g')"
_TC = r"regexp_replace({0}, ',(\s*[}}\]])', '\1', 'g')"
O["repair_incomplete_object"] = _BF + f"SELECT file_id, {_OBJ.format('content')} AS repaired FROM files"
O["repair_commas"] = _BF + f"SELECT file_id, {_C2.format(_C1.format('content'))} AS repaired FROM files"
O["repair_types"] = _BF + f"SELECT file_id, {_TY.format('content')} AS repaired FROM files"
O["repair_trailing_commas"] = _BF + f"SELECT file_id, {_TC.format(_TE.format('content'))} AS repaired FROM files"
_miss = lambda o, c, t: f"greatest({_n(o, t)} - {_n(c, t)}, 0)"


def _closed(t: str) -> str:
    braces = _miss("{", "}", t)
    return (
        f"(CASE WHEN {braces} = 0 THEN {t} WHEN regexp_matches({t}, '\\n\\s*\\}},?\\s*$') "
        f"THEN regexp_replace({t}, '\\s+$', '') || chr(10) || repeat('}}', {braces}) || ';' "
        f"ELSE {t} || chr(10) || repeat('}}', {braces}) END) || repeat(')', {_miss('(', ')', t)}) || repeat(']', {_miss('[', ']', t)})"
    )


O["repair_brackets"] = _F + f"SELECT file_id, {_closed('content')} AS repaired FROM files"
_SEMI = r"""semi_lines AS (
  SELECT file_id, ext, no, line, trim(line) AS t, trim(coalesce(lead(line) OVER (PARTITION BY file_id ORDER BY no), '')) AS nx
  FROM (SELECT file_id, ext, unnest(string_split({0}, chr(10))) AS line,
    generate_subscripts(string_split({0}, chr(10)), 1) AS no FROM files)),
semi_marked AS (
  SELECT *, t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '/*') AND NOT starts_with(t, '*')
    AND NOT regexp_matches(t, '[;{{}}\])=,]$') AND NOT starts_with(nx, 'async ') AND NOT starts_with(nx, 'function ')
    AND (regexp_matches(t, '^(import|export|return|throw|break|continue|type|interface)\s+')
      OR regexp_matches(t, '^(const|let|var)\s+\w+\s*=\s*.+[^=,]$')) AS needs FROM semi_lines),
punct AS (
  SELECT file_id, ext, string_agg(line || CASE WHEN needs THEN ';' ELSE '' END, chr(10) ORDER BY no) AS content,
    coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (needs), '') AS changed, count(*) FILTER (needs) AS n_semi
  FROM semi_marked GROUP BY ALL)"""
O["repair_semicolons"] = _with(_FILES, _SEMI.format("content"), kind="broken") + """
SELECT file_id, content AS repaired, changed AS changed_lines FROM punct"""
_CHAIN = [
    _FILES,
    _SEMI.format(_OBJ.format("content")),
    f"s3 AS (SELECT *, {_C1.format('content')} AS c3a FROM punct)",
    f"s4 AS (SELECT *, {_C2.format('c3a')} AS c3 FROM s3)",
    f"s5 AS (SELECT *, CASE WHEN ext IN ('.ts', '.tsx') THEN {_TY.format('c3')} ELSE c3 END AS c4 FROM s4)",
    f"s6 AS (SELECT *, {_TE.format('c4')} AS c5 FROM s5)",
    f"s7 AS (SELECT *, {_closed('c5')} AS c6 FROM s6)",
    f"all_repaired AS (SELECT *, {_TC.format('c6')} AS fixed_content FROM s7 WHERE ext IN ('.js', '.jsx', '.ts', '.tsx'))",
    "repaired AS (SELECT * FROM all_repaired WHERE file_id % 3 <> 0)",
]
O["smart_repair"] = _with(*_CHAIN, kind="broken") + r"""SELECT file_id, fixed_content,
  CASE WHEN file_id % 8 IN (0, 2) THEN 'incomplete-object-declaration,' ELSE '' END || repeat('missing-semicolon,', n_semi) || 'missing-comma,'
  || CASE WHEN ext IN ('.ts', '.tsx') THEN 'incomplete-type,' ELSE '' END
  || CASE file_id % 8 WHEN 1 THEN 'missing-closing-paren' WHEN 3 THEN 'missing-closing-bracket' ELSE 'missing-closing-brace' END AS fixes
FROM repaired"""
O["apply_fixes"] = _with(*_CHAIN, kind="broken") + f""", plain AS (
  SELECT k AS file_id, repo_id, path, {{body}} AS content FROM g WHERE m < 7)
SELECT p.repo_id, p.path, md5(coalesce(r.fixed_content, p.content)) AS body, r.fixed_content IS NOT NULL AS modified
FROM plain p LEFT JOIN repaired r ON r.file_id = p.file_id"""
O["apply_fixes"] = O["apply_fixes"].replace("{body}", _BODY.replace("STRING_T", "VARCHAR"))
O["validate_fix"] = _with(*_CHAIN, kind="broken") + """SELECT f.file_id,
  len(string_split(r.fixed_content, chr(10))) <= len(string_split(f.content, chr(10))) * 1.1 AND """ + " AND ".join(
    f"abs({_n(c, 'r.fixed_content')} - {_n(c, 'f.content')}) <= 3" for c in "{}[]()"
) + " AS valid FROM files f JOIN all_repaired r ON r.file_id = f.file_id"

# -- contexts as text, focused contexts, reports
_other = lambda where, numbers="": f"""SELECT repo_id, symbol_type, count(*) AS n{numbers} FROM entries WHERE {where} GROUP BY ALL"""
_XE = _with(_FILES, _SYMBOLS_RAW, _SYMBOLS, _META, _ENTRIES, kind="extended")
O["index_rebuild"] = f"""SELECT * FROM ({_E} {_other("NOT starts_with(repo_id, 'org2/')")})
UNION ALL SELECT * FROM ({_XE} {_other("starts_with(repo_id, 'org2/') AND NOT ends_with(repo_id, '3')")})"""
_numbers = f", CAST(count(*) * {fixed.VECTOR_DIM} AS BIGINT) AS numbers"
O["index_build_missing"] = f"""SELECT * FROM ({_E} {_other("regexp_matches(repo_id, '^org[01]/')", _numbers)})
UNION ALL SELECT * FROM ({_XE} {_other("NOT regexp_matches(repo_id, '^org[01]/')", _numbers)})"""
_TEXT = """symbol_text AS (
  SELECT query_id, repo_id, file, string_agg('  - ' || symbol_name || ' (' || symbol_type || ') at line ' || line
    || coalesce(chr(10) || '    Doc: ' || nullif(documentation, ''), '')
    || coalesce(chr(10) || '    Signature: ' || nullif(signature, ''), '') || chr(10) || '    Relevance: '
    || printf('%.1f', floor(similarity * 1000 + 0.5) / 10) || '%', chr(10) ORDER BY rank) AS t
  FROM kept WHERE file_hit <= 10 GROUP BY ALL),
snip_text AS (
  SELECT query_id, repo_id, file, string_agg(chr(10) || '  Symbol: ' || symbol_name || ' (line ' || line || ')' || chr(10)
    || '  ```' || chr(10) || code || chr(10) || '  ```', chr(10) ORDER BY file_hit) AS t
  FROM (SELECT s.*, k.symbol_name, k.line, row_number() OVER (PARTITION BY s.query_id, s.repo_id, s.file ORDER BY s.file_hit) AS n
    FROM snips s JOIN kept k ON k.query_id = s.query_id AND k.repo_id = s.repo_id AND k.file = s.file AND k.file_hit = s.file_hit)
  WHERE n <= 3 GROUP BY ALL),
file_text AS (
  SELECT r.query_id, r.repo_id,
    string_agg('- ' || r.file || ' (' || m.language || ', ' || r.hits || ' relevant symbols)', chr(10) ORDER BY r.file_rank)
      FILTER (r.file_rank <= 5) AS top,
    string_agg(chr(10) || '--- File: ' || r.file || ' (' || m.language || ') ---' || chr(10)
      || CASE WHEN len(m.imports) > 0 THEN 'Imports: ' || array_to_string(m.imports, ', ') || chr(10) ELSE '' END
      || CASE WHEN len(m.exports) > 0 THEN 'Exports: ' || array_to_string(m.exports, ', ') || chr(10) ELSE '' END
      || chr(10) || 'Relevant Symbols:' || chr(10) || st.t
      || coalesce(chr(10) || chr(10) || 'Code Snippets:' || chr(10) || sn.t, ''), chr(10) ORDER BY r.file_rank) AS details,
    count(*) AS n_files, sum(r.hits) AS n_symbols
  FROM ranked r JOIN meta m ON m.repo_id = r.repo_id AND m.path = r.file
  JOIN symbol_text st ON st.query_id = r.query_id AND st.repo_id = r.repo_id AND st.file = r.file
  LEFT JOIN snip_text sn ON sn.query_id = r.query_id AND sn.repo_id = r.repo_id AND sn.file = r.file GROUP BY ALL),
language_text AS (
  SELECT query_id, repo_id, string_agg(language, ', ' ORDER BY first_rank) AS t FROM (
    SELECT r.query_id, r.repo_id, m.language, min(r.file_rank) AS first_rank
    FROM ranked r JOIN meta m ON m.repo_id = r.repo_id AND m.path = r.file GROUP BY ALL) GROUP BY ALL),
type_text AS (
  SELECT query_id, repo_id, '{' || chr(10) || string_agg('  "' || symbol_type || '": ' || n, ',' || chr(10) ORDER BY o)
    || chr(10) || '}' AS t FROM (
    SELECT query_id, repo_id, symbol_type, count(*) AS n, min(symbol_ord) AS o FROM kept GROUP BY ALL) GROUP BY ALL),
dep_text AS (
  SELECT query_id, repo_id, string_agg(src_file || ' -> ' || dst || ' (' || name || ')', chr(10) ORDER BY n) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY file_rank, ord) AS n FROM deps)
  WHERE n <= 20 GROUP BY ALL),
rendered AS (
  SELECT f.query_id, f.repo_id, '=== CODE CONTEXT SUMMARY ===' || chr(10) || 'Total Files: ' || n_files || chr(10)
    || 'Total Symbols: ' || n_symbols || chr(10) || 'Languages: ' || l.t || chr(10) || 'Symbol Types: ' || y.t || chr(10)
    || chr(10) || '=== TOP RELEVANT FILES ===' || chr(10) || top || chr(10) || chr(10) || '=== FILE DETAILS ===' || chr(10)
    || details || coalesce(chr(10) || chr(10) || '=== DEPENDENCIES ===' || chr(10) || d.t, '') AS text
  FROM file_text f JOIN language_text l ON l.query_id = f.query_id AND l.repo_id = f.repo_id
  JOIN type_text y ON y.query_id = f.query_id AND y.repo_id = f.repo_id
  LEFT JOIN dep_text d ON d.query_id = f.query_id AND d.repo_id = f.repo_id)"""
_RENDERED = _with(*_ALL, _search(_one_query("review", fixed.REVIEW_QUERY), 50), _context(10), _TEXT)
O["render_context"] = _RENDERED + "SELECT repo_id, text FROM rendered"
O["render_caps"] = _RENDERED + """SELECT r.repo_id,
  (SELECT count(*) FROM kept k WHERE k.repo_id = r.repo_id AND k.file_hit <= 10) AS symbol_lines,
  (SELECT CAST(sum(least(n, 3)) AS BIGINT) FROM (SELECT s.file, count(*) AS n FROM snips s WHERE s.repo_id = r.repo_id GROUP BY 1))
    AS snippet_heads,
  (SELECT least(count(*), 20) FROM deps d WHERE d.repo_id = r.repo_id) AS dependency_lines FROM rendered r"""
O["compact_context"] = _RENDERED + """, sizes AS (
  SELECT r.repo_id, ceil(len(r.text) / 4) > 1500 AS over,
    (SELECT count(*) FROM ranked x WHERE x.repo_id = r.repo_id) AS f, (SELECT count(*) FROM kept x WHERE x.repo_id = r.repo_id) AS s,
    (SELECT count(*) FROM calls x WHERE x.repo_id = r.repo_id) AS c, (SELECT count(*) FROM deps x WHERE x.repo_id = r.repo_id) AS d
  FROM rendered r)
SELECT repo_id, over, CASE WHEN over THEN least(f, 5) ELSE f END AS n_files, CASE WHEN over THEN least(s, 20) ELSE s END AS n_symbols,
  CASE WHEN over THEN least(c, 10) ELSE c END AS n_calls, CASE WHEN over THEN least(d, 10) ELSE d END AS n_dependencies,
  f AS total_files FROM sizes"""
_shape = (
    '{"summary": "...", "improvements": [{"file": "...", "description": "...", "reason": "...", '
    '"changes": "...", "affectedSymbols": ["..."]}], "priority": "high/medium/low"}'
)
O["build_prompts"] = _RENDERED + f"""SELECT repo_id, md5(p) AS prompt, CAST(ceil(len(p) / 4) AS BIGINT) AS tokens FROM (
  SELECT repo_id, 'Review the repository ' || repo_id || '.' || chr(10) || chr(10) || text || chr(10) || chr(10)
    || 'The context lists the files and symbols most relevant to the review. Suggest only changes that matter, weigh them by relevance, and say so when none is needed.'
    || chr(10) || 'Answer with JSON of this shape:' || chr(10) || '{_shape}' AS p FROM rendered)"""
O["focused_context"] = _with(*_ALL, _search(_RELATED, 5, scoped=True)) + """, own AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.repo_id, e.file ORDER BY e.entry_kind, e.ord) AS r FROM entries e),
held_lines AS (
  SELECT f.repo_id, f.path, o.r, n FROM (SELECT repo_id, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files) f
  JOIN own o ON o.repo_id = f.repo_id AND o.file = f.path AND o.r <= 5 AND o.line > 0 AND abs(f.n - o.line) <= 5
  QUALIFY row_number() OVER (PARTITION BY f.repo_id, f.path, n ORDER BY o.r) = 1),
rel AS (
  SELECT q.scope AS repo_id, q.target AS path, string_agg(h.id, ', ' ORDER BY q.r, h.rank) AS related
  FROM hits h JOIN q ON q.query_id = h.query_id WHERE h.file <> q.target GROUP BY ALL),
dep AS (SELECT repo_id, src_file AS path, string_agg(dst, ', ' ORDER BY ord) AS dependencies FROM edges WHERE type = 'imports' GROUP BY ALL),
n_own AS (SELECT repo_id, file AS path, least(count(*), 50) AS n FROM own GROUP BY ALL),
n_snip AS (SELECT repo_id, path, count(DISTINCT r) AS n FROM held_lines GROUP BY ALL)
SELECT m.repo_id, m.path, m.language, true AS known, o.n AS n_symbols, coalesce(s.n, 0) AS n_snippets,
  coalesce(d.dependencies, '') AS dependencies, coalesce(r.related, '') AS related
FROM meta m JOIN n_own o ON o.repo_id = m.repo_id AND o.path = m.path LEFT JOIN n_snip s ON s.repo_id = m.repo_id AND s.path = m.path
LEFT JOIN dep d ON d.repo_id = m.repo_id AND d.path = m.path LEFT JOIN rel r ON r.repo_id = m.repo_id AND r.path = m.path
UNION ALL
SELECT DISTINCT repo_id, 'src/gone.js', 'unknown', false, 0, NULL::BIGINT, '', '' FROM files"""
O["review_report"] = _with(*_CHAIN, kind="broken") + f""", all_files AS (
  SELECT k AS file_id, repo_id, path FROM g WHERE m < 7),
latest AS (SELECT repo_id, max(file_id) % 4 AS f FROM all_files GROUP BY 1),
changed AS (
  SELECT repo_id, file_id * 3 AS ord, path AS file, 'first' AS description FROM all_files
  UNION ALL SELECT repo_id, file_id * 3 + 1, path, 'second' FROM all_files WHERE file_id % 3 = 0
  UNION ALL SELECT repo_id, file_id * 3 + 2, path || '.new', 'created' FROM all_files WHERE file_id % 5 = 0),
b AS (SELECT f.repo_id, f.file_id, f.path, f.ext, r.n_semi FROM files f JOIN repaired r ON r.file_id = f.file_id)
SELECT repo_id, CAST(1 AS BIGINT) AS section, CAST(0 AS BIGINT) AS n, '## Code Analysis' || chr(10) || chr(10) ||
  CASE WHEN f = 0 THEN 'Tidy up' ELSE '{fixed.CLEAN_SUMMARY}' END || chr(10) || chr(10) || '**Priority:** ' ||
  CASE WHEN f = 0 THEN 'high' ELSE 'low' END AS text FROM latest
UNION ALL SELECT repo_id, 2, 0, '## Syntax Fixes Applied' || chr(10) || chr(10) || 'Repaired ' || count(*) ||
  CASE WHEN count(*) > 1 THEN ' files' ELSE ' file' END || ' that did not parse:' FROM b GROUP BY repo_id
UNION ALL SELECT repo_id, 3, row_number() OVER (PARTITION BY repo_id ORDER BY file_id),
  (row_number() OVER (PARTITION BY repo_id ORDER BY file_id)) || '. **' || path || '**' || chr(10)
  || array_to_string(list_value(CASE WHEN file_id % 8 IN (0, 2) THEN '   - Fixed incomplete object literal after export declaration' END,
    repeat('   - missing-semicolon' || chr(10), n_semi - 1) || '   - missing-semicolon'), chr(10))
  || chr(10) || '   - Added missing commas in object literals'
  || CASE WHEN ext IN ('.ts', '.tsx') THEN chr(10) || '   - Added default "any" type for incomplete annotations' ELSE '' END
  || chr(10) || '   - missing-closing-' || CASE file_id % 8 WHEN 1 THEN 'paren' WHEN 3 THEN 'bracket' ELSE 'brace' END FROM b
UNION ALL SELECT repo_id, 4, 0, '## Code Improvements' FROM latest
UNION ALL SELECT repo_id, 5, row_number() OVER (PARTITION BY repo_id ORDER BY ord),
  (row_number() OVER (PARTITION BY repo_id ORDER BY ord)) || '. **' || file || '**' || chr(10) || '   - ' || description FROM changed
UNION ALL SELECT repo_id, 6, 0, '## Review Checklist' || chr(10) || chr(10) || '- [ ] Each change does what its description says' || chr(10)
  || '- [ ] Callers of the changed code still work' || chr(10) || '- [ ] The tests were run' || chr(10)
  || '- [ ] Names and layout fit the rest of the project' FROM latest"""
