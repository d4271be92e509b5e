"""The registered queries of the training-text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import credentials, exact, html, lattice, lines, minhash, mixing, packing, periodic, quality, rules, trie, urls
from corpusloom.llm.common import prepared, saved, table


def tokenizer_path() -> str:
    """The ranks of the vocabulary that op5's contract names; every executor has them installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), common=None)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.kept_lines(docs, saved(lines.keep_bitmaps(docs), "bitmaps"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def packing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.word_outcomes(pages))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    automata = credentials.infer(saved(credentials.labelled(docs), "credentials"))
    return credentials.digests(credentials.found(docs, automata))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_runs(periodic.rewritten(table(spark, sf_dir, "documents"))))


_OPERATORS = {
    "op1_minhash_near_dedup": near_duplicates,
    "op2_line_dedup": line_dedup,
    "op3_exact_dedup": exact_dedup,
    "op4_quality_classifier": quality_scores,
    "op5_best_fit_packing": packing_plan,
    "op6_url_filters": url_filters,
    "op7_quality_rules": quality_rules,
    "op8_secret_scans": secret_scans,
    "op9_html_extraction": html_text,
    "op10_source_mixing": source_mix,
    "op11_conversation_trie": conversation_trie,
    "op12_embedding_near_dedup": embedding_near_duplicates,
    "op13_periodic_runs": periodic_runs,
}

QUERIES = {name: (lambda spark, sf_dir, q=q: q(prepared(spark), sf_dir)) for name, q in _OPERATORS.items()}

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
d AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id > f.first AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

_EXACT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), {_SPACES}, '') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
"""


def _strength(source: str, mean: str) -> str:
    """SQL of ``bayes.strength`` over a table with n and k."""
    return f"""(SELECT CASE WHEN coalesce(total, 0) = 0 OR groups < 2 OR coalesce(chance, 0) = 0 OR room <= 0 OR share <= 1 / 201.0 THEN 200.0
              ELSE greatest(2.0, 1 / share - 1) END
       FROM (SELECT *, (spread - (groups - 1) * chance / total) / (room * chance / total) AS share
             FROM (SELECT *, total - squares / total - (groups - 1) AS room
                   FROM (SELECT CAST(count(*) AS DOUBLE) AS groups, CAST(sum(n) AS DOUBLE) AS total, sum(CAST(n AS DOUBLE) * n) AS squares,
                                sum(n * pow(k / n - {mean}, 2)) AS spread, sum(n * {mean} * (1 - {mean})) AS chance
                         FROM {source} WHERE n > 0))))"""


def _registered() -> str:
    long = ", ".join(f"'{s}'" for s in urls.LONG_SUFFIXES)
    return f"""CASE WHEN array_to_string(parts[-2:], '.') IN ({long}) THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
       CASE WHEN array_to_string(parts[-2:], '.') IN ({long}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix"""


def _rule_case(column: int) -> str:
    cases = ""
    for action, rule in sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        cases += f" WHEN (host = '{name}' OR suffix_of(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{(rule, action)[column]}'"
    return f"CASE{cases} END".replace("suffix_of", "ends_with")


_URLS = rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (
  SELECT host, list_has_any(
    regexp_split_to_array(translate(host || '/' || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'),
    [{", ".join(f"'{w}'" for w in urls.BAD_WORDS)}]) AS bad
  FROM p),
h AS (
  SELECT *, {_registered()}
  FROM (SELECT host, string_split(host, '.') AS parts, count(*) AS n, count(*) FILTER (bad) AS k FROM o GROUP BY host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
g AS (SELECT *, (SELECT sum(k) / sum(n) FROM s) AS prior FROM s),
gs AS (SELECT {_strength("g", "prior")} AS c),
sm AS (SELECT suffix, (prior * c + k) / (n + c) AS prior FROM g, gs),
dp AS (SELECT d.*, prior FROM d JOIN sm USING (suffix)),
ds AS (SELECT {_strength("dp", "prior")} AS c),
dm AS (SELECT domain, (prior * c + k) / (n + c) AS prior FROM dp, ds),
hp AS (SELECT host, n, k, prior FROM h JOIN dm USING (domain)),
hs AS (SELECT {_strength("hp", "prior")} AS c),
hm AS (SELECT host, n + c AS size, (prior * c + k) / (n + c) AS mean FROM hp, hs),
b AS (SELECT host FROM hm WHERE mean - {urls.Z} * sqrt(mean * (1 - mean) / (size + 1)) > {urls.LIMIT})
SELECT page_id, host, path, {_rule_case(0)} AS rule,
       coalesce({_rule_case(1)}, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""

_RULES = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         regexp_extract_all(coalesce(text, ''), '[^\n]*[^\x20\x09-\x0D][^\n]*') AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS start, words FROM d WHERE len(words) >= 8),
g AS (SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, array_to_string(words[start:start + 7], ' ')) > 1 AS again FROM w),
r AS (SELECT doc_id, count(DISTINCT start + i) AS n_repeat_words FROM g, (SELECT unnest(range(0, 8)) AS i) WHERE again GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n,
         count(*) FILTER (base_failed OR 100 * n_symbols > {rules.MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {rules.MOST_LINES} * n_lines) AS k
  FROM f GROUP BY source),
hp AS (SELECT *, (SELECT sum(k) / sum(n) FROM h) AS prior FROM h),
hs AS (SELECT {_strength("hp", "prior")} AS c),
hm AS (SELECT source, n + c AS size, (prior * c + k) / (n + c) AS mean FROM hp, hs)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND mean - {rules.Z} * sqrt(mean * (1 - mean) / (size + 1)) <= {rules.LIMIT} AS kept
FROM f JOIN hm ON f.source IS NOT DISTINCT FROM hm.source
"""

#: CRC-32 of the decimal form of conv_id; every byte is one step of the outer fold, every bit one of the inner.
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

_TRIE = f"""
WITH t AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
o AS (SELECT conv_id, turns, {_CRC} % {trie.HEAD} AS h FROM t),
c AS (
  SELECT o.conv_id, CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[1:h] END || o.turns[h + 1:] AS turns
  FROM o LEFT JOIN t b ON b.conv_id = o.conv_id - o.conv_id % {trie.FAMILY}),
p AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
n AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(prefix[d].x) END AS own,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY prefix, d),
k AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (
  SELECT prefix[1:j] AS prefix, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS j FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (prefix) LEFT JOIN n u ON m.d > 0 AND u.prefix = m.prefix[1:m.d - 1]
"""

_LATTICE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER () AS rid,
         coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
                  AND len(list_filter(embedding, lambda e: e <> 0)) > 0, false) AS fine
  FROM embeddings),
f AS (SELECT rid, label, len(x) AS size, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda y: y * y)))) AS u FROM v WHERE fine),
l AS (SELECT a.rid AS a, b.rid AS b FROM f a JOIN f b ON a.label = b.label AND a.size = b.size AND a.rid <> b.rid AND list_inner_product(a.u, b.u) >= {lattice.LEAST_COSINE}),
r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS rid, min(vec_id) AS component_id FROM r JOIN v ON r.b = v.rid GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.rid) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN g USING (rid)
"""

ORACLES = {
    "op2_line_dedup": _LINES,
    "op3_exact_dedup": _EXACT,
    "op6_url_filters": _URLS,
    "op7_quality_rules": _RULES,
    "op11_conversation_trie": _TRIE,
    "op12_embedding_near_dedup": _LATTICE,
}
