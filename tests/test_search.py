import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.similarity import cosine_similarity
from corpusloom.functions.vectors import embed_text
from corpusloom.operators import context as ctx
from corpusloom.operators import ranking, search


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="same length"):
        bad.select(cosine_similarity(F.col("a"), F.col("b"))).collect()


def test_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([("Foo foo bar",), ("",), (None,)], "t string").select(embed_text(F.col("t")).alias("v"))
    rows = [r.v for r in df.collect()]
    assert all(len(v) == 384 for v in rows)
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and sum(x > 0 for x in rows[0]) == 2
    assert set(rows[1]) == {0.0}


@pytest.mark.parametrize("block_bytes", [8 * 1024 * 1024, 1024])
def test_search_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(search, "MAX_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(search, "TILE_ROWS", 90)
    monkeypatch.setattr(search, "TILE_QUERIES", 7)
    monkeypatch.setattr(search, "CHUNK", 3)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (600, 8)).astype(float)
    repos = ["hot" if i % 3 else f"r{i % 5}" for i in range(600)]
    rows = [(r, 0, f"f{i % 7}", i, [float(x) for x in v]) for i, (r, v) in enumerate(zip(repos, vectors))]
    index = spark.createDataFrame(
        rows, "repo_id string, entry_kind int, file string, ord bigint, embedding array<float>"
    ).repartition(5)
    queries = rng.integers(-2, 3, (40, 8)).astype(float)
    scopes = [None if i % 2 else "hot" for i in range(40)]
    q = spark.createDataFrame(
        [(str(i), [float(x) for x in v], s) for i, (v, s) in enumerate(zip(queries, scopes))],
        "query_id string, vector array<double>, scope string",
    )
    got = {
        (r.query_id, r.repo_id, r["rank"]): r.ord for r in search.vector_search(q, index, 4).collect()
    }
    want = {}
    for i, v in enumerate(queries):
        n = np.linalg.norm(v) * np.linalg.norm(vectors, axis=1)
        s = np.round(np.where(n > 0, vectors @ v / np.where(n > 0, n, 1), 0), 9) + 0.0
        for repo in set(repos):
            if scopes[i] in (None, repo):
                ids = [j for j in range(600) if repos[j] == repo]
                ids.sort(key=lambda j: (-s[j], f"f{j % 7}", j))
                want.update({(str(i), repo, k + 1): j for k, j in enumerate(ids[:4])})
    assert got == want


def test_search_refuses_other_lengths(spark):
    index = spark.createDataFrame([("r", 0, "f", 0, [1.0])], "repo_id string, entry_kind int, file string, ord bigint, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vector array<double>")
    with pytest.raises(Exception, match="same length"):
        search.vector_search(q, index).collect()


def test_running_total_equals_window(spark):
    rows = [("hot" if i % 3 else "b", i, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.t for r in ranking.running_total(df, ["k"], "o", "v", "t").collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[k, o] = sums[k]
    assert got == want
    kept = ranking.within_budget(df, ["k"], "o", "v", 100).collect()
    assert sorted((r.k, r.o) for r in kept) == sorted(x for x, t in want.items() if t <= 100)


def test_running_total_of_one_key_with_sparse_order(spark):
    rows = [("one", i * i * 10**12 - 10**15, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    total = ranking.running_total(df, ["k"], "o", "v", "t")
    got = [r.t for r in total.orderBy("o").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == list(np.cumsum([v for _, _, v in rows]))
    plan = total._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 2 and sum("_range" in w.split("], [")[1] for w in windows) == 1


def _hits(spark, lines, path="a.js"):
    rows = [("q", "o/r", path, i + 1, f"s{i}", "function" if l else "file", l, 0.5, None, None) for i, l in enumerate(lines)]
    return spark.createDataFrame(
        rows,
        "query_id string, repo_id string, file string, rank int, symbol_name string, symbol_type string, line int, "
        "similarity double, documentation string, signature string",
    )


def _meta(spark, files, contents):
    from corpusloom.operators import extract, graph

    raw = extract.extract_symbols(files(contents))
    return graph.file_metadata(files(contents), raw), graph.build_edges(raw), files(contents)


def test_snippet_lines_belong_to_the_first_hit(spark, files):
    text = "\n".join(f"l{i}" for i in range(1, 21))
    meta, _, bodies = _meta(spark, files, {"a.js": text})
    numbers = lambda code: [int(x.split(":")[0]) for x in code.strip().split("\n")]
    found = ctx.file_context(ctx.file_hits(_hits(spark, [3, 6])), meta, bodies).first().snippets
    assert [numbers(s.code) for s in found] == [list(range(1, 9)), [9, 10, 11]]
    assert found[0].code.startswith("1: l1\n2: l2\n")
    found = ctx.file_context(ctx.file_hits(_hits(spark, [0, 10, 10, 12, 14, 20])), meta, bodies).first().snippets
    assert [numbers(s.code) for s in found] == [list(range(5, 16)), [16, 17], [18, 19]]


def test_missing_body_keeps_the_row(spark, files):
    meta, edges, bodies = _meta(spark, files, {"a.js": "let a = 1;\n"})
    row = ctx.retrieve_context(_hits(spark, [1], "gone.js"), meta, edges, bodies).first()
    assert row["files"][0].language == "unknown" and row["files"][0].snippets is None


def test_dependencies_default_and_parity(spark, files):
    meta, edges, bodies = _meta(spark, files, {"a.js": "import { a, b, c } from './m';\nfunction f() {}\n"})
    ranked = ctx.file_hits(_hits(spark, [2]))
    assert sorted(r.symbol for r in ctx.dependencies(ranked, edges).collect()) == ["a", "b", "c"]
    assert ctx.dependencies(ranked, edges, parity=True).count() == 9


def test_render_and_compact(spark, files):
    contents = {f"f{i}.js": "import { x } from './m';\n" + "function g() {}\n" * 30 for i in range(7)}
    meta, edges, bodies = _meta(spark, files, contents)
    hits = None
    for i in range(7):
        part = _hits(spark, [2, 15, 31], f"f{i}.js").withColumn("rank", F.col("rank") + 3 * i)
        hits = part if hits is None else hits.unionByName(part)
    full = ctx.retrieve_context(hits, meta, edges, bodies)
    text = ctx.render_context(full).first().text
    assert text.startswith(
        "=== CODE CONTEXT SUMMARY ===\nTotal Files: 7\nTotal Symbols: 21\nLanguages: javascript\n"
        'Symbol Types: {\n  "function": 21\n}\n\n=== TOP RELEVANT FILES ===\n- f0.js (javascript, 3 relevant symbols)\n'
    )
    assert "\n\n=== FILE DETAILS ===\n\n--- File: f0.js (javascript) ---\nImports: x\n\nRelevant Symbols:\n  - s0 (function) at line 2\n    Relevance: 50.0%\n" in text
    assert "\n\nCode Snippets:\n\n  Symbol: s0 (line 2)\n  ```\n1: import { x } from './m';\n" in text
    assert text.endswith("\n\n=== DEPENDENCIES ===\n" + "\n".join(f"f{i}.js -> ./m::x (x)" for i in range(7)))
    small = ctx.compact_context(full, 10).first()
    assert [len(small[c]) for c in ("files", "symbols", "dependencies")] == [5, 20, 7]
    assert all(len(f.snippets) == 2 for f in small["files"]) and small.summary.total_files == 7
    assert len(ctx.compact_context(full, 10**6).first()["files"]) == 7


def test_names_meet_texts_by_pieces(spark):
    from corpusloom.operators.containing import containing

    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé/"), n))
    names = {("r", word(int(rng.integers(1, 6)))) for _ in range(60)} | {("r", ""), ("s", "ab"), ("t", "x")}
    texts = {(str(rng.choice(["r", "s"])), word(int(rng.integers(0, 30)))) for _ in range(200)}
    got = containing(spark.createDataFrame(sorted(names), "repo_id string, name string"), spark.createDataFrame(sorted(texts), "repo_id string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((r, n, t) for r, n in names for s, t in texts if r == s and n in t)


def _corpus(spark, files, contents):
    from corpusloom.plans import graph_build

    given = None
    for repo, texts in contents.items():
        part = files(texts, repo)
        given = part if given is None else given.unionByName(part)
    return graph_build.sources(spark, given), given


def test_focused_context_of_many_targets(spark, files, monkeypatch):
    from corpusloom.plans import graph_build

    monkeypatch.setattr(search, "MAX_BLOCK_BYTES", 1024)
    contents = {
        repo: {f"f{i}.js": f"import {{ x{i} }} from './m';\nfunction load{i}(a) {{\n}}\nfunction save{i}(a) {{\n}}\n" for i in range(6)}
        for repo in ("o/1", "o/2")
    }
    (idx, meta, edges, _), given = _corpus(spark, files, contents)
    targets = given.select("repo_id", F.col("path").alias("file")).unionByName(
        spark.createDataFrame([("o/1", "gone.js")], "repo_id string, file string")
    )
    rows = {(r.repo_id, r.query_id): r for r in graph_build.focused_context(targets, idx, meta, edges, given).collect()}
    assert len(rows) == 13
    gone = rows["o/1", "gone.js"]
    assert not gone.known and gone["files"][0].language == "unknown" and gone["files"][0].snippets is None
    assert (gone["files"][0].symbols, gone.dependencies, gone.related) == ([], [], [])
    one = rows["o/2", "f3.js"]
    assert one.known and [d.symbol for d in one.dependencies] == ["x3"] and len(one["files"][0].snippets) == 1
    assert one.related and all(r.file != "f3.js" for r in one.related)
    assert [(r.entry_rank, r["rank"]) for r in one.related] == sorted((r.entry_rank, r["rank"]) for r in one.related)


def test_rendering_moves_no_bodies(spark, files):
    from corpusloom.plans import graph_build

    contents = {"o/1": {f"f{i}.js": "import { x } from './m';\nfunction g() {}\n" * 3 for i in range(12)}}
    (idx, meta, edges, _), given = _corpus(spark, files, contents)
    text = ctx.render_context(graph_build.review_context(spark, idx, meta, edges, given))
    assert text.count() == 1
    text.collect()
    plan = text._jdf.queryExecution().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line and "content#" in line]
    assert not moved and "CartesianProduct" not in plan


def test_pieces_are_never_broadcast(spark):
    """A text of n characters has about 3 n pieces, which no estimate knows of; only a hint keeps them out of a broadcast."""
    from corpusloom.operators.containing import containing

    names = spark.createDataFrame([("o/r", "ab"), ("o/r", "zz")], "repo_id string, name string")
    texts = spark.createDataFrame([("o/r", "xaby")], "repo_id string, text string")
    found = containing(names, texts)
    assert [tuple(r) for r in found.collect()] == [("o/r", "ab", "xaby")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
    assert containing(names, texts, few=True).collect() == found.collect()


def test_code_queries_trust_small_estimates_only(spark, tmp_path):
    import __spark_entry__ as entry
    from corpusloom.llm.common import prepared

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    row = (1, "hot gear", "Brand#1", "ECONOMY", 1, 1.0)
    part = spark.createDataFrame([row], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()["path_parts"](spark, str(tmp_path)).count() == 1
    assert spark.conf.get(key) == "1m"
    prepared(spark)
    assert spark.conf.get(key) == before


def test_vectors_and_scans_work_in_bounded_passes(spark, monkeypatch):
    """The vectors of a batch are counted in passes and equal those of one pass; scans gather short batches, but not all."""
    import pyarrow as pa

    from corpusloom.functions import vectors

    lists = pa.array([["a", "b", "a"], [], None, ["c"] * 50, ["d", "a"], ["b"]] * 40, pa.list_(pa.string())).slice(1)
    monkeypatch.setattr(vectors.F, "arrow_udf", lambda _: lambda f: f)
    passes, one_pass = [], vectors._unit_vectors
    monkeypatch.setattr(vectors, "_unit_vectors", lambda x, *how: passes.append(len(x.flatten())) or one_pass(x, *how))
    whole = vectors._unit_vector_udf(16)(lists)
    monkeypatch.setattr(vectors, "PASS_ROWS", 7)
    monkeypatch.setattr(vectors, "PASS_TOKENS", 20)
    passes.clear()
    assert vectors._unit_vector_udf(16)(lists).equals(whole) and len(whole) == len(lists)
    assert len(passes) > 30 and max(passes) == 50 and sorted(passes)[-41] <= 20

    met = []
    monkeypatch.setattr(search, "_hits", lambda rows, *how: met.append(len(rows)) or rows)
    monkeypatch.setattr(search, "SCAN_ROWS", 25)

    class Index:
        def mapInArrow(self, run, schema):
            batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (10, 10, 10, 0, 40, 5)]
            return [b.num_rows for b in run(iter(batches))]

    assert sum(search._scan(Index(), None, "x long")) == 75 and met == [20, 10, 40, 5]


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("most", [0, 1000])
def test_short_pieces_are_listed_only_for_short_names(spark, monkeypatch, few, most):
    """Pieces of one or two characters are two thirds of all; only names that are as short look there."""
    from corpusloom.operators import containing as c

    monkeypatch.setattr(c, "SHORT_NAMES", most)
    names = [("r", "bcd"), ("r", "b"), ("s", "ab"), ("s", ""), ("s", "abcde"), ("t", "x"), ("r", None)]
    texts = [("r", "abcd"), ("r", "b"), ("r", ""), ("s", "xab"), ("s", ""), ("s", None), ("u", "x"), ("s", "abcdef")]
    given = spark.createDataFrame(names, "repo_id string, name string")
    asked = spark.createDataFrame(texts, "repo_id string, text string")
    got = c.containing(given, asked, few)
    assert sorted(map(tuple, got.collect())) == sorted((r, n, t) for r, n in names for s, t in texts if r == s and n is not None and t is not None and n in t)

    keys = asked.filter("text = 'abcdef'").select(c._keys(given).alias("k")).first()["k"]
    assert sorted(keys) == (["", "a", "ab", "abc", "b", "bc", "bcd", "c", "cd", "cde", "d", "de", "def", "e", "ef", "f"] if not most else ["", "ab", "abc", "b", "bcd", "cde", "def"])
    assert asked.filter("text = 'abcdef'").select(c._keys(given.filter("name = 'bcd'")).alias("k")).first()["k"] == ["abc", "bcd", "cde", "def"]


@pytest.mark.parametrize("blocks", [(1 << 18, 1 << 16, 4096), (7, 9, 4)])
def test_many_names_meet_texts_in_tiles(spark, monkeypatch, blocks):
    """Names of all lengths against texts, in one tile and in many; pieces are no rows, so only names and texts are shuffled."""
    from corpusloom.operators import containing as c

    monkeypatch.setattr(c, "MANY_NAMES", 0)
    for constant, size in zip(("TILE_NAMES", "TILE_TEXTS", "PASS_TEXTS"), blocks):
        monkeypatch.setattr(c, constant, size)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abé/"), n))
    names = {("r", word(int(rng.integers(1, 12)))) for _ in range(60)} | {("r", ""), ("s", "ab"), ("s", "é"), ("t", "x"), ("r", None), (None, "a")}
    texts = {(str(rng.choice(["r", "s"])), word(int(rng.integers(0, 30)))) for _ in range(100)}
    texts |= {("r", f"{a}{n}{b}") for r, n in names if r == "r" and n for a, b in (("", ""), ("x", ""), ("é", "x"))} | {("r", None), (None, "a"), ("u", "x")}
    by = lambda rows: sorted(rows, key=str)
    found = c.containing(spark.createDataFrame(by(names), "repo_id string, name string"), spark.createDataFrame(by(texts), "repo_id string, text string"))
    whole = lambda *x: None not in x
    assert sorted(map(tuple, found.collect())) == sorted((r, n, t) for r, n in names for s, t in texts if whole(r, n, t) and r == s and n in t)
    assert "piece" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("filled,low", [(0.1, 0), (0.1, -3), (0.9, -3)])
def test_bounds_leave_out_no_hit(monkeypatch, filled, low):
    """Packed rows scored where the bound of their block allows, against all pairs; few numbers leave most rows out."""
    import pyarrow as pa

    monkeypatch.setattr(search, "FEW_ROWS", 100)
    monkeypatch.setattr(search, "CHUNK", 16)
    scored, all_rows = [], []
    scores, whole = search._Bounds._scores, search._all
    monkeypatch.setattr(search._Bounds, "_scores", lambda self, blocks, *how: scored.append(len(blocks)) or scores(self, blocks, *how))
    monkeypatch.setattr(search, "_all", lambda *how: all_rows.append(1) or whole(*how))
    rng = np.random.default_rng(2)
    some = lambda n: rng.integers(low, 4, (n, 64)) * (rng.random((n, 64)) < filled)
    listed = lambda m: search._Sparse(pa.chunked_array([search._pack(pa.array(m.astype(np.float32).tolist(), pa.list_(pa.float32())))]))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for n, k in ((90, 5), (1003, 1), (1003, 5), (1003, 200)):
        rows, queries = some(n), np.r_[some(50), np.zeros((1, 64), int)]
        place = rng.permutation(n)
        row, col, value = listed(rows).nearest(place, listed(queries), k)
        exact = np.round(unit(rows)[place] @ unit(queries).T, 9) + 0.0
        want = [(c, r) for c in range(51) for r in np.lexsort((np.arange(n), -exact[:, c]))[:k]]
        assert list(zip(col, row)) == want and np.allclose(value, exact[row, col])
    assert bool(scored) == (filled < 0.5) and all_rows


def test_packed_vectors_keep_their_lengths():
    import pyarrow as pa

    lists = pa.array([[0.0, 1.5], None, [], [0.0, 0.0, 2.0]], pa.list_(pa.float32()))
    assert [len(x) // search._RECORD.itemsize for x in search._pack(lists).to_pylist()] == [2, 1, 1, 2]
    for some in (lists, lists.slice(1, 2), lists.slice(1, 1)):
        with pytest.raises(ValueError, match="same length"):
            search._Sparse(pa.chunked_array([search._pack(some)]))
    assert search._Sparse(pa.chunked_array([search._pack(lists.slice(3))])).dense().tolist() == [[0, 0, 1]]


def test_tiles_move_no_vectors_and_no_hits(spark, files, monkeypatch):
    """Vectors go to their tiles packed, and what a tile finds stays where it is."""
    from corpusloom.operators import index
    from corpusloom.plans import graph_build

    monkeypatch.setattr(search, "MAX_BLOCK_BYTES", 0)
    contents = {r: {f"f{i}.js": f"function load{i}(a) {{\n}}\nfunction save{i}(a) {{\n}}\n" for i in range(6)} for r in ("o/1", "o/2")}
    (idx, _, _, _), given = _corpus(spark, files, contents)
    found = graph_build.related_to_targets(given.select("repo_id", F.col("path").alias("file")), idx.select(*index.SEARCHED))
    assert found.count() == found.select("query_id", "rank").distinct().count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    above, tiles, below = plan.partition("FlatMapCoGroupsInArrow")
    assert tiles and "Exchange" not in above and "Join" not in above and "Exchange" in below
    dealt = found._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapCoGroupsInArrow")[0]
    assert "Join" not in dealt and "Window" not in dealt
    moved = [line for line in below.split("\n") if "Exchange" in line]
    assert not any("embedding" in line or "vector" in line for line in moved)


def test_stored_tables_of_code_queries_leave_no_shuffle_files(spark):
    import time

    from corpusloom import session

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}
    earlier, before = held(), spark.conf.get(session.DROP_SHUFFLES)
    back = session.stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    for _ in range(50):
        if not held() - earlier:
            break
        time.sleep(0.1)
    assert not held() - earlier
    assert spark.conf.get(session.DROP_SHUFFLES) == before and back.count() == 700


def test_files_of_hits_are_ranked_where_they_are_grouped(spark):
    """Hits are dealt once, by query and repository."""
    found = ctx.file_hits(_hits(spark, [3, 6]))
    assert [(r.path, r.file_rank, r.hits, len(r.symbols)) for r in found.collect()] == [("a.js", 1, 2, 2)]
    assert found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].count("Exchange ") == 1
