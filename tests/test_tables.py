import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import text as tx
from corpusloom.operators import changes, memory, review
from corpusloom.plans import inputs
from corpusloom.sources import corpus, tables
from corpusloom.streaming.memory import read_memory, start_memory_stream


def test_tree_scan_rules(spark, tmp_path):
    for name, text in {
        "src/__init__.py": "a",
        "src/.eslintrc.js": "b",
        "_lib/y.js": "é",
        ".hidden/z.js": "d",
        "node_modules/m.js": "e",
        "src/UP.JS": "f",
        "src/big.js": "g" * 100001,
        "src/h.h": "h",
        "src/doc.md": "i",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    roots = spark.createDataFrame([("o/r", str(tmp_path)), ("o/none", str(tmp_path / "absent"))], "repo_id string, root string")
    rows = {r.path: (r.content, r.size) for r in corpus.read_tree(roots).collect()}
    assert rows == {"src/__init__.py": ("a", 1), "src/.eslintrc.js": ("b", 1), "_lib/y.js": ("é", 2)}
    _, problems = corpus.scan_tree(roots)
    found = {(r.repo_id, r.path): r.problem for r in problems.collect()}
    assert found["o/r", "src/big.js"] == "too_large" and found["o/none", ""].startswith("folder: ") and len(found) == 2
    wider = {r.path for r in corpus.read_tree(roots, context=True).collect()}
    assert wider == {"src/__init__.py", "src/.eslintrc.js", "_lib/y.js", ".hidden/z.js", "src/big.js", "src/h.h"}


def test_one_tree_is_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        path = tmp_path / f"d{i}" / "deep" / "er" / "a.py"
        path.parent.mkdir(parents=True)
        path.write_text(str(i))
    (tmp_path / "d0" / "gone.py").symlink_to(tmp_path / "nowhere")
    roots = spark.createDataFrame([("o/r", f"file://{tmp_path}")], "repo_id string, root string")
    levels = []
    monkeypatch.setattr(corpus, "stored", lambda df, name: levels.append(df.withColumn("_task", F.spark_partition_id()).cache()) or levels[-1].drop("_task"))
    listed = corpus.list_tree(roots, partitions=8)
    assert listed.filter("problem IS NULL").count() == 40 and len(levels) == 4
    assert levels[1].select("_task").distinct().count() > 4
    lost = listed.limit(1).withColumn("path", F.lit("d1/none.py")).select("repo_id", "root", "path", "size")
    read = lost.mapInArrow(corpus._reading, "repo_id string, path string, content string, size long, problem string").first()
    assert read.content is None and read.problem.startswith("file: ")


def test_context_files_only_where_there_are_more(files):
    wide = files({"a.js": "", "b.h": "", "c.h": ""}, "o/wide").unionByName(files({"a.cs": "", "b.rb": "", "c.h": ""}, "o/narrow"))
    got = sorted((r.repo_id, r.path) for r in corpus.scan_context_files(wide).collect())
    assert got == [("o/narrow", "a.cs"), ("o/narrow", "b.rb"), ("o/wide", "a.js"), ("o/wide", "b.h"), ("o/wide", "c.h")]


def test_subpath_status(files):
    given = files({"lib/a.js": ""}, "o/1").unionByName(files({"lib/x.md": ""}, "o/2")).unionByName(files({"a.js": ""}, "o/3"))
    inside, status = corpus.scan_subpath(given, "lib")
    assert [(r.repo_id, r.path) for r in inside.collect()] == [("o/1", "a.js")]
    assert {r.repo_id: r.status for r in status.collect()} == {"o/1": "ok", "o/2": "no_files_found", "o/3": "path_not_found"}


def test_index_save_load_delete_rebuild(spark, tmp_path):
    root = str(tmp_path / "index")
    schema = StructType.fromDDL("id string, repo_id string")
    make = lambda rows: spark.createDataFrame(rows, schema)
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "repo_id string")
    assert tables.load_index(spark, root, schema).count() == 0
    tables.delete_index(spark, root, named("a/b"), schema)
    tables.save_index(make([("1", "a/b"), ("2", "a/b"), ("3", "a_b"), ("4", "x=y %/z")]), root)
    read = lambda *repos: sorted((r.repo_id, r.id) for r in tables.load_index(spark, root, schema, named(*repos) if repos else None).collect())
    assert read() == [("a/b", "1"), ("a/b", "2"), ("a_b", "3"), ("x=y %/z", "4")]
    assert read("a_b", "not there") == [("a_b", "3")]
    tables.rebuild_index(make([("9", "a/b")]), root)
    assert read() == [("a/b", "9"), ("a_b", "3"), ("x=y %/z", "4")]
    tables.delete_index(spark, root, named("x=y %/z", "not there"), schema)
    assert read() == [("a/b", "9"), ("a_b", "3")]
    tables.rebuild_index(make([("5", "new")]), root, named("new", "a_b"))
    assert read() == [("a/b", "9"), ("new", "5")]


def test_index_changes_rewrite_only_their_buckets_and_commit_once(spark, tmp_path):
    root = str(tmp_path / "index")
    schema = StructType.fromDDL("id string, repo_id string")
    rows = [(str(i), f"o/{i}") for i in range(200)]
    tables.save_index(spark.createDataFrame(rows, schema), root)
    first = tables._manifest(spark, root)
    tables.rebuild_index(spark.createDataFrame([("new", "o/7")], schema), root)
    second = tables._manifest(spark, root)
    changed = [b for b in second["held"] if first["held"].get(b) != second["held"][b]]
    assert len(changed) == 1 and len(os.listdir(f"{root}/version=2")) <= 4
    with pytest.raises(Exception, match="exist"):
        tables._commit(spark, root, second)
    # A writer that fails before its manifest leaves the table as it was.
    tables._write_buckets(spark.createDataFrame([("lost", "o/8")], schema), f"{root}/version=3", tables.BUCKETS)
    held = {r.repo_id: r.id for r in tables.load_index(spark, root, schema).collect()}
    assert held == {**{r: i for i, r in rows}, "o/7": "new"}
    tables.delete_index(spark, root, spark.createDataFrame([(f"o/{i}",) for i in range(0, 200, 2)], "repo_id string"), schema)
    tables.vacuum_index(spark, root, keep=1)
    assert sorted(r.repo_id for r in tables.load_index(spark, root, schema).collect()) == sorted(f"o/{i}" for i in range(1, 200, 2))
    assert len(os.listdir(f"{root}/manifests")) <= 2


def test_missing_repositories_are_built_and_stored(spark, tmp_path):
    from corpusloom.operators import index

    root = str(tmp_path / "index")
    schema = StructType.fromDDL("id string, repo_id string")
    tables.save_index(spark.createDataFrame([("old", "a")], schema), root)
    files = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "c")], schema)
    asked = []

    def build(missing):
        asked.append(sorted(r.repo_id for r in missing.collect()))
        return missing

    for _ in range(2):
        got = sorted((r.repo_id, r.id) for r in index.index_build_missing(spark, root, files, build, schema).collect())
        assert got == [("a", "old"), ("b", "y"), ("c", "z")]
    assert asked == [["b", "c"], []]


def test_urls(spark):
    urls = ["git@github.com:o/r.git", " https://github.com/o/r.git ", "https://github.com/o/r/tree/main", "https://example.org/o/r"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] and tuple(r[0]) for r in df.select(tx.repo_owner_name(F.col("u"))).collect()]
    assert got == [("o", "r"), ("o", "r"), ("o", "r"), None]
    strict = df.unionByName(spark.createDataFrame([("github.com/o/r.git?x=1",)], "u string"))
    got = [r[0] and tuple(r[0]) for r in strict.select(tx.repo_owner_name_strict(F.col("u"))).collect()]
    assert got == [None, ("o", "r.git "), ("o", "r"), None, ("o", "r.git?x=1")]


def test_token_estimate_counts_utf16_units(spark):
    df = spark.createDataFrame([("abcde",), ("",), ("😀😀é",)], "t string")
    assert [r[0] for r in df.select(tx.estimate_tokens(F.col("t"))).collect()] == [2, 0, 2]


def test_review_json(spark):
    raws = ['x {"summary": "s", "improvements": [{"file": "f"}]} y', "{bad}", "{bad", '{"summary": "No major issues", "improvements": [{"file": "f"}]}', '{"summary": "s"}']
    df = review.reviews(spark.createDataFrame([(r,) for r in raws], "raw string"))
    rows = df.collect()
    assert [r.parsed.outcome for r in rows] == ["parsed", "bad_json", "no_json", "parsed", "parsed"]
    assert [r.no_change for r in rows] == [False, True, True, True, True]
    assert rows[2].parsed.raw_response == "{bad" and rows[1].parsed.priority == "low"
    assert rows[3].review.summary.startswith("No improvements required")


def test_run_status(spark):
    rows = [("a", 0, 0, 0, 0), ("b", 1, 1, 0, 0), ("c", 1, 0, 0, 0), ("d", 1, 1, 1, 0), ("e", 1, 0, 2, 1)]
    df = spark.createDataFrame(rows, "repo_id string, n_files int, n_fixes int, n_improvements int, n_changes int")
    assert [r.status for r in review.run_status(df).collect()] == [
        "no_files_found", "syntax_fixes_only", "no_improvements", "no_changes", "success",
    ]


def test_last_change_wins_and_new_files_appear(spark, files):
    rows = [("o/r", 1, "a.js", "one", "d1"), ("o/r", 2, "a.js", "two", "d2"), ("o/r", 3, "new.js", "n", "d3")]
    chg = spark.createDataFrame(rows, "repo_id string, ord int, file string, content string, description string")
    got = {r.path: (r.content, r.modified) for r in changes.apply_changes(files({"a.js": "", "b.js": "b"}), chg).collect()}
    assert got == {"a.js": ("two", True), "b.js": ("b", False), "new.js": ("n", True)}


def test_memory_keeps_the_newest_fifty(spark):
    old = spark.createDataFrame([("k", i) for i in range(50)] + [("other", 0)], "repo_id string, ord long")
    new = spark.createDataFrame([("k", 50)], "repo_id string, ord long")
    kept = memory.append(old, new)
    assert sorted(r.ord for r in kept.filter("repo_id = 'k'").collect()) == list(range(1, 51))
    assert [r.ord for r in memory.newest(kept.filter("repo_id = 'k'")).orderBy("rank").collect()] == [50, 49, 48]
    assert memory.clear(kept, new).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    source, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), tmp_path / "cp"
    batches = [[("a", 3 * b + i) for i in range(3)] + [("b", b)] for b in range(11)]
    everything = None
    held = lambda: sorted(tuple(r) for r in read_memory(spark, table, everything.schema, keep=5).collect())
    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "repo_id string, ord long").coalesce(1)
        part.write.mode("append").parquet(source)
        everything = part if everything is None else everything.unionByName(part)
        run = lambda: start_memory_stream(
            spark.readStream.schema(part.schema).parquet(source), table, str(checkpoint), keep=5, merge_every=3
        ).awaitTermination()
        run()
        want = sorted(tuple(r) for r in memory.newest(everything, n=5).drop("rank").collect())
        assert held() == want
        # Forget that the batch was done: it runs again, merges again, and nothing changes.
        for name in (f"{n}", f".{n}.crc"):
            (checkpoint / "commits" / name).unlink(missing_ok=True)
        run()
        assert held() == want
    folders = sorted(os.listdir(table))
    assert len([f for f in folders if f.startswith("batch=")]) <= 5 and [f for f in folders if f.startswith("base=")] == ["base=5", "base=8"][-2:]


def test_same_result_for_any_shuffle_width(spark):
    from corpusloom.plans.catalog import QUERIES

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, QUERIES["typo_dedup"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_reports_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    given = spark.createDataFrame([("o/r", i, f"f{i}.js", "Tidy") for i in range(6)] + [(None, 9, "g.js", "Lost")], "repo_id string, ord long, file string, description string")
    changes = given.withColumn("description", read("description"))
    fixes = given.select("repo_id", "ord", read("file").alias("path"), F.array(F.struct(F.lit("comma").alias("type"), F.lit(None).cast("string").alias("description"))).alias("fixes"))
    asked = spark.createDataFrame([("o/r", '{"summary": "Tidy up", "improvements": [{"file": "a"}], "priority": "high"}')], "repo_id string, raw string")
    report = review.review_report(review.reviews(asked.withColumn("raw", read("raw"))), changes, fixes).collect()
    assert seen.value == 15
    rows = {(r.repo_id, r.section, r.n): r.text for r in report}
    assert len(rows) == len(report) == 17 and "Repaired 6 files" in rows["o/r", 2, 0] and "Repaired 1 file " in rows[None, 2, 0]
    assert rows["o/r", 3, 6] == "6. **f5.js**\n   - comma" and rows["o/r", 5, 1] == "1. **f0.js**\n   - Tidy"
    assert rows["o/r", 1, 0].startswith("## Code Analysis\n\nTidy up\n\n**Priority:** high")

    lines = review.change_report(changes, given.select("repo_id")).collect()
    assert seen.value == 22 and len(lines) == 7


def test_entries_get_their_own_vectors_and_those_that_stay_keep_theirs(spark, tmp_path):
    from corpusloom.operators import index

    root, schema = str(tmp_path / "index"), StructType.fromDDL("id string, text string, embedding array<float>, repo_id string")
    make = lambda rows: spark.createDataFrame(rows, "id string, text string, repo_id string")
    first = [(str(i), "x" * i, f"o/{i % 150}") for i in range(400)]
    index.save_entries(make(first), root, schema, lambda c: F.array(F.length(c).cast("float")))
    index.save_entries(make([("new", "abc", "o/7"), ("null", "n", None)]), root, schema, lambda c: F.array(F.lit(-1.0).cast("float")))
    found = {r.id: (r.text, r.embedding, r.repo_id) for r in tables.load_index(spark, root, schema).collect()}
    assert found == {
        **{i: (t, [float(len(t))], r) for i, t, r in first if r != "o/7"}, "new": ("abc", [-1.0], "o/7"), "null": ("n", [-1.0], None)
    }


def test_vectors_are_made_after_the_exchange(spark, monkeypatch):
    """What is written into buckets gets its vectors in the tasks that write, so the exchange and the sort are without them."""
    from corpusloom.plans import catalog

    writer, plans = type(spark.range(1).write), []
    write = writer.parquet

    def noted(self, path, *args, **kwargs):
        if "bucket" in self._df.columns:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", noted)
    assert catalog.QUERIES["index_build_missing"](spark, "/root/testdata/sf0.001").count() > 0
    made = [p for p in plans if "ArrowEvalPython" in p]
    assert len(made) == 2 and all(p.index("ArrowEvalPython") < p.index("Sort") < p.index("Exchange") for p in made)
