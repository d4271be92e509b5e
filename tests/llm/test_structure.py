"""Conversation trie, lattice hashing and runs of repeating words against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import lattice, periodic, trie
from corpusloom.llm.common import prepared
from corpusloom.llm.queries import ORACLES

# Runs of repeating words


def _runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def test_transform_round_trip_and_mismatches():
    rng = np.random.default_rng(5)
    for size in (1, 2, 8, 64):
        x = rng.integers(0, 2013265921, (3, 2 * size)).astype(np.uint64)
        assert (periodic.transform(periodic.transform(x), inverse=True) == x).all()
        blocks, windows = rng.integers(0, 40, (5, size)), rng.integers(0, 40, (5, 2 * size))
        expected = [[((b - w[k : k + size]) ** 2).sum() for k in range(size)] for b, w in zip(blocks, windows)]
        assert (periodic.mismatches(blocks.astype(np.uint64), windows.astype(np.uint64)) == np.array(expected)).all()


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_match_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 9:
                a, p = rng.randrange(len(words)), rng.randint(1, 14)
                for i in range(a + p, min(len(words), a + rng.randint(1, 99))):
                    words[i] = words[i - p]
        assert periodic.find_runs(np.array(words, np.int64), len(words)) == _runs(words)


def test_long_periodic_texts_stay_linear():
    for words in ([7] * 200_000, [i % 999 for i in range(200_000)], ([1] * 500 + [2]) * 300):
        runs = periodic.find_runs(np.array(words, np.int64), len(words))
        assert (0, len(words), {7: 1, 0: 999, 1: 501}[words[0]]) in runs


DOCS = "doc_id long, text string, runs string, collapsed string, words string, best string"


def _periodic_rows():
    rng = random.Random(11)
    texts = ["a b c " * 9, "x " * 6, "x " * 5, "x y " * 4, "", None, " \n\t", "é è " * 5 + "tail", "A a " * 30 + "b " * 7, "one\x0btwo three\x0c" * 8, "w " * 3000]
    texts += [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts.append(" ".join(str(rng.randrange(5000)) for _ in range(20000)))
    return [(i, t, "r", "c", "w", "b") for i, t in enumerate(texts)] + [(None, "z " * 9, "r", "c", "w", "b"), (0, texts[0], "r", "c", "w", "b"), (-7, "k l " * 8, "r", "c", "w", "b")]


def _expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(words) if n < 5000 else None
    if runs is None:  # brute force over all periods is slow: only the last stretch can repeat in this fixture
        runs = periodic.find_runs(np.unique(words, return_inverse=True)[1].astype(np.int64), n)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2])) if runs else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return doc_id, len(runs), *top, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_periodic_query_matches_plain_python(spark):
    rows = _periodic_rows()
    docs = prepared(spark).createDataFrame(rows, DOCS).repartition(3)
    got = Counter(map(tuple, periodic.digests(periodic.with_runs(periodic.rewritten(docs))).collect()))
    assert got == Counter(_expected_runs(i, t) for i, t, *_ in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows if i is not None)


def test_runs_keep_other_columns(spark):
    rows = _periodic_rows()[:5]
    found = periodic.with_runs(prepared(spark).createDataFrame(rows, DOCS))
    assert found.columns == ["doc_id", "text", "words", "best", "runs", "collapsed"]
    first = found.where("doc_id = 0").first()
    assert first.collapsed == "a b c" and [tuple(r) for r in first.runs] == [(0, 27, 3)]
    assert periodic.digests(periodic.with_runs(periodic.rewritten(prepared(spark).createDataFrame([], DOCS)))).collect() == []


# Lattice hashing


def test_decoded_points_are_nearest_lattice_points():
    rng = np.random.default_rng(2)
    y = rng.normal(0, 2, (400, 8))
    point = lattice.decode(y)
    whole = (point == np.rint(point)).all(1)
    assert ((point % 1 == 0.5).all(1) | whole).all() and (point.sum(1) % 2 == 0).all()
    around = point[:, None] + lattice._shortest()
    assert (((y - point) ** 2).sum(1) <= ((y[:, None] - around) ** 2).sum(2).min(1) + 1e-12).all()
    assert lattice._shortest().shape == (240, 8) and np.allclose((lattice._shortest() ** 2).sum(1), 2)


VECTORS = "vec_id long, embedding array<float>, label int, rid string, digest string, n string"


def _vectors():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x)
    rows, number = [], iter(range(10_000))
    add = lambda v, label: rows.append((next(number), v, label, "r", "d", "n"))
    for label in (1, 2, 3):
        for _ in range(60):
            add(rng.normal(size=64).tolist(), label)
    for label, members, noise in ((1, 120, 0.09), (2, 40, 0.12), (3, 15, 0.02)):
        centre = unit(rng.normal(size=64))
        for _ in range(members):
            add((rng.uniform(0.1, 9) * unit(centre + noise * unit(rng.normal(size=64)))).tolist(), label)
    chain, step = unit(rng.normal(size=64)), unit(rng.normal(size=64))
    for k in range(12):
        add(unit(chain + 0.15 * k * step).tolist(), 2)
    copy = rng.normal(size=64).tolist()
    for label in (1, 1, 1, 2, None):
        add(copy, label)
    add([x * 2 for x in copy], 1)
    add(copy[:63] + [copy[63] + 1e-3], 1)
    for bad in (None, [], [0.0] * 64, [None] + copy[1:], [float("nan")] + copy[1:], [float("inf")] + copy[1:]):
        add(bad, 1)
        add(bad, 1)
    add([1.0, 2.0], 1)
    add([2.0, 4.0], 1)
    add([2.0, 4.0], -1)
    rows.append((None, copy, 1, "r", "d", "n"))
    rows.append((3, copy, 1, "r", "d", "n"))
    return rows


def _linked(rows):
    fine = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and l is not None for _, v, l, *_ in rows]
    x = [np.array(v, np.float32).astype(float) if ok else None for (_, v, *_), ok in zip(rows, fine)]
    x = [v / np.linalg.norm(v) if v is not None else None for v in x]
    return {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.98}


@pytest.mark.parametrize("tile", [16, 512])
def test_near_vectors_match_brute_force(spark, tile):
    rows = _vectors()
    links = _linked(rows)
    root = list(range(len(rows)))
    for _ in root:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(rows[i][0])
    smallest = {r: min((v for v in ids if v is not None), default=None) for r, ids in least.items()}
    degree = Counter(i for i, _ in links)
    expected = Counter((r[0], degree[i], smallest[root[i]], r[0] is not None and r[0] == smallest[root[i]]) for i, r in enumerate(rows))
    df = prepared(spark).createDataFrame(rows, VECTORS).repartition(3)
    got = Counter(map(tuple, lattice.near_duplicates(df, tile=tile).collect()))
    missed = sum((expected - got).values())
    assert missed <= 0.01 * len(rows), (expected - got, got - expected)
    assert len(links) > 10_000 and sum(r[1] for r in got.elements()) >= 0.999 * len(links)
    assert all(g[1] <= max(e[1] for e in expected if e[0] == g[0]) for g in got)


def test_no_vectors(spark):
    assert lattice.near_duplicates(prepared(spark).createDataFrame([], VECTORS)).collect() == []


# Conversation trie


def test_z_fast_trie_finds_exit_nodes():
    rng = random.Random(4)
    for _ in range(200):
        paths = [[trie.ROOT] for _ in range(rng.randint(1, 40))]
        for p in paths:
            for _ in range(rng.randint(0, rng.choice([3, 30]))):
                p.append(hashlib.blake2b(p[-1] + bytes([rng.choice([0, 0, 0, 0, 1, 2])]), digest_size=trie.WIDTH).digest())
        built = trie.ZFastTrie()
        for k, p in enumerate(paths):
            built.insert(b"".join(p), list(range(1, len(p))), 1, k)
        rows = {r[0]: r for r in built.expanded()}
        members = defaultdict(list)
        for k, p in enumerate(paths):
            for d, x in enumerate(p):
                members[x, d, p[d - 1] if d else None].append(k)
        assert {(r[0], r[2], r[1]): (r[3], r[4], r[5]) for r in rows.values()} == {(x, d, up): (len(m), min(m), d) for (x, d, up), m in members.items()}
        for p in paths:
            assert built.exit_node(b"".join(p)).at(len(p) - 1) == p[-1]
        assert all(built.handles[n.at(trie._two_fattest(n.up, n.depth))] is n for n in built.compacted() if n.parent)


TURNS = "conv_id long, turn long, role string, text string, path string, size string, node string"


def _turns():
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), 71, 72, 1000, 1003, -4]:
        same = rng.random() < 0.5
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], "hello" if same and turn < 3 else f"t{rng.randrange(3)} é", "p", "s", "n"))
    rows += [(5, None, None, None, "p", "s", "n"), (6, 2, "user", "", "p", "s", "n"), (6, 2, "user", "", "p", "s", "n"), (None, 1, "user", "lost", "p", "s", "n")]
    rows += [(200 + k, t, "user", "same", "p", "s", "n") for k in range(0, 40, 5) for t in range(3)]
    rows += [(301, t, "user", "x" * 50_000 if t == 1 else f"deep {t}", "p", "s", "n") for t in range(300)]
    return rows


def _expected_nodes(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: trie.WIDTH]
            turns[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    prefixes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            prefixes[ts[:d]].append(c)
    children, below = Counter(p[:-1] for p in prefixes if p), defaultdict(list)
    for p in prefixes:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    cost = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in prefixes.items()}
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()
    return Counter(
        (min(m), len(p), min(prefixes[p[:-1]]) if p else None, len(m), children[p], sum(not children[x] for x in below[p]), sum(cost[x] for x in below[p]), ends(p, m))
        for p, m in prefixes.items()
    )


def test_conversation_nodes_match_brute_force(spark, monkeypatch):
    rows = _turns()
    df = prepared(spark).createDataFrame(rows, TURNS).repartition(4)
    monkeypatch.setattr(trie, "IDS", 3)
    got = Counter(map(tuple, trie.nodes(trie.rebuilt(trie.ordered_turns(df))).collect()))
    assert got == _expected_nodes(rows)


def test_small_tries_add_up():
    rows = [[trie.ROOT + bytes([k % 3]) * 16 + bytes([k % 3, k % 7]) * 8, [1, 2], 1, k] for k in range(50)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "sizes", "n", "conv_id"])
    before, trie.TRIE_BYTES = trie.TRIE_BYTES, 200
    try:
        out = [r for b in trie._partial_tries(iter([batch])) for r in b.to_pylist()]
    finally:
        trie.TRIE_BYTES = before
    assert sum(r["n"] for r in out if r["depth"] == 0) == 50 and sum(r["depth"] == 0 for r in out) > 5


def test_no_conversations(spark):
    empty = prepared(spark).createDataFrame([], TURNS)
    assert trie.nodes(trie.rebuilt(trie.ordered_turns(empty))).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_embedding_near_dedup"])
def test_sql_counterparts_on_fixtures(spark, name):
    """The registered SQL gives the same rows on the fixtures with edge cases."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    if name.startswith("op11"):
        frame = pd.DataFrame(_turns(), columns=["conv_id", "turn", "role", "text", "path", "size", "node"]).astype({"conv_id": "Int64", "turn": "Int64"})
        frame = frame[frame.conv_id != 301]
        con.register("conversations", frame)
        got = trie.nodes(trie.rebuilt(trie.ordered_turns(prepared(spark).createDataFrame([r for r in _turns() if r[0] != 301], TURNS))))
    else:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in _vectors()])
        got = lattice.near_duplicates(prepared(spark).createDataFrame(_vectors(), VECTORS))
    columns = got.columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
