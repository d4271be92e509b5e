"""Runs of repeating words: blocks are convolved with the words after them, and the distances of exact matches seed runs.

A run is a stretch of words with smallest period q (words q apart are identical) of at least ``max(LEAST_WORDS, POWERS * q)``
words that no neighbouring word extends. At scale L = 1, 2, 4, ... the texts of a piece lie in blocks of L words. A run of
period q, L <= q < 2L, holds two whole neighbouring blocks that recur q words later. The sum of squared differences between a
block and each place in the window L to 2L - 1 words on is the block's squares plus the place's squares minus twice a
correlation, which a number-theoretic transform gives in exact integers modulo a prime. A zero is a place without mismatch.
Distances at which neighbouring blocks agree are extended word by word; that also throws out a sum that is zero only modulo
the prime. By Fine and Wilf's theorem equal stretches are one run and the smallest distance is its period.

Two things keep this near linear: a block is convolved only if each of its words recurs within 2L words, and not if block and
window lie inside of a known run with a period of at most L / 2, where all distances are multiples of it.

Documents are independent: one narrow pass, no shuffle. A piece holds about ``PIECE_WORDS`` words of whole texts; one longer
text is a piece of its own, so memory follows the longest text.

Edge cases: a null text has no word; texts without a run have an empty list, and their collapsed text is their words joined by
one space. Repeated rows and null ids are rows of their own. Other columns of ``docs`` stay as they are, except columns named
like the results, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.llm.common import SPACE_CLASS, SPACES, text_or_empty

LEAST_WORDS, POWERS = 6, 4
PIECE_WORDS = 1 << 18
#: Numbers that are transformed at once.
_ROOM = 1 << 19
#: 15 * 2**27 + 1, with 31 as a generator: transforms of up to 2**27 numbers, products below 2**62.
_P = np.uint64(2013265921)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_FIELDS = ("start", "length", "period")
RUNS = ArrayType(StructType([StructField(f, LongType()) for f in _FIELDS]))
_RUN_TYPE = pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of a primitive n-th root of one."""
    p = int(_P)
    root = pow(31, (p - 1) // n, p)
    if inverse:
        root = pow(root, p - 2, p)
    out = np.ones(max(1, n // 2), np.uint64)
    done, step = 1, root
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(step) % _P
        done, step = done * 2, step * step % p
    return out


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row; the length is a power of two (Stockham's order, no bit reversal)."""
    m, n = rows.shape
    roots = _roots(n, inverse)
    x, half, width = rows % _P, n // 2, 1
    while half:
        x = x.reshape(m, 2, half, width)
        a, b = x[:, 0], x[:, 1]
        out = np.empty((m, half, 2, width), np.uint64)
        out[:, :, 0] = (a + b) % _P
        out[:, :, 1] = (a + (_P - b)) % _P * roots[:: width][:half, None] % _P
        x, half, width = out, half // 2, width * 2
    x = x.reshape(m, n)
    return x * np.uint64(pow(n, int(_P) - 2, int(_P))) % _P if inverse else x


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences modulo the prime of each block (m x L) and the L places in its window (m x 2L)."""
    size = blocks.shape[1]
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    shared = transform(transform(turned) * transform(windows) % _P, inverse=True)[:, :size]
    squares = np.cumsum(windows * windows % _P, axis=1)
    place = squares[:, size - 1 : 2 * size - 1].copy()
    place[:, 1:] -= squares[:, : size - 1]
    own = (blocks * blocks % _P).sum(1)[:, None]
    return (own + place + 2 * (_P - shared)) % _P


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Distance to the next equal word; more than all words if there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, 4 * n + 4, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _zeros(ids: np.ndarray, gap: np.ndarray, size: int, known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(distance, block) of the zero-mismatch occurrences at scale ``size``, sorted by distance, then block."""
    n = len(ids)
    count = n // size
    alive = gap[: count * size].reshape(count, size).max(1) < 2 * size
    inside = np.zeros(count + 1, np.int64)
    long = [(s, e, q) for s, e, q in known if 2 * q <= size and e - s >= 2 * size]
    for s, e, _ in long:
        first, last = -(-s // size), (e - 3 * size) // size
        if last >= first:
            inside[first] += 1
            inside[last + 1] -= 1
    alive &= np.cumsum(inside[:-1]) == 0
    pair = np.zeros(count, bool)
    pair[:-1] |= alive[1:]
    pair[1:] |= alive[:-1]
    blocks = np.flatnonzero(alive & pair)
    padded = np.concatenate((ids, -1 - np.arange(3 * size, dtype=np.int64) + int(_P))).astype(np.uint64)
    found = []
    step = max(1, _ROOM // (2 * size))
    for at in range(0, len(blocks), step):
        start = blocks[at : at + step] * size
        left = padded[start[:, None] + np.arange(size)]
        right = padded[start[:, None] + size + np.arange(2 * size)]
        row, place = np.nonzero(mismatches(left, right) == 0)
        found.append(np.stack((place + size, blocks[at : at + step][row])))
    distance, block = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    keep = (block * size + size + distance) <= n
    for s, e, q in long:
        begin = block * size
        keep &= ~((begin >= s) & (begin + distance + size <= e) & (distance % q == 0))
    distance, block = distance[keep], block[keep]
    order = np.lexsort((block, distance))
    return distance[order], block[order]


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a sequence of integers; none is longer than ``longest``."""
    n, size = len(ids), 1
    gap = _next_same(ids) if n else ids
    known: dict[tuple[int, int], int] = {}
    while POWERS * size <= longest:
        distance, block = _zeros(ids, gap, size, [(s, e, q) for (s, e), q in known.items()])
        cut = np.flatnonzero((np.diff(distance) != 0) | (np.diff(block) != 1)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(block)]))
        for a, b in zip(starts.tolist(), ends.tolist()):
            d = int(distance[a]) if b > a else 0
            if b - a < 2 or (b - a + 2) * size <= (POWERS - 1) * d:
                continue
            low = max(0, (int(block[a]) - 1) * size)
            high = min(n - d, (int(block[b - 1]) + 2) * size)
            equal = np.concatenate(([False], ids[low:high] == ids[low + d : high + d], [False]))
            edges = np.flatnonzero(equal[1:] != equal[:-1])
            for s, e in (edges.reshape(-1, 2) + low).tolist():
                if e - s + d >= max(LEAST_WORDS, POWERS * d):
                    known.setdefault((s, e + d), d)
        size *= 2
    return sorted((s, e, q) for (s, e), q in known.items())


def _piece(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], str]]:
    """Runs and collapsed text of each text; texts are joined with words that occur once, so no run crosses them."""
    numbers: dict = {}
    ids: list[int] = []
    for k, words in enumerate(texts):
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        ids.append(numbers.setdefault(k, len(numbers)))
    at = np.cumsum([0] + [len(w) + 1 for w in texts])
    runs = find_runs(np.array(ids, np.int64), max(map(len, texts)))
    k, by_text = 0, [[] for _ in texts]
    for s, e, q in runs:
        while s >= at[k + 1]:
            k += 1
        by_text[k].append((s - int(at[k]), e - int(at[k]), q))
    for words, own in zip(texts, by_text):
        kept = np.ones(len(words), bool)
        for s, e, q in own:
            kept[s + q : e] = False
        left = words if kept.all() else [w for w, k in zip(words, kept) if k]
        yield [{"start": s, "length": e - s, "period": q} for s, e, q in own], b" ".join(left).decode()


def _detect(batches: Iterator[pa.RecordBatch], column: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, piece, held = [], [], 0
        for text in batch.column(column):
            words = _WORD.findall((text.as_py() or "").encode())
            if piece and held + len(words) > PIECE_WORDS:
                done += _piece(piece)
                piece, held = [], 0
            piece.append(words)
            held += len(words) + 1
        done += _piece(piece)
        runs = pa.array([r for r, _ in done], _RUN_TYPE)
        yield pa.RecordBatch.from_arrays([*batch.columns, runs, pa.array([t for _, t in done], pa.string())], names)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns runs (sorted by start, then period) and collapsed, the text without repetitions: words that a
    run holds after its first period are gone, the others are joined by one space."""
    kept = docs.drop("runs", "collapsed")
    at, names = kept.columns.index(text), [*kept.columns, "runs", "collapsed"]
    schema = StructType([*kept.schema.fields, StructField("runs", RUNS), StructField("collapsed", StringType())])
    return kept.mapInArrow(lambda batches: _detect(batches, at, names), schema)


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic texts among them, for measuring: every tenth document by the hash of its id repeats a part of
    its words up to the end. Let h be the CRC-32 of the decimal id and g = h // 10. If h is divisible by ten, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id changes nothing."""
    words = F.split(F.btrim(text_or_empty(), F.lit(SPACES)), f"{SPACE_CLASS}+")
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("words")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.floor((n - a) / (3 + g % 8)) + 1
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get("words", (a + i % p).cast("int")))
    periodic = F.array_join(F.concat(F.slice("words", 1, a.cast("int")), again), " ")
    bare = F.btrim(text_or_empty(), F.lit(SPACES)) != ""
    parts = docs.select("doc_id", "text", F.when(bare & (h % 10 == 0), words).alias("words"))
    return parts.select("doc_id", F.when(F.col("words").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document: n_runs, the run with the greatest length / period, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    more = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(x, y), y).otherwise(x))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
