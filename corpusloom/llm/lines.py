"""Line dedup: hashes of lines sorted over ranges by document and position; first occurrences are streamed.

A line's key is the line stripped of white space with A-Z lower-cased. Lines whose key has at least ``least`` code points and
is held by at least two documents stay only in the document with the smallest id. (hash, document, position) rows are dealt by
ranges of all three, so one very frequent line spreads over many tasks. A task streams its sorted rows: a row of another
document than the first of its hash goes. Only the first hash of a range may have begun in an earlier range; its rows are
settled by the first documents of the other ranges. The result is a compressed bitmap per document, not text.

Edge cases: null and empty texts are one empty line. A null doc_id comes before all others and counts as one document. Rows
with one doc_id are one document: their lines never drop each other; equal rows get equal bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, saved, text_or_empty

LEAST_KEY = 10


def _keyed(least: int):
    """Rows (h1, h2, doc_id, row, pos) of the lines of (doc_id, row, text) that may be dropped, 65,536 at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, places = [], [], []

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            own = pa.array(at, pa.int64())
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(own), batch.column(1).take(own), pa.array(places, pa.int32())]
            for held in (hashes, at, places):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, _STREAM[1:])

        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                for pos, line in enumerate(text.as_py().split("\n")):
                    key = line.strip(SPACES)
                    if len(key) >= least:
                        hashes.append(hashlib.sha256(key.encode().lower()).digest()[:16])  # of bytes, lower() changes A-Z only
                        at.append(i)
                        places.append(pos)
                        if len(at) == 1 << 16:
                            yield flush(batch)
            if at:
                yield flush(batch)

    return run


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of each line that may be dropped; (h1, h2) is the first half of a SHA-256 of the key.

    The rows are stored, since dealing them by ranges reads them twice.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("row"), text_or_empty().alias("text"))
    return saved(texts.mapInArrow(_keyed(least), "h1 long, h2 long, doc_id long, row long, pos int"), "occurrences")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by hash, document and position: rows to drop, rows left open, and each range's first documents.

    kind 0: drop. kind 1: open, goes if an earlier range has its hash with a smaller document. kind 2: (hash, document) of the
    first document of the range's first and last hash.
    """
    opening = last = None
    for batch in batches:
        h1, h2, doc, row, pos = batch.columns
        a, b = h1.to_numpy(), h2.to_numpy()
        d = doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        n = len(a)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if last is not None and last[:2] == (a[0], b[0]):
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(start >= 0, d[start], last[2] if last is not None else d[0])
        if opening is None:
            opening = (a[0], b[0], d[0])
        last = (a[-1], b[-1], first[-1])
        drop = d != first
        pending = ~drop & (a == opening[0]) & (b == opening[1])
        for kind, held in ((0, drop), (1, pending)):
            if held.any():
                keep = pa.array(held)
                columns = [x.filter(keep) for x in (h1, h2, doc, row, pos)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(held.sum()), kind, np.int32)), *columns], _STREAM)
    if opening is not None:
        ends = {opening[:2]: opening[2], last[:2]: last[2]} | {opening[:2]: opening[2]}
        h = np.array([list(k) for k in ends], np.int64)
        ids = [None if x == -(2**63) else int(x) for x in ends.values()]
        blank = [None] * len(ids)
        columns = [pa.array([2] * len(ids), pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(blank, pa.int64()), pa.array(blank, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, _STREAM)


_STREAM = ["kind", "h1", "h2", "doc_id", "row", "pos"]


def drops(docs: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """(doc_id, row, pos) of each line that goes; ``row`` is a hash of the document's text."""
    order = ["h1", "h2", F.col("doc_id").asc_nulls_first(), "row", "pos"]
    dealt = occurrences(docs, least).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = saved(dealt.mapInArrow(_stream, "kind int, h1 long, h2 long, doc_id long, row long, pos int"), "line_stream")
    low = F.coalesce("doc_id", F.lit(-(2**63)))
    firsts = saved(streamed.where("kind = 2").groupBy("h1", "h2").agg(F.min(low).alias("first")), "line_firsts")
    settled = streamed.where("kind = 1").join(firsts, ["h1", "h2"]).where(low > F.col("first"))
    return streamed.where("kind = 0").select("doc_id", "row", "pos").unionByName(settled.select("doc_id", "row", "pos")).distinct()


def pack_bitmap(n_lines: int, dropped: np.ndarray | list) -> bytes:
    """Deflated bits, one per line, 1 for a line that stays."""
    keep = np.ones(-(-n_lines // 8) * 8, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """(doc_id, row, n_dropped, bitmap) of the documents that lose lines; a document that isn't listed keeps all."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(2).to_pylist()
            packed = [pack_bitmap(n, x) for n, x in zip(batch.column(3).to_pylist(), lost)]
            counts = pa.array([len(x) for x in lost], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(packed, pa.binary())], ["doc_id", "row", "n_dropped", "bitmap"])

    grouped = drops(docs, least).groupBy("doc_id", "row").agg(F.collect_list("pos").alias("lost"), (F.max("pos") + 1).alias("n"))
    return grouped.mapInArrow(bitmaps, "doc_id long, row long, n_dropped long, bitmap binary")


def kept_lines(docs: DataFrame, bitmaps: DataFrame, text: str = "kept_text") -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and ``text``, the lines that stay joined by a line feed."""
    marks = bitmaps.select(F.col("doc_id").alias("_ld_id"), F.col("row").alias("_ld_row"), F.col("n_dropped").alias("_ld_n"), "bitmap")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_ld_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_ld_row"))
    joined = docs.join(marks.withColumnRenamed("bitmap", "_ld_bitmap"), same, "left")

    @F.pandas_udf("string")
    def keep(texts, packed):
        def one(t: str | None, p: bytes | None) -> str:
            lines = (t or "").split("\n")
            if p is None:
                return t or ""
            bits = np.unpackbits(np.frombuffer(zlib.decompress(p), np.uint8)).astype(bool)[: len(lines)]
            return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])

        return pd.Series([one(t, p) for t, p in zip(texts, packed)], dtype=object)

    n_lines = F.size(F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)).cast("long")
    return joined.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce("_ld_n", F.lit(0)).cast("long"), text: keep(docs["text"], F.col("_ld_bitmap"))}).drop("_ld_id", "_ld_row", "_ld_n", "_ld_bitmap")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; ``n_chars`` follows the text."""
    done = kept_lines(docs, saved(keep_bitmaps(docs), "bitmaps"), "_ld_kept")
    return done.select(*(F.col("_ld_kept").alias("text") if c == "text" else F.length("_ld_kept").cast("long").alias("n_chars") if c == "n_chars" else done[c] for c in docs.columns))
