"""Packing into sequences: bounded-space online best fit, a fixed number of open bins in a bitset keyed by free space.

Pieces arrive in groups by a hash, the longest of a group first. A piece goes to the open bin with the least free space that it fits in; if none does, a
new bin opens, and if all bins are open the fullest closes first. Tasks pack ranges of hashes on their own. Bins that are
still open when a task ends are given back, and their pieces are packed again by fewer tasks, until one task is left.

A document's ids are those of the tokenizer and an end id. Only longer ones are cut; all pieces but the first are full.

Edge cases: null counts as empty and gives the end id alone. Rows are independent, so repeated rows are packed as often as
they come.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved

SIZE, END = 1024, 2
#: Open bins of a task, and the pieces of a group.
OPEN_BINS, GROUP = 4096, 4096
#: Pieces that one task of the first round packs, about; the next rounds have this many times fewer tasks.
TASK_PIECES, FEWER = 20_000, 8
#: Fixed value: how a byte-level vocabulary splits a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: White space in a row from which the fast split isn't used.
LONG_RUN = 1 << 16
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit numbers, from a file of ranks.

    The rank file holds the same vocabulary as the JSON file of the tokenizers library and gives the same ids, several times
    faster. The name of the end of a text, where a text contains it, is one id, as it is there. The split needs a stack as deep
    as a run of white space is long, so texts with runs of ``LONG_RUN`` or more are encoded from the JSON file beside it.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path.replace(".tiktoken", ".json"))

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.encoding.encode(text, allowed_special="all") if SPECIAL in text else self.encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, copy[, ids]): the pieces of each row; ``copy`` tells rows apart.

    ``tokenizer`` is the path of a rank file that every executor has.
    """
    names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = encoder.encode(text or "") + last
                n = len(ids) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row = [doc, copy, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]]
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(cut, schema)


class OpenBins:
    """Open bins by free space: a bit is set if a bin with that much space is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.bits, self.made = size, most, 0, 0, 0
        self.by_space: dict[int, deque[int]] = {}

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        out = bins.popleft()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            into = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            into, space = self.made, self.size
            self.made += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, deque()).append(into)
            self.bits |= 1 << left
            self.open += 1
        return into, self.size - space

    def roomy(self, least: int) -> list[int]:
        """Open bins with at least so much free space."""
        return sorted(b for space, bins in self.by_space.items() if space >= least for b in bins)


_SCHEMA = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, reopened boolean"


def _round(rows: DataFrame, count: int, tasks: int, number: int, size: int, open_bins: int) -> DataFrame:
    """Pack ``count`` rows in ``tasks`` tasks. Besides the placed pieces, a row with ``reopened`` for each bin that is given back."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        bins = OpenBins(size, open_bins)
        for batch in batches:
            at = [bins.place(x) for x in batch.column(4).to_pylist()]
            ids, offsets = pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, offsets, pa.array([False] * len(at))], names)
        back = bins.roomy(size // 16) if tasks > 1 else []
        blank = [pa.nulls(len(back), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        ids = pa.array([base + b for b in back], pa.int64())
        yield pa.RecordBatch.from_arrays([*blank, ids, pa.nulls(len(back), pa.int64()), pa.array([True] * len(back), pa.bool_())], names)

    by = F.xxhash64("doc_id", "copy", "piece", F.lit(number))
    rows = rows.select(*names[:6])
    group = F.pmod(F.shiftright(by, 16), F.lit(-(-count // (tasks * GROUP)) or 1))
    dealt = rows.repartition(tasks, by).sortWithinPartitions(group, F.desc("length"), by, "doc_id", "copy", "piece")
    return saved(dealt.mapInArrow(pack, _SCHEMA), "packed")


def packed(rows: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset. ``rows`` must be stored, since every round reads it again."""
    count, number, out = rows.count(), 0, None
    tasks = -(-count // task_pieces) or 1
    while True:
        done = _round(rows, count, tasks, number, size, open_bins)
        back = saved(done.where("reopened").select("sequence_id"), "reopened")
        placed = done.where("not reopened").drop("reopened")
        final = placed.join(back, "sequence_id", "left_anti").select(*placed.columns)
        out = final if out is None else out.unionByName(final)
        if tasks == 1:
            return out
        rows = saved(placed.join(back, "sequence_id", "left_semi"), "again")
        count, tasks, number = rows.count(), -(-tasks // FEWER), number + 1


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    return packed(saved(pieces(docs, tokenizer, size, end), "pieces"), size, open_bins).drop("copy")
