"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard.

A document is the weighted set of its five-word shingles (words by white space, A-Z lower-cased; fewer than five words make
one shingle). The weight is count x idf. With ``common=None``, as the queries have it, idf is ln(documents / documents with the
shingle) of every shingle, over ln(documents), which changes no similarity and gives 1 to what one document has. Documents are
dealt to chunks of bounded size; a chunk's shingles go to ranges of hashes, where all documents are counted, and the counts
above 1 go back to the chunk. So no list of shingles is held whole anywhere.

With a share ``common``, idf saturates: 1 for every shingle in at most that share of all documents, less for more frequent
ones. So at most 10 x (mean shingles of a document) shingles have an idf below 1, however large the corpus is; summaries of the
tasks find them, a second pass counts them exactly, and they may be broadcast.

Equal sets are folded first. Signatures of the others are cut into bands; rows that share a band hash form a bucket. Each
bucket compares all rows with one leader; then the rows outside of the bucket's largest class with all rows of the bucket,
unless a bound on their similarity rules a link out. That finds the links between different classes without all pairs of a
group, and of the pairs that share a bucket none is dropped by chance. Comparisons read stored sets of hashed shingles, not
texts.

Edge cases: null or empty texts are one class. Rows of one doc_id are one node. A row without doc_id takes part as a copy of
equal texts only; its class is null if no equal text has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.common import saved
from corpusloom.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Share of documents from which a shingle counts as common.
COMMON = 0.1
#: Bits of the marks that bound a similarity before two sets are compared.
MARKS = 2048
#: Bytes of text in a chunk of documents, and shingles of all chunks in a range of hashes.
CHUNK_BYTES, RANGE_SHINGLES = 1 << 23, 1 << 21

_SLOTS = 1 << 16


def _gamma_table(seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return -np.log((1 - rng.random(_SLOTS)) * (1 - rng.random(_SLOTS)))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, shingle, row, count, rows) of each piece of a text column."""
    for first, data, at in tokens.pieces(column):
        yield first, *tokens.counted(*tokens.shingles(*tokens.words(data, at), n)), len(at) - 1


def _summary(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: add ``more`` keys, then take the largest count that must go from all; that count comes third."""
    every = np.concatenate([keys, *more])
    keys, inverse = np.unique(every, return_inverse=True)
    counts = np.bincount(inverse, np.append(counts, np.ones(len(every) - len(counts), np.int64)), len(keys)).astype(np.int64)
    cut = 0
    if len(keys) > size:
        cut = int(np.partition(counts, len(keys) - size - 1)[len(keys) - size - 1])
        keys, counts = keys[counts > cut], counts[counts > cut] - cut
    return keys, counts, cut


def common_shingles(docs: DataFrame, n: int = WORDS, common: float = COMMON) -> dict[int, float]:
    """idf of the shingles that more than ``common`` of the documents hold; all others have 1. Bounded, see above.

    What a share of all documents holds, that share of some task's documents holds. So a task sends only shingles that may be
    common among its own documents, at most 14 times its mean set, from a summary that loses a known number of each count. A
    second pass counts what was sent exactly.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, held, rows, total, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0, 0, 0
        size = 1 << 12
        for batch in batches:
            for _, shingle, _, _, some in _sets(batch.column(0), n):
                rows += some
                total += len(shingle)
                waiting.append(shingle)
                held += len(shingle)
                size = max(size, int(4 * total / max(rows, 1) / common))
                if held > 4 * size:
                    keys, counts, cut = _summary(keys, counts, waiting, size)
                    lost, waiting, held = lost + cut, [], 0
        keys, counts, cut = _summary(keys, counts, waiting, size)
        likely = counts + lost + cut > common * rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(keys[likely].view(np.int64)), pa.nulls(int(likely.sum()), pa.int64())], ["shingle", "rows"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows])], ["shingle", "rows"])

    found = docs.select("text").mapInArrow(candidates, "shingle long, rows long")
    found = found.groupBy("shingle").agg(F.sum("rows").alias("rows")).collect()
    rows = sum(r["rows"] or 0 for r in found)
    wanted = np.sort(np.array([r["shingle"] for r in found if r["shingle"] is not None], np.int64).view(np.uint64))
    if not len(wanted):
        return {}

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, shingle, _, _, _ in _sets(batch.column(0), n):
                at = np.minimum(np.searchsorted(wanted, shingle), len(wanted) - 1)
                counts += np.bincount(at[wanted[at] == shingle], minlength=len(wanted))
        held = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[held].view(np.int64)), pa.array(counts[held])], ["shingle", "n"])

    counts = docs.select("text").mapInArrow(exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] % 2**64: float(np.log(rows / r["n"]) / np.log(1 / common)) for r in counts.where(F.col("n") > common * rows).collect()}


class _Idf:
    """Weights from the idf of some shingles; all others have 1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @classmethod
    def of(cls, idf: dict[int, float]) -> _Idf:
        return cls(np.fromiter(idf.keys(), np.uint64, len(idf)), np.fromiter(idf.values(), np.float64, len(idf)))

    def weights(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = count.astype(np.float64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingle), len(self.keys) - 1)
            out *= np.where(self.keys[at] == shingle, self.values[at], 1.0)
        return np.maximum(out, 1e-9)  # a shingle that all documents hold still tells an empty text from others


def dealt(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text, chunk, bytes): rows in chunks of about ``size`` bytes; one longer text is a chunk of its own."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            chunks = np.empty(len(sizes), np.int64)
            for i, n in enumerate(sizes.to_numpy()):
                if held and held + n > size:
                    chunk, held = chunk + 1, 0
                chunks[i] = chunk
                held += n + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks), sizes], ["doc_id", "text", "chunk", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return saved(rows.mapInArrow(deal, "doc_id long, text string, chunk long, bytes long"), "dealt")


def shared_shingles(chunks: DataFrame, n: int = WORDS, size: int = RANGE_SHINGLES) -> tuple[DataFrame, int]:
    """(chunk, shingles, counts): for each chunk its shingles that more than one document holds, with how many do, and the
    number of all documents. Counts are exact; a range of hashes gets about ``size`` shingles, however often copies repeat."""
    total = chunks.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    ranges = int((total["bytes"] or 0) / 6 / size) + 1
    edges = np.array([k * 2**64 // ranges for k in range(ranges)], np.uint64)

    def parts(key: pa.Array, keys: np.ndarray, counts: np.ndarray, cut: np.ndarray, names: list[str]) -> pa.RecordBatch:
        cut = pa.array(cut.astype(np.int32))
        lists = pa.ListArray.from_arrays(cut, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(counts.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*key, *lists], [*names, "shingles", "counts"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = [], None

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            return parts([pa.array(np.arange(ranges)), pa.array(np.full(ranges, last))], keys, counts, cut, ["range", "chunk"])

        for batch in batches:
            chunk = batch.column(1).to_numpy()
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            for s, e in zip(first, np.append(first[1:], len(chunk))):
                if found and chunk[s] != last:
                    yield flush()
                last = int(chunk[s])
                found += [shingle for _, shingle, _, _, _ in _sets(batch.column(0).slice(s, e - s), n)]
        if found:
            yield flush()

    def counted(table: pa.Table) -> pa.Table:
        shingles, counts = table["shingles"].combine_chunks(), table["counts"].combine_chunks()
        keys, inverse = np.unique(shingles.flatten().to_numpy().view(np.uint64), return_inverse=True)
        held = np.bincount(inverse, counts.flatten().to_numpy(), len(keys)).astype(np.int64)[inverse]
        often = held > 1
        kept = np.append(0, np.cumsum(often))[np.append(0, np.cumsum(pc.list_value_length(shingles).to_numpy()))]
        back = parts([table["chunk"].combine_chunks()], shingles.flatten().to_numpy()[often], held[often], kept, ["chunk"])
        return pa.Table.from_batches([back])

    schema = "shingles array<long>, counts array<int>"
    found = chunks.select("text", "chunk").mapInArrow(sent, f"range long, chunk long, {schema}").where(F.size("shingles") > 0)
    back = found.groupBy("range").applyInArrow(counted, f"chunk long, {schema}").where(F.size("shingles") > 0)
    return saved(back, "shared_shingles"), total["rows"]


def _with_idf(chunks: DataFrame, shared: DataFrame, rows: int, make: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make(ids, texts, idf)`` of the rows (id, text, chunk), chunk by chunk, with the idf of the chunk's shingles."""

    def of_chunk(texts: pa.Table, known: pa.Table) -> pa.Table:
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in known[c].chunks)])
        held = flat("counts", np.int32)
        idf = _Idf(flat("shingles", np.int64).view(np.uint64), np.log(rows / held) / np.log(rows) if len(held) else held.astype(np.float64))
        return pa.Table.from_batches([made for b in texts.to_batches() for made in make(b.column(0), b.column(1), idf)], names)

    names = _arrow_schema(schema)
    return chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(of_chunk, schema)


def _samples(shingle: np.ndarray, weight: np.ndarray, start: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Consistent weighted samples: for each set and hash function the (element, level) with the smallest draw.

    The draws follow r, c ~ Gamma(2, 1), beta ~ U(0, 1), taken from tables by the bits of a hash of the element; with
    t = floor(ln w / r + beta) the value is ln a = ln c - r (t - beta) - r. Sets collide with their weighted Jaccard similarity.
    """
    r_table, c_table = _gamma_table(1).astype(np.float32), np.log(_gamma_table(2)).astype(np.float32)
    log_w = np.log(weight).astype(np.float32)
    odd_at = np.flatnonzero(log_w)
    log_w = log_w[odd_at]
    out = np.empty((len(start), n), np.uint32)
    odd = tokens.mix(np.arange(skip + 1, skip + n + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(n):
        h = shingle * odd[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        r = r_table[(h >> np.uint64(48)).astype(np.int32)]
        c = c_table[((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)]
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        value = c - r + r * beta  # where ln w = 0, t = floor(beta) = 0
        if len(odd_at):
            r, c, beta = r[odd_at], c[odd_at], beta[odd_at]
            t = np.floor(log_w / r + beta)
            value[odd_at] = c - r * (t - beta) - r
            h[odd_at] += t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = value.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        packed = (ordered << np.uint64(32)) | ((h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFF))
        out[:, i] = np.minimum.reduceat(packed, start).astype(np.uint32)
    return out


_SIGNED = "doc_id long, key binary, sig array<int>"
_HELD = "id long, shingles array<long>, weights array<double>, total double, held array<long>, heavy array<long>"


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _signed(ids: pa.Array, texts: pa.Array, idf: _Idf, n: int, samples: int) -> Iterator[pa.RecordBatch]:
    for first, shingle, row, count, rows in _sets(texts, n):
        sig = np.zeros((rows, samples), np.uint32)
        keys = [b"\0" * 16] * rows
        if len(row):
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sig[row[start]] = _samples(shingle, idf.weights(shingle, count), start, samples)
            both = np.column_stack((shingle, count.astype(np.uint64)))
            for s, e in zip(start, np.append(start[1:], len(row))):
                keys[row[s]] = hashlib.blake2b(both[s:e].tobytes(), digest_size=16).digest()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * samples), pa.array(sig.ravel().view(np.int32)))
        yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(keys, pa.binary()), flat], schema=_arrow_schema(_SIGNED))


def signatures(docs: DataFrame, idf: dict[int, float], n: int = WORDS, samples: int = BANDS * ROWS) -> DataFrame:
    """(doc_id, key, sig): ``key`` is equal for equal shingle sets, ``sig`` has one integer per hash function."""
    known = _Idf.of(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _signed(batch.column(0), batch.column(1), known, n, samples)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SIGNED)


def _bits(row: np.ndarray, shingle: np.ndarray, rows: int) -> pa.Array:
    marks = np.zeros((rows, MARKS), np.uint8)
    marks[row, (shingle >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64)] = 1
    packed = np.packbits(marks, axis=1).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (MARKS // 64)), pa.array(packed))


def _held(ids: pa.Array, texts: pa.Array, idf: _Idf, n: int) -> Iterator[pa.RecordBatch]:
    for first, shingle, row, count, rows in _sets(texts, n):
        weight, cut = idf.weights(shingle, count), np.searchsorted(row, np.arange(rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(shingle.view(np.int64)))
        heavy = [None if (weight[s:e] == 1).all() else weight[s:e] for s, e in zip(cut[:-1], cut[1:])]
        total = pa.array(np.bincount(row, weight, rows) if len(row) else np.zeros(rows))
        full, firm = _bits(row, shingle, rows), _bits(row[weight >= 1], shingle[weight >= 1], rows)
        columns = [ids.slice(first, rows), lists, pa.array(heavy, pa.list_(pa.float64())), total, full, firm]
        yield pa.RecordBatch.from_arrays(columns, schema=_arrow_schema(_HELD))


def weighted_sets(texts: DataFrame, idf: dict[int, float], n: int = WORDS) -> DataFrame:
    """(id, shingles, weights, total, held, heavy) of (id, text), sorted by shingle; weights are null where all are 1.

    ``held`` has a bit for the first bits of each shingle, ``heavy`` for those of weight 1 or more.
    """
    known = _Idf.of(idf)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _held(batch.column(0), batch.column(1), known, n)

    return texts.select("id", "text").mapInArrow(sets, _HELD)


def _marks(sets: DataFrame, node: str, end: str) -> DataFrame:
    return sets.select(F.col("id").alias(node), *(F.col(c).alias(f"{c}_{end}") for c in ("total", "held", "heavy")))


def _may_reach(x: str, y: str, least: float) -> Column:
    """False only for pairs whose similarity is below ``least``: a heavy mark that the other set lacks takes at least 1 from what
    both share, since all shingles behind it are missing there."""
    needed = least / (1 + least) * (F.col(f"total_{x}") + F.col(f"total_{y}")) - 1e-6
    reaches = lambda a, b: F.col(f"total_{a}") - sum(
        (F.bit_count(F.col(f"heavy_{a}")[i].bitwiseAND(F.bitwise_not(F.col(f"held_{b}")[i]))) for i in range(MARKS // 64)), F.lit(0)
    ) >= needed
    return (F.least(F.col(f"total_{x}"), F.col(f"total_{y}")) >= needed) & reaches(x, y) & reaches(y, x)


def _slices(shingles: pa.Array, weights: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    at, values = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(np.uint64)
    heavy_at, heavy = weights.offsets.to_numpy(), weights.values.to_numpy()
    plain = weights.is_null().to_numpy(zero_copy_only=False)
    return [
        (values[s:e], np.ones(e - s) if p else heavy[hs:he])
        for s, e, hs, he, p in zip(at[:-1], at[1:], heavy_at[:-1], heavy_at[1:], plain)
    ]


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted shingles, weights)."""
    (kx, wx), (ky, wy) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    shared = 0.0
    if len(kx):
        at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
        same = np.flatnonzero(ky[at] == kx)
        shared = float(np.minimum(wx[same], wy[at[same]]).sum())
    rest = float(wx.sum() + wy.sum()) - shared
    return shared / rest if rest else 1.0


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The stored pairs (a, b) whose similarity is ``least`` or more; of an id with several texts, the nearest counts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_slices(batch.column(2), batch.column(3)), _slices(batch.column(4), batch.column(5)))
            near = pa.array([similarity(x, y) >= least for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    end = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"shingles_{x}"), F.col("weights").alias(f"weights_{x}"))
    both = pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", "shingles_a", "weights_a", "shingles_b", "weights_b")
    return saved(both.mapInArrow(compare, "a long, b long").distinct(), "links")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for end in "ab":
        known = comps.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
        pairs = pairs.join(known, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    return pairs.where("comp_a != comp_b").select("a", "b")


def _weighing(docs: DataFrame, n: int, samples: int, common: float | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The signatures of ``docs``, and a function that gives the weighted sets of the documents with some ids."""
    as_id = F.col("doc_id").cast("long").alias("id")
    if common is not None:
        idf = common_shingles(docs, n, common)
        return signatures(docs, idf, n, samples), lambda ids: weighted_sets(docs.select(as_id, "text").join(ids, "id", "left_semi"), idf, n)
    chunks = dealt(docs)
    shared, total = shared_shingles(chunks, n)
    texts = chunks.select(as_id, "text", "chunk")
    return (
        _with_idf(texts, shared, total, lambda ids, column, idf: _signed(ids, column, idf, n, samples), _SIGNED),
        lambda ids: _with_idf(texts.join(ids, "id", "left_semi").select("id", "text", "chunk"), shared, total, lambda i, column, idf: _held(i, column, idf, n), _HELD),
    )


def classes(
    docs: DataFrame, n: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, common: float | None = COMMON
) -> DataFrame:
    """(doc_id, class_id, class_size, kept): one row per document; ``class_id`` is the smallest doc_id of its class.

    ``common=None`` weighs every shingle by its idf; a share weighs alike what at most that share of the documents holds.
    """
    signed, sets_of = _weighing(docs, n, bands * rows, common)
    signed = saved(signed, "signatures")
    sets = saved(signed.groupBy("key").agg(F.min("doc_id").alias("node")), "sets")
    nodes = signed.join(sets, "key").where(F.col("doc_id") == F.col("node")).select("node", "sig").dropDuplicates(["node", "sig"])
    nodes = saved(nodes, "nodes")

    hashes = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *(F.col("sig")[b * rows + k] for k in range(rows))).alias("bucket")) for b in range(bands)]
    banded = nodes.select("node", F.explode(F.array(*hashes)).alias("h")).select("node", "h.band", "h.bucket")
    # The leader is the row that shares most band hashes with others: of a text and its edited copies, the text itself, which
    # is nearer to each copy than the copies are to each other.
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.max("node").alias("last"), F.min("node").alias("first"))
    buckets = saved(buckets.where("first < last").select("band", "bucket", "n"), "buckets")
    shared = saved(banded.join(buckets, ["band", "bucket"]), "shared")
    weights = shared.groupBy("node").agg(F.sum("n").alias("central"))
    ordered = shared.join(weights, "node").select("band", "bucket", F.struct("central", F.bitwise_not("node").alias("node")).alias("rank"))
    leaders = saved(ordered.groupBy("band", "bucket").agg(F.max("rank").alias("rank")), "leaders")
    leaders = leaders.select("band", "bucket", "rank.central", F.bitwise_not("rank.node").alias("leader"))
    members = saved(shared.select("band", "bucket", "node").join(leaders, ["band", "bucket"]), "members")
    pairs = saved(members.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b"), "central").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    held = saved(sets_of(ids).dropDuplicates(["id", "shingles"]), "candidate_sets")  # only these move more than once

    # Each row meets the most central of its leaders first. Its other leaders matter only if they are of another class then,
    # and if the marks allow a link; so the sets of most rows move once, not once for each band.
    best = pairs.groupBy("b").agg(F.max(F.struct("central", F.bitwise_not("a").alias("a"))).alias("top"))
    best = saved(best.select(F.bitwise_not("top.a").alias("a"), "b"), "best")
    links = _links(best, held, least)
    comps = components(links)
    rest = _apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    rest = rest.join(_marks(held, "a", "a"), "a").join(_marks(held, "b", "b"), "b")
    rest = saved(rest.where(_may_reach("a", "b", least)).select("a", "b").distinct(), "rest")
    links = links.unionByName(_links(rest, held, least))
    comps = components(links)

    # What a leader didn't join: rows outside of the largest class of their bucket against all rows of the bucket, where
    # the marks allow a link.
    placed = members.join(comps, "node", "left").select("band", "bucket", "node", F.coalesce("comp", "node").alias("comp"))
    placed = saved(placed, "placed")
    sizes = placed.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band", "bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"))
    main = saved(main.where("comps > 1").select("band", "bucket", F.col("top.comp").alias("main")), "mixed")
    mixed = placed.join(main, ["band", "bucket"])
    mixed = mixed.join(nodes.select("node", F.transform(F.array(*hashes), lambda h: h["bucket"]).alias("all")).dropDuplicates(["node"]), "node")
    mixed = saved(mixed.join(_marks(held, "node", "y"), "node"), "mixed_rows")
    odd = mixed.where("comp != main").select(
        "band", "bucket", F.col("node").alias("x"), F.col("comp").alias("comp_x"), F.col("all").alias("all_x"), *(F.col(f"{c}_y").alias(f"{c}_x") for c in ("total", "held", "heavy"))
    )
    # Each pair once: in the first bucket that both share, and of two rows outside of the largest class by the smaller one.
    earlier = [F.when((F.col("band") > b) & (F.col("all")[b] == F.col("all_x")[b]), 1).otherwise(0) for b in range(bands)]
    once = (sum(earlier, F.lit(0)) == 0) & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("node")))
    close = odd.join(mixed, ["band", "bucket"]).where((F.col("comp") != F.col("comp_x")) & once & _may_reach("x", "y", least))
    close = close.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = _links(saved(close, "pairs"), held, least)
    comps = components(links.unionByName(more))

    by_set = saved(sets.join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("class_id")), "by_set")
    placed = saved(signed.select("doc_id", "key").join(by_set, "key").select("doc_id", "class_id"), "classes")
    counts = saved(placed.groupBy("class_id").agg(F.count("*").alias("class_size")), "class_sizes")
    counts = counts.select(F.col("class_id").alias("c"), "class_size")
    return placed.join(counts, F.col("class_id").eqNullSafe(F.col("c"))).select(
        "doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, common: float | None = COMMON) -> DataFrame:
    """The rows of ``docs`` whose document stands for its class; rows without a class stay."""
    gone = classes(docs, common=common).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
