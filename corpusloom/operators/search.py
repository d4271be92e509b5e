"""Exact top-k cosine search of many queries over a partitioned index, without pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom import fixed
from corpusloom.functions.vectors import embed_text
from corpusloom.operators.ranking import top_n
from corpusloom.session import stored

# Query vectors up to this size travel to the tasks that scan the index; larger sets meet it tile by tile.
MAX_BLOCK_BYTES = 8 * 1024 * 1024
# Index rows and queries of a tile, queries that are scored at once, and index rows of a scan that meet the queries at once.
TILE_ROWS, TILE_QUERIES, CHUNK, SCAN_ROWS = 1 << 18, 1 << 17, 256, 4096
# Bytes of packed vectors on either side of a tile, and rows whose packed size is looked at.
TILE_BYTES, SIZED_ROWS = 32 * 1024 * 1024, 1000
# Rows that share a bound, numbers that put a row beside others like it, blocks that give a query its first threshold, and rows
# below which all are scored.
BOUND_ROWS, BOUND_KEYS, FIRST_BLOCKS, FEW_ROWS = 16, 5, 8, 1024
# Rows of a matrix, and pairs of a block and a query that are scored at once.
MATRIX_ROWS, PAIRS = 8192, 4096
# More than the error of a bound in single precision: 384 * 2 ** -24 times the root of BOUND_ROWS.
SLACK = 1e-4


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    lengths = vectors.value_lengths()
    if len(vectors) and (lengths.null_count or pc.min_max(lengths) != pa.scalar({"min": dim, "max": dim}, pa.struct([("min", lengths.type), ("max", lengths.type)]))):
        raise ValueError("vectors must have the same length")
    return np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), dim)


def _unit(m: np.ndarray) -> np.ndarray:
    """The rows of ``m``, which is overwritten, at length 1; a thousand rows at a time, so that no second matrix is needed."""
    for at in range(0, len(m), 1024):
        some = m[at : at + 1024]
        norms = np.sqrt((some * some).sum(axis=1, keepdims=True))
        np.divide(some, norms, out=some, where=norms > 0)
    return m


class _Dense:
    """Unit vectors in a matrix."""

    def __init__(self, units: np.ndarray):
        self.units = units

    def nearest(self, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` of ``rows`` for the unit vectors ``queries``: places in ``rows``, query numbers and scores, in order."""
        return _top(self.units[rows], queries, k)


def _top(units: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    for at in range(0, len(queries), CHUNK):
        scores = np.round(units @ queries[at : at + CHUNK].T, 9) + 0.0
        if len(units) > k:
            row, col = np.nonzero(scores >= np.partition(scores, len(units) - k, axis=0)[len(units) - k])
        else:
            row, col = (x.ravel() for x in np.indices(scores.shape))
        row, col, value = _first(row, col, scores[row, col], k)
        found.append((row, at + col, value))
    return tuple(np.concatenate(x) for x in zip(*found))


def _first(row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest values of each column, the lower row first among equals."""
    ranked = np.lexsort((row, -value, col))
    row, col, value = row[ranked], col[ranked], value[ranked]
    keep = _place(col) < k
    return row[keep], col[keep], value[keep]


def _place(groups: np.ndarray) -> np.ndarray:
    """The number of each element within its group; groups lie together."""
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.r_[start, len(groups)]))


def _spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` numbers from each of ``starts`` on."""
    return np.repeat(starts - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)


_RECORD = np.dtype([("at", "<i4"), ("value", "<f8")])


def _pack(vectors: pa.Array) -> pa.Array:
    """Each vector as records of what isn't zero, behind one that has its length, -1 for none."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.array(vectors.flatten(), dtype=np.float64)
    many = np.maximum(lengths, 0)
    filled = np.flatnonzero(flat)
    owner = np.repeat(np.arange(len(lengths)), many)[filled]
    ends = np.cumsum(np.bincount(owner, minlength=len(lengths)) + 1)
    records = np.zeros(len(filled) + len(lengths), _RECORD)
    head = np.zeros(len(records), bool)
    head[np.r_[0, ends[:-1]][: len(lengths)]] = True
    records["at"][head] = lengths
    records["at"][~head] = filled - (np.cumsum(many) - many)[owner]
    records["value"][~head] = flat[filled]
    offsets = np.r_[0, ends].astype(np.int32) * np.int32(_RECORD.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(records)])


def packed(vector: Column) -> Column:
    """A vector as bytes that grow with what isn't zero, without loss."""
    return F.arrow_udf("binary")(_pack)(vector)


class _Sparse:
    """Unit vectors of packed ones, as the places and values of what isn't zero."""

    def __init__(self, column: pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // _RECORD.itemsize
        records = np.frombuffer(data, _RECORD, ends[-1])[ends[0] :]
        head = np.zeros(len(records), bool)
        head[ends[:-1] - ends[0]] = True
        dims = records["at"][head]
        self.dim = int(dims[0])
        if (dims != self.dim).any() or self.dim < 0:
            raise ValueError("vectors must have the same length")
        self.starts = ends - ends[0] - np.arange(len(ends))
        self.at, value = records["at"][~head], records["value"][~head]
        owner = np.repeat(np.arange(len(column)), np.diff(self.starts))
        self.value = value / np.sqrt(np.bincount(owner, value * value, len(column)))[owner]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def some(self, rows: np.ndarray) -> _Sparse:
        """These rows in this order."""
        out = object.__new__(_Sparse)
        many = np.diff(self.starts)[rows]
        places = _spread(self.starts[:-1][rows], many)
        out.dim, out.starts, out.at, out.value = self.dim, np.r_[0, np.cumsum(many)], self.at[places], self.value[places]
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def dense(self) -> np.ndarray:
        units = np.zeros((len(self), self.dim))
        units[self.owner(), self.at] = self.value
        return units

    def nearest(self, rows: np.ndarray, queries: _Sparse, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of :class:`_Dense`, for ``queries`` of the same kind.

        Rows that are alike lie in blocks, and the highest value of each number in a block bounds the score of all of its rows.
        The best bounds give a query its first threshold; rows of other blocks are scored only where the bound reaches it.
        Where bounds leave too much, as for vectors without zeros, all rows are scored.
        """
        own = self.some(rows)
        if len(own) <= max(FEW_ROWS, k) or len(own.at) * 4 > len(own) * own.dim:
            return _all(own, queries, k)
        bounds = _Bounds(own)
        found = []
        for at in range(0, len(queries), CHUNK):
            row, col, value = bounds.nearest(queries.some(np.arange(at, min(at + CHUNK, len(queries)))), k)
            found.append((row, at + col, value))
        return tuple(np.concatenate(x) for x in zip(*found))


def _all(rows: _Sparse, queries: _Sparse, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows are scored, some thousands at a time."""
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(rows), MATRIX_ROWS):
        units = rows.some(np.arange(at, min(at + MATRIX_ROWS, len(rows)))).dense()
        found = [best]
        for start in range(0, len(queries), MATRIX_ROWS):
            asked = queries.some(np.arange(start, min(start + MATRIX_ROWS, len(queries)))).dense()
            row, col, value = _top(units, asked, k)
            found.append((at + row, start + col, value))
        best = _first(*(np.concatenate(x) for x in zip(*found)), k)
    return best


class _Bounds:
    """Rows in blocks of those that are alike, with the highest and lowest value of each number in a block."""

    def __init__(self, rows: _Sparse):
        owner, common = rows.owner(), np.bincount(rows.at, minlength=rows.dim)
        # Rows side by side that share their largest numbers, the more common one first among equals.
        heavy = np.lexsort((rows.at, -common[rows.at], -np.abs(rows.value), owner))
        place = _place(owner)
        keys = np.full((len(rows), BOUND_KEYS), -1)
        first = place < BOUND_KEYS
        keys[owner[first], place[first]] = rows.at[heavy][first]
        self.order = np.lexsort((np.arange(len(rows)), *keys.T[::-1]))
        self.given, self.rows = rows, rows.some(self.order)
        blocks = -(-len(rows) // BOUND_ROWS)
        block = self.rows.owner() // BOUND_ROWS
        self.high, self.low = np.zeros((blocks, rows.dim), np.float32), np.zeros((blocks, rows.dim), np.float32)
        np.maximum.at(self.high, (block, self.rows.at), self.rows.value.astype(np.float32))
        np.minimum.at(self.low, (block, self.rows.at), self.rows.value.astype(np.float32))
        self.signed = bool((self.rows.value < 0).any())

    def nearest(self, queries: _Sparse, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked = queries.dense()
        bound = np.maximum(asked, 0).astype(np.float32) @ self.high.T
        if self.signed:
            bound += np.minimum(asked, 0).astype(np.float32) @ self.low.T
        blocks = bound.shape[1]
        best = np.argpartition(bound, blocks - FIRST_BLOCKS, axis=1)[:, blocks - FIRST_BLOCKS :]
        row, col, value = self._scores(best.ravel(), np.repeat(np.arange(len(asked)), FIRST_BLOCKS), asked)
        table = np.full((len(asked), max(k, FIRST_BLOCKS * BOUND_ROWS)), -np.inf)
        table[col, _place(col)] = value
        least = np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k]
        near = ~(bound < (least - SLACK).astype(np.float32)[:, None])
        np.put_along_axis(near, best, False, axis=1)
        who, where = np.nonzero(near)
        # A number of a row costs about as much as a whole row in a product of matrices.
        if len(who) * BOUND_ROWS * len(self.rows.at) > len(asked) * len(self.rows) ** 2:
            return _all(self.given, queries, k)
        found = [(row, col, value)]
        for at in range(0, len(who), PAIRS):
            found.append(self._scores(where[at : at + PAIRS], who[at : at + PAIRS], asked, least))
        row, col, value = (np.concatenate(x) for x in zip(*found))
        kept = value >= least[col]
        return _first(self.order[row[kept]], col[kept], value[kept], k)

    def _scores(self, blocks: np.ndarray, who: np.ndarray, asked: np.ndarray, least: np.ndarray | None = None):
        """Scores of all rows of each block for a query; those below ``least`` of the query are left out."""
        begin = blocks * BOUND_ROWS
        many = np.minimum(begin + BOUND_ROWS, len(self.rows)) - begin
        row, col = _spread(begin, many), np.repeat(who, many)
        filled = self.rows.starts[row + 1] - self.rows.starts[row]
        places = _spread(self.rows.starts[row], filled)
        pair = np.repeat(np.arange(len(row)), filled)
        products = self.rows.value[places] * asked[col[pair], self.rows.at[places]]
        value = np.round(np.bincount(pair, products, len(row)), 9) + 0.0
        if least is None:
            return row, col, value
        kept = value >= least[col]
        return row[kept], col[kept], value[kept]


def _best(rows: pa.Table, units: _Dense | _Sparse, queries: np.ndarray | _Sparse, wanted: list, key: str | None, order: list[str], k: int):
    """Per query and key the ``k`` best rows: positions in ``rows``, query numbers, scores and ranks.

    Rows are sorted once by key and ``order``, so that a row's place settles ties; a partition per key finds the k-th score.
    """
    codes = (rows.column(key).combine_chunks() if key else pa.nulls(len(rows), pa.string())).dictionary_encode(null_encoding="encode")
    names = {v: i for i, v in enumerate(codes.dictionary.to_pylist())}
    sortable = pa.table({"_code": codes.indices, **{c: rows.column(c) for c in order}})
    place = pc.sort_indices(sortable, [("_code", "ascending"), *[(c, "ascending") for c in order]]).to_numpy()
    code = codes.indices.to_numpy()[place]
    everywhere = np.array([w is None for w in wanted], bool)
    own = np.array([-1 if w is None else names.get(w, -2) for w in wanted])
    cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    found = []
    for a, b in zip(cut[:-1], cut[1:]):
        asking = np.flatnonzero(everywhere | (own == code[a]))
        if len(asking):
            some = queries[asking] if isinstance(queries, np.ndarray) else queries.some(asking)
            row, col, value = units.nearest(place[a:b], some, k)
            found.append((place[a + row], asking[col], value, _place(col) + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows_of(index: pa.Table, vector: str, queries: pa.Table, rows, query, score, rank) -> pa.Table:
    kept = index.drop_columns([vector]).take(pa.array(rows))
    asked = queries.take(pa.array(query))
    ids = asked.column("query_id").cast(pa.string())
    return pa.Table.from_arrays(
        [ids, *asked.drop_columns(["query_id"]).columns, *kept.columns, pa.array(score), pa.array(rank.astype(np.int32))],
        ["query_id", *[c for c in asked.column_names if c != "query_id"], *kept.column_names, "similarity", "rank"],
    )


def _hits(index: pa.Table, queries: pa.Table, vector: str, key: str | None, order: list[str], k: int) -> pa.Table:
    """The best rows of ``index`` for each of ``queries(query_id, vector, scope)``."""
    dim = len(queries.column("vector")[0])
    asked = _unit(_matrix(queries.column("vector").combine_chunks(), dim))
    units = _Dense(_unit(_matrix(index.column(vector).combine_chunks(), dim)))
    found = _best(index, units, asked, queries.column("scope").to_pylist(), key, order, k)
    return _rows_of(index, vector, queries.drop_columns(["vector", "scope"]), *found)


def _tile_hits(index: pa.Table, queries: pa.Table, key: str | None, order: list[str], k: int) -> pa.Table:
    """As :func:`_hits` with packed vectors, for queries of one scope; equal vectors are looked up once."""
    units, codes = _Sparse(index.column("_packed")), queries.column("_packed").combine_chunks().dictionary_encode()
    asked = _Sparse(pa.chunked_array([codes.dictionary]))
    if asked.dim != units.dim:
        raise ValueError("vectors must have the same length")
    row, asking, score, rank = _best(index, units, asked, [queries.column("scope")[0].as_py()] * len(asked), key, order, k)
    by = np.argsort(asking, kind="stable")
    row, asking, score, rank = row[by], asking[by], score[by], rank[by]
    codes = codes.indices.to_numpy()
    first, many = np.searchsorted(asking, codes), np.searchsorted(asking, codes, "right") - np.searchsorted(asking, codes)
    at = _spread(first, many)
    return _rows_of(index, "_packed", queries.drop_columns(["_packed", "scope"]), row[at], np.repeat(np.arange(len(codes)), many), score[at], rank[at])


def _scan(index: DataFrame, queries: pa.Table, schema: str, *how) -> DataFrame:
    """The index meets all queries, some Arrow batches at a time; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if waiting and (batch is None or sum(b.num_rows for b in waiting) + batch.num_rows > SCAN_ROWS):
                yield from _hits(pa.Table.from_batches(waiting), queries, *how).to_batches()
                waiting = []
            if batch is not None and batch.num_rows:
                waiting.append(batch)

    return index.mapInArrow(run, schema)


def _tiles(index: DataFrame, queries: DataFrame, scoped: bool, schema: str, vector: str, key: str | None, order: list[str], k: int) -> DataFrame:
    """Index and queries in hash blocks; each pair of blocks is a tile of bounded size, scored by one task.

    Scoped queries only meet blocks of their own key: the tiles of a key are its row blocks times its query blocks, so a
    key with a third of all rows is many tiles.  Vectors are shuffled packed.  Where no key has a second block of rows, a tile
    has all hits of its queries, and nothing is shuffled behind it.
    """
    by = ["_scope"] if scoped else []
    rows = index.withColumn("_packed", packed(F.col(vector))).drop(vector)
    rows = rows.withColumn("_scope", F.col(key)) if scoped else rows
    asked = queries.withColumn("_packed", packed(F.col("vector"))).drop("vector")
    asked = asked.withColumn("_scope", F.col("scope").cast("string")) if scoped else asked
    blocks = lambda df, size, name: df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(rows, _tile_rows(rows, TILE_ROWS), "_m"), blocks(asked, _tile_rows(asked, TILE_QUERIES), "_n")
    sizes = stored(sizes[0].join(sizes[1], by) if by else sizes[0].crossJoin(sizes[1]), "sizes")  # one row each
    deal = lambda df, on, mine, others, i, j: (
        (df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes)))
        .withColumn(i, F.pmod(F.xxhash64(*on), F.col(mine)).cast("int"))
        .withColumn(j, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        .drop("_m", "_n")
    )
    tile = [*by, "_i", "_j"]
    left = deal(rows, order, "_m", "_n", "_i", "_j").groupBy(*tile)
    right = deal(asked, ["query_id"], "_n", "_m", "_j", "_i").groupBy(*tile)

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(some: pa.Table, asking: pa.Table) -> pa.Table:
        return _tile_hits(some.drop_columns(tile), asking.drop_columns(tile), key, order, k) if len(some) and len(asking) else empty

    hits = left.cogroup(right).applyInArrow(run, schema)
    most = sizes.agg(F.max("_m")).first()[0]
    return hits if most is None or most <= 1 else _top_hits(hits.drop("rank"), key, order, k)


def _tile_rows(df: DataFrame, most: int) -> int:
    """Rows that make up a tile's side, by the packed size of some."""
    sizes = [r["n"] for r in df.select(F.length("_packed").alias("n")).head(SIZED_ROWS)]
    return max(1, min(most, TILE_BYTES * len(sizes) // max(sum(sizes), 1))) if sizes else most


def _top_hits(scored: DataFrame, key: str | None, order: list[str], k: int) -> DataFrame:
    groups = ["query_id", key] if key else ["query_id"]
    return top_n(scored, groups, [F.col("similarity").desc(), *[F.col(c) for c in order]], k)


def vector_search(
    queries: DataFrame,
    index: DataFrame,
    k: int = fixed.TOP_K,
    vector: str = "embedding",
    key: str | None = "repo_id",
    order: tuple[str, ...] = ("entry_kind", "file", "ord"),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best ``k`` rows per query, or per query and ``key``, by cosine similarity; exact, ties go by ``order``.

    ``queries(query_id, vector[, scope])``; a query with a ``scope`` only looks at rows of that key.  No pair of rows ever
    leaves a task: matrix products give back at most ``k`` rows per query and key, without vectors, and the group limit
    before the shuffle cuts again.  A set of up to ``MAX_BLOCK_BYTES`` travels to the tasks that scan the index.  Larger sets
    and the index are cut into blocks; scoped queries only meet the blocks of their key.  Hits have the columns of the index
    but its vector, and those of the queries that are named in ``carry``.
    """
    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.lit(None).cast("string"))
    kept = [f for f in index.schema.fields if f.name != vector]
    carried = queries.select(*carry).schema.fields
    typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in (*carried, *kept)]
    schema = ", ".join(["query_id string", *typed, "similarity double", "rank int"])
    how = (vector, key, list(order), k)
    one = queries.select(F.size("vector").alias("dim")).first()
    if one is None:
        return index.sparkSession.createDataFrame([], schema)
    queries = queries.select("query_id", *carry, "vector", "scope")
    size = queries.agg(F.count("*").alias("n"), F.count("scope").alias("scoped")).first()
    if size["n"] * one["dim"] * 8 <= MAX_BLOCK_BYTES:
        return _top_hits(_scan(index, queries.toArrow(), schema, *how).drop("rank"), key, list(order), k)
    parts = []
    if size["scoped"] and key:
        parts.append(_tiles(index, queries.filter("scope IS NOT NULL"), True, schema, *how))
    if size["n"] > size["scoped"]:
        parts.append(_tiles(index, queries.filter("scope IS NULL"), False, schema, *how))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def text_queries(spark, texts: dict[str, str]) -> DataFrame:
    """Query table from a few named texts."""
    rows = spark.createDataFrame(list(texts.items()), "query_id string, query_text string")
    return with_vectors(rows)


def with_vectors(rows: DataFrame, text: str = "query_text") -> DataFrame:
    return rows.withColumn("vector", embed_text(F.col(text)))


def similar_query(name: Column) -> Column:
    return F.concat(F.lit(fixed.SIMILAR_QUERY_PREFIX), name)


def similar_symbols(names: DataFrame, index: DataFrame, k: int = fixed.SIMILAR_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """Entries close to ``names(query_id, name[, scope])``, found by a fixed query sentence."""
    return vector_search(with_vectors(names.withColumn("query_text", similar_query(F.col("name"))))
                         .drop("name", "query_text"), index, k, carry=carry)


def centroids(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Mean vector per key in one aggregation with map-side partial sums, no explode."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)]
    return vectors.groupBy(key).agg(*means).select(key, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("vector"))


def hits_by_file(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "repo_id"), file: str = "file") -> DataFrame:
    return hits.groupBy(*keys, file).agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))


def rank_files(grouped: DataFrame, n: int = fixed.CONTEXT_FILES, keys: tuple[str, ...] = ("query_id", "repo_id")) -> DataFrame:
    """Files by number of hits, best hit first among equals."""
    return top_n(grouped, list(keys), [F.col("hits").desc(), F.col("best_rank")], n, "file_rank")
