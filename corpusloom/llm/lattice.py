"""Near-duplicate vectors by lattice hashing: projections are decoded to E8 points, cells and their neighbours are probed.

Vectors are compared only with vectors of the same label and length. Each of ``TABLES`` tables projects a unit vector by a
fixed Gaussian matrix to two blocks of eight coordinates and decodes each block to its nearest E8 lattice points: its own cell
and the ``PROBES - 1`` neighbouring cells that are nearest. Two vectors meet where they share a cell in both blocks of a table.
All vectors of a pair of cells are compared by cosine in double precision, so no pair below the threshold is linked. A pair at
0.98 shares a cell of a block with a chance of 0.94, hence both of a table's with 0.89; four tables miss about 1 in 6,000 such
pairs and fewer of the closer ones.

Rows and links stay few:

* Equal vectors (label and components) fold into one with a count first, by partial aggregation.
* Pairs of cells with one vector go before any vector moves; only (cell, row number) rows are counted for that.
* A pair of cells with more than ``TILE`` vectors is cut into tiles of two hash blocks each, so no task holds it whole. A tile
  gives one row per vector, a link count and the smallest vector it is connected to, never pairs. A pair that meets several
  times counts only in the first table and the smallest cells that it shares.

A group of m different vectors that are all near each other takes m * m / 2 cosines, since links have to be counted; its
vectors move m / ``TILE`` times.

Edge cases: a vector that is null, zero, empty, or holds a null or a non-finite component links with nothing, and so does a
null label. Every row is a vector of its own, also with a repeated or null vec_id; a component's id is its smallest vec_id that
is not null, and a row without a vec_id is never kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved
from corpusloom.llm.components import components
from corpusloom.llm.tokens import mix

LEAST_COSINE = 0.98
TABLES, PROBES = 4, 4
#: Vectors of a hash block, about; a tile compares two blocks.
TILE = 512
_SEED = 20240611


@cache
def projections(dim: int) -> np.ndarray:
    """Coordinates of all tables as a (dim, TABLES * 16) matrix, the same for every task."""
    return np.random.default_rng([_SEED, dim]).standard_normal((dim, TABLES * 16))


@cache
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, float)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and if the sum is odd round the worst coordinate the other way."""
    point = np.rint(y)
    off = y - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows with eight coordinates: the nearer of the nearest points of D8 and of D8 shifted by a half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where(((y - a) ** 2).sum(1, keepdims=True) <= ((y - b) ** 2).sum(1, keepdims=True), a, b)


def cells(y: np.ndarray) -> np.ndarray:
    """(rows, PROBES, 8): the own lattice point and the neighbours nearest to the coordinates."""
    own = decode(y)
    gain = (y - own) @ _shortest().T
    nearest = np.argsort(-gain, axis=1, kind="stable")[:, : PROBES - 1]
    return np.concatenate([own[:, None], own[:, None] + _shortest()[nearest]], axis=1)


def codes(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(rows, TABLES * 2 * PROBES) hashed cells of unit vectors; label, length, table and block are part of the hash."""
    n, dim = vectors.shape
    y = (vectors @ projections(dim)).reshape(n, TABLES, 2, 8)
    spread = lambda k, by: np.uint64(k * by & 0xFFFFFFFFFFFFFFFF)
    out = np.empty((n, TABLES, 2, PROBES), np.uint64)
    for t, b in product(range(TABLES), range(2)):
        twice = np.rint(2 * cells(y[:, t, b])).astype(np.int64).astype(np.uint64)
        h = np.repeat(mix(labels.astype(np.uint64) + spread((dim * TABLES + t) * 2 + b, 0x9E3779B97F4A7C15))[:, None], PROBES, 1)
        for k in range(8):
            h = mix(h ^ (twice[:, :, k] + spread(k + 1, 0xD1342543DE82EF95)))
        out[:, t, b] = h
    return out.reshape(n, -1).view(np.int64)


_CODED = "rid long, vec_id long, digest binary, vector array<double>, codes array<long>"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, vec_id, label, vector) with digest and codes; all three are null for a vector that links with nothing."""
    for batch in batches:
        rid, vec_id, label, vector = batch.columns
        digest, kept, found = ([None] * len(batch) for _ in range(3))
        at, length = vector.offsets.to_numpy(), np.where(vector.is_valid(), np.diff(vector.offsets.to_numpy()), 0)
        values = vector.values.to_numpy(zero_copy_only=False)
        labels = label.fill_null(0).to_numpy()
        length[~label.is_valid().to_numpy(zero_copy_only=False)] = 0
        for dim in np.unique(length[length > 0]).tolist():
            members = np.flatnonzero(length == dim)
            x = values[at[members][:, None] + np.arange(dim)]
            # Unit vectors come from vectors scaled by their greatest component, so that squares neither overflow nor vanish.
            top = np.abs(x).max(1)
            fine = np.isfinite(top) & (top > 0)
            members, x = members[fine], x[fine]
            if len(members):
                scaled = x / top[fine][:, None]
                hashed = codes(scaled / np.sqrt((scaled * scaled).sum(1))[:, None], labels[members])
                for i, v, h in zip(members.tolist(), x, hashed):
                    digest[i] = hashlib.blake2b(v.tobytes() + str(labels[i]).encode(), digest_size=16).digest()
                    kept[i], found[i] = v, h
        columns = [rid, vec_id, pa.array(digest, pa.binary()), pa.array(kept, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["rid", "vec_id", "digest", "vector", "codes"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first_meeting(a: np.ndarray, b: np.ndarray, t: int, c1: int, c2: int) -> np.ndarray:
    """True for each pair of code rows whose first table and smallest shared cells are (t, c1, c2)."""
    top = np.iinfo(np.int64).max
    first = np.ones(len(a), bool)
    for k in range(t + 1):
        low = []
        for block in range(2):
            at = slice((k * 2 + block) * PROBES, (k * 2 + block + 1) * PROBES)
            same = (a[:, at, None] == b[:, None, at]).any(2)
            low.append((np.where(same, a[:, at], top).min(1), same.any(1)))
        (low1, has1), (low2, has2) = low
        first &= (has1 & has2 & (low1 == c1) & (low2 == c2)) if k == t else ~(has1 & has2)
    return first


def _links(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of cosines of at least ``least``."""
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    scaled = lambda x: unit(x / np.abs(x).max(1, keepdims=True))
    return scaled(left) @ scaled(right).T >= least


def _tile(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile: rows with links, copies linked with each, and the smallest row that each is connected to."""
    t, c1, c2, low, high = (table.column(c)[0].as_py() for c in ("t", "c1", "c2", "low", "high"))
    rid, copies, block = (table.column(c).to_numpy() for c in ("rid", "copies", "block"))
    x, code = _matrix(table.column("vector").combine_chunks()), _matrix(table.column("codes").combine_chunks())
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    linked = _links(x[a], x[b], least)
    if low == high:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    i, j = a[i], b[j]
    own = np.concatenate([_first_meeting(code[i[k : k + 65536]], code[j[k : k + 65536]], t, c1, c2) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    i, j = i[own], j[own]
    n = np.bincount(i, copies[j], len(rid)) + np.bincount(j, copies[i], len(rid))
    root = rid.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            break
    held = np.flatnonzero(n)
    return rid[held], n[held].astype(np.int64), root[held]


_KEY = ["t", "c1", "c2", "low", "high"]


def _compare(least: float):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by tile; a tile's rows are held until the next one begins."""
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            keys = np.stack([rows.column(c).to_numpy() for c in _KEY])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(rows)]
            done = []
            for a, b in zip(cut, cut[1:]):
                if held and any(held[0].column(c)[0].as_py() != keys[k, a] for k, c in enumerate(_KEY)):
                    done.append(_tile(pa.concat_tables(held), least))
                    held = []
                held.append(rows.slice(a, b - a))
            yield _result(done)
        if held:
            yield _result([_tile(pa.concat_tables(held), least)])

    return tiles


def _result(done: list) -> pa.RecordBatch:
    columns = [np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "n", "root"])


def meetings(reps: DataFrame) -> DataFrame:
    """(t, c1, c2, rid) of all pairs of cells that hold at least two of ``reps``, with their number of rows."""
    at = [
        F.struct(F.lit(t).alias("t"), F.get("codes", F.lit(t * 2 * PROBES + i)).alias("c1"), F.get("codes", F.lit((t * 2 + 1) * PROBES + j)).alias("c2"))
        for t, i, j in product(range(TABLES), range(PROBES), range(PROBES))
    ]
    met = reps.select("rid", F.inline(F.array(*at)))
    shared = saved(met.groupBy("t", "c1", "c2").agg(F.count("*").alias("held")).where("held > 1"), "cells")
    return met.join(shared, ["t", "c1", "c2"])


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label)."""
    given = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = saved(given.mapInArrow(_encode, _CODED), "coded")
    folded = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    folded = saved(folded, "folded")
    reps = saved(rows.select("rid", "vector", "codes").join(folded.select("rid", "copies"), "rid"), "distinct_vectors")

    blocks = F.ceil(F.col("held") / tile).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    met = meetings(reps).select("t", "c1", "c2", "rid", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    tiles = met.join(reps, "rid").repartition(*_KEY).sortWithinPartitions(*_KEY)
    partial = saved(tiles.select(*_KEY, "block", "rid", "copies", "vector", "codes").mapInArrow(_compare(least), "rid long, n long, root long"), "links")

    counts = partial.groupBy("rid").agg(F.sum("n").alias("n"))
    groups = components(partial.select("rid", "root"), "rid", "root").withColumnRenamed("node", "rid")
    known = saved(folded.join(counts, "rid", "left").join(groups, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")), "known")
    smallest = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    known = known.join(smallest, "comp").select("digest", "copies", "n", "component_id")
    links = F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "digest").join(known, "digest", "left").select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
