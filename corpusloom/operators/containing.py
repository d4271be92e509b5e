"""Which texts contain which short names, per repository, without comparing them pairwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Characters of a piece in the index.
GRAM = 3
#: Names shorter than a piece that are looked up as a list; with more of them all shorter pieces are listed.
SHORT_NAMES = 1000
#: More names than this meet the texts in tiles of a repository, so that no piece is ever a row.
MANY_NAMES = 10000
#: Names and texts of a tile, and texts that are looked through at once.
TILE_NAMES, TILE_TEXTS, PASS_TEXTS = 1 << 18, 1 << 16, 4096
#: Bytes of the pieces that a tile looks up; a name has pieces of the largest size that fits.
SIZES = (8, 4, 3, 2, 1)


def _pieces(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters; of a shorter text, the text itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _keys(names: DataFrame) -> Column:
    """The pieces under which ``text`` is listed: all of the full size, and of the shorter ones those that are names."""
    text = F.col("text")
    shorter = F.concat(*[_pieces(text, n) for n in range(1, GRAM)], F.array(F.lit("")))
    short = names.filter(F.length("name") < GRAM).select("name").distinct().limit(SHORT_NAMES + 1).collect()
    if not short:
        return F.array_distinct(_pieces(text, GRAM))
    if len(short) <= SHORT_NAMES:
        shorter = F.array_intersect(shorter, F.array(*[F.lit(r["name"]) for r in short]))
    return F.array_distinct(F.concat(_pieces(text, GRAM), shorter))


def containing(names: DataFrame, texts: DataFrame, few: bool = False) -> DataFrame:
    """(repo_id, name, text) for each of ``texts(repo_id, text)`` that contains one of ``names(repo_id, name)``.

    An inverted index of short pieces: a text is listed under its substrings of three characters, and under the shorter ones
    that are names, so its keys are linear in its length.  A name looks only under the rarest of its pieces, counted per
    repository, and not at all when one of them occurs nowhere.  ``contains`` decides.  Both sides have to be distinct, so that
    a name or text that many rows share is one row here; an empty name is in every text of its repository.

    The listed pieces are far more than Spark's estimate of them, so they are hinted out of a broadcast.  ``few`` names, such as
    those of search hits, may be broadcast to the pieces, which then stay where they are; only pieces of names are counted.

    More than ``MANY_NAMES`` names meet the texts in tiles instead (:func:`_in_tiles`): a piece of three characters is then in
    too many texts, and the pieces of all texts are many times their size.
    """
    names = stored(names.select("repo_id", "name"), "names")
    if names.count() > MANY_NAMES:
        return _in_tiles(names, texts)
    listed = texts.select("repo_id", "text", F.explode(_keys(names)).alias("piece"))
    own = names.select("repo_id", "name", F.explode(F.array_distinct(_pieces(F.col("name"), GRAM))).alias("piece"))
    if few:
        listed = listed.join(own.select("repo_id", "piece").distinct(), ["repo_id", "piece"], "left_semi")
    counts = listed.groupBy("repo_id", "piece").agg(F.count("*").alias("n")).hint("merge")
    rarest = (
        own.join(counts, ["repo_id", "piece"], "left")
        .groupBy("repo_id", "name")
        .agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count_if(F.col("n").isNull()).alias("_absent"))
        .filter("_absent = 0")
    )
    found = rarest.select("repo_id", "piece", "name").join(listed if few else listed.hint("merge"), ["repo_id", "piece"])
    return found.filter(F.contains("text", F.col("name"))).select("repo_id", "name", "text")


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each one begins and ends."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return flat, ends[:-1] - ends[0], ends[1:] - ends[0]


def _grams(values: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of ``size`` bytes as numbers, and the string that each one is in."""
    flat, starts, ends = _bytes(values)
    places = max(len(flat) - size + 1, 0)
    owner = np.repeat(np.arange(len(values)), ends - starts)[:places]
    inside = np.arange(places) + size <= ends[owner]
    found = np.zeros(places, np.uint64)
    for i in range(size):
        found |= flat[i : i + places].astype(np.uint64) << np.uint64(8 * i)
    return found[inside], owner[inside]


def _slots(grams: np.ndarray) -> np.ndarray:
    """A place in a table of 2 ** 20 flags for each piece."""
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _listed(names: pa.Array) -> list[tuple]:
    """For each size of pieces: the pieces, sorted, the names under each of them, and flags of the slots in use.

    A name is listed once, under that of its pieces that fewest names have, so that a piece of a text leads to few names.
    """
    lengths = pc.binary_length(names).to_numpy()
    lists = []
    for size, more in zip(SIZES, (None, *SIZES)):
        of = np.flatnonzero((lengths >= size) & ((lengths < more) if more else True))
        if not len(of):
            continue
        grams, owner = _grams(names.take(pa.array(of)), size)
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        ranked = np.lexsort((grams, counts[inverse], owner))
        first = ranked[np.r_[True, owner[ranked][1:] != owner[ranked][:-1]]]
        at = np.argsort(grams[first], kind="stable")
        keys, starts = np.unique(grams[first][at], return_index=True)
        used = np.zeros(1 << 20, bool)
        used[_slots(keys)] = True
        lists.append((size, keys, np.r_[starts, len(at)], of[at], used))
    return lists


def _pairs(lists: list[tuple], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts and names that share the piece under which the name is listed, each pair once, by text."""
    found = []
    for size, keys, starts, listed, used in lists:
        grams, owner = _grams(texts, size)
        maybe = used[_slots(grams)]
        grams, owner = grams[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        same = keys[at] == grams
        pair = np.unique(owner[same] * len(keys) + at[same])
        owner, at = np.divmod(pair, len(keys))
        many = starts[at + 1] - starts[at]
        place = np.repeat(starts[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(at) else at
        found.append((np.repeat(owner, many), listed[place]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, name = (np.concatenate(x) for x in zip(*found))
    by_text = np.argsort(owner, kind="stable")
    return owner[by_text], name[by_text]


def _found(names: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Some texts at a time that contain names, and the names in each."""
    lists, words = _listed(names), names.to_pylist()
    empty = np.array([i for i, n in enumerate(words) if not n], np.int64)
    for at in range(0, len(texts), PASS_TEXTS):
        some = texts.slice(at, PASS_TEXTS)
        owner, name = _pairs(lists, some)
        values = some.to_pylist()
        right = np.fromiter((words[n] in values[t] for t, n in zip(owner.tolist(), name.tolist())), bool, len(owner))
        owner = np.r_[owner[right], np.repeat(np.arange(len(some)), len(empty))]
        name = np.r_[name[right], np.tile(empty, len(some))]
        by_text = np.argsort(owner, kind="stable")
        kept, many = np.unique(owner, return_counts=True)
        offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        yield some.take(pa.array(kept)), pa.ListArray.from_arrays(offsets, names.take(pa.array(name[by_text])))


def _in_tiles(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names and texts of a repository in hash blocks; each pair of blocks is a tile of bounded size for one task.

    Inside a tile, pieces of up to eight bytes are numbers that are looked up in a sorted list, where each name is under the
    rarest of its own; ``in`` decides.  Only names and texts are shuffled: a text once for each block of names of its repository.
    """
    given = lambda df, c: df.select("repo_id", c).filter(F.col("repo_id").isNotNull() & F.col(c).isNotNull())
    names, texts = given(names, "name"), given(texts, "text")
    blocks = lambda df, size, n: df.groupBy("repo_id").agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    sizes = blocks(names, TILE_NAMES, "_m").join(blocks(texts, TILE_TEXTS, "_n"), "repo_id")
    deal = lambda df, c, mine, others, i, j: (
        df.join(sizes, "repo_id")
        .withColumn(i, F.pmod(F.xxhash64(c), F.col(mine)).cast("int"))
        .withColumn(j, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        .drop("_m", "_n")
        .groupBy("repo_id", "_i", "_j")
    )
    schema = "repo_id string, text string, names array<string>"

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(t, n) for t, n in _found(_one(own, "name"), _one(asked, "text")) if len(t)] if len(own) and len(asked) else []
        given = pa.chunked_array([t for t, _ in found], pa.string())
        repo = pa.repeat(own.column("repo_id")[0], len(given)) if found else pa.array([], pa.string())
        return pa.table([repo.cast(pa.string()), given, pa.chunked_array([n for _, n in found], pa.list_(pa.string()))], ["repo_id", "text", "names"])

    tiles = deal(names, "name", "_m", "_n", "_i", "_j").cogroup(deal(texts, "text", "_n", "_m", "_j", "_i")).applyInArrow(run, schema)
    return tiles.select("repo_id", F.explode("names").alias("name"), "text")


def _one(table: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.string()) for c in table.column(column).chunks])
