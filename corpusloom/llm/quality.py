"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are one- and two-word grams of the words (A-Z lower-cased) and of their shapes: runs of capitals, small letters,
digits and other letters become one character each, marks stay, and a two-word shape also says whether the words are equal.
Each is hashed to one of 2^BITS places; values are 1 + ln(count), scaled to length 1 for each kind. Labels, ids, language and
source are no features.

The model is fitted in one task on at most ``SAMPLE`` labelled rows, those with the smallest hash of doc_id. All rows are scored
with sparse dot products in one scan without a shuffle.

Edge cases: an empty or null text has the features of no word and is scored by the bias. Labels without id or value, and ids
with two different labels, are not learnt from. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.common import saved

BITS = 18
#: Most labelled rows that the model is fitted on.
SAMPLE = 8192
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.02, 0.1, 5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = 0x80
_RUN = np.zeros(256, bool)
_RUN[[ord("A"), ord("a"), ord("0"), 0x80]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the shape of each word."""
    kind = _SHAPE[data]
    same = np.zeros(len(data), bool)
    same[1:] = (kind[1:] == kind[:-1]) & _RUN[kind[1:]]
    same[starts] = False
    at = np.concatenate(([0], np.cumsum(~same)))
    return tokens.span_hashes(kind[~same], at[starts], at[ends])


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, place, value) of each piece of a text column."""
    shift = np.uint64(64 - BITS)
    for first, data, at in tokens.pieces(column):
        starts, ends, row = tokens.word_spans(data, at)
        word, shape = tokens.span_hashes(tokens._LOWER[data], starts, ends), _shapes(data, starts, ends)
        next_one = np.flatnonzero(row[1:] == row[:-1])
        pair = lambda h: h[next_one] * np.uint64(0x9E3779B97F4A7C15) + h[next_one + 1]
        equal = (word[next_one] == word[next_one + 1]).astype(np.uint64)
        found = []
        for kind, (h, r) in enumerate(((word, row), (pair(word), row[next_one]), (shape, row), (pair(shape) * np.uint64(2) + equal, row[next_one]))):
            place, r, count = tokens.counted(tokens.mix(h + np.uint64(kind + 1)) >> shift, r)
            value = 1 + np.log(count)
            norm = np.sqrt(np.bincount(r, value**2, len(at) - 1))
            found.append((r, place.astype(np.int64), value / norm[r]))
        yield first, len(at) - 1, *(np.concatenate(x) for x in zip(*found))


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """FTRL-Proximal over (text, quality); the last place is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = []
    labels = rows["quality"].to_numpy()
    for first, count, row, place, value in features(pa.array(rows["text"], pa.string(), from_pandas=True)):
        order = np.lexsort((place, row))
        row, place, value = row[order], place[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(new)  # places that several kinds share are added up
        value = np.add.reduceat(value, at) if len(at) else value
        row, place = row[at], place[at]
        edges = np.searchsorted(row, np.arange(count + 1))
        for i in range(count):
            own = slice(edges[i], edges[i + 1])
            examples.append((np.append(place[own], size).astype(np.int32), np.append(value[own], 1.0).astype(np.float32), labels[first + i]))
    for _ in range(PASSES):
        for place, value, label in examples:
            zi, ni = z[place], n[place]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi @ value, -35, 35))) - label) * value
            z[place] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[place] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    used = np.flatnonzero(w)
    return pd.DataFrame({"place": used, "weight": w[used]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of all places and the bias, learnt from the labelled rows that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    known = known.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id"), F.lit(4))
    chosen = saved(known.orderBy(order, "doc_id").limit(sample), "sample")
    weights = np.zeros((1 << BITS) + 1)
    if chosen.agg(F.count_distinct("quality")).first()[0] < 2:
        return weights
    # At most ``sample`` pairs of numbers, so the broadcast is bounded.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "text"]).withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    model = rows.groupBy().applyInPandas(lambda p: _train(p.sort_values(["order", "text"])), "place long, weight double")
    for place, weight in model.collect():  # 2^BITS numbers at most
        weights[place] = weight
    return weights


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            out = np.full(batch.num_rows, w[-1])
            for first, rows, row, place, value in features(batch.column(1)):
                out[first : first + rows] += np.bincount(row, value * w[place], rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(1 / (1 + np.exp(-out)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    rows = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, scored where they lie."""
    weights = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        w = shared.value.astype(np.float64)
        out = np.full(len(texts), w[-1])
        for first, rows, row, place, value in features(pa.array(texts, pa.string(), from_pandas=True)):
            out[first : first + rows] += np.bincount(row, value * w[place], rows)
        return pd.Series(out >= 0)

    return docs.where(good("text"))
