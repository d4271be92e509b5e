"""Quality rules: rules on each document, and a verdict on its domain from the shrunk rate of rule failures.

Failures (the base rules, many symbols, many repeated lines) are counted by domain; a beta prior fitted on all domains shrinks
the rates. Documents of a domain whose lower posterior bound is over ``limit`` go, like those that fail a base rule. The
domain of ``documents`` is their source.

Edge cases: a null or empty text has no words and fails. A null domain is a domain of its own. Rows are independent, so
repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bayes, tokens
from corpusloom.llm.common import saved

LEAST_WORDS, MOST_REPEATED = 20, 30
#: Words of a window in which repetition is looked for.
WINDOW = 8
#: Further failures that count for the domain only: symbols for 100 words, repeated lines for 100 lines with a word.
MOST_SYMBOLS, MOST_LINES = 20, 50
LIMIT, Z = 0.5, 1.645

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(word: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, its words inside a window that occurs at least twice in the row."""
    gram, first = tokens.grams(word, row, WINDOW)
    if not len(gram):
        return np.zeros(rows, np.int64)
    order = np.lexsort((gram, row[first]))
    g, r = gram[order], row[first][order]
    same = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    twice = np.append(same, False) | np.append(False, same)
    at = first[order[twice]]
    edges = np.bincount(at, minlength=len(word) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(word) + WINDOW + 1)
    covered = np.cumsum(edges)[: len(word)] > 0
    return np.bincount(row[covered], minlength=rows)


def _dup_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier one."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def measured(docs: DataFrame, domain: str = "source") -> DataFrame:
    """(doc_id, domain, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            counts = np.zeros((len(_COUNTS), batch.num_rows), np.int64)
            for first, data, at in tokens.pieces(texts):
                rows, span = len(at) - 1, slice(first, first + len(at) - 1)
                starts, ends, row = tokens.word_spans(data, at)
                word = tokens.span_hashes(data, starts, ends)
                inside = ~tokens._SPACE[data] & ((data & 0xC0) != 0x80)
                sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])
                counts[0, span] = np.bincount(row, minlength=rows)
                counts[1, span], counts[2, span] = sums(inside), sums(_SYMBOL[data])
                counts[5, span] = _repeated(word, row, rows)
            for i, text in enumerate(texts.to_pylist()):
                counts[3, i], counts[4, i] = _dup_lines(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], ["doc_id", "domain", *_COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(domain).cast("string").alias("domain"), "text")
    return rows.mapInArrow(measure, "doc_id long, domain string, " + ", ".join(f"{c} long" for c in _COUNTS))


def judged(docs: DataFrame, domain: str = "source", limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``measured`` with base_failed, the domain's bound and kept: one row per row of ``docs``."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = saved(measured(docs, domain).withColumn("base_failed", base), "measured")
    failed = F.col("base_failed") | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_LINES * F.col("n_lines"))
    domains = saved(rows.groupBy("domain").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("k")), "domains")
    n, k = domains.agg(F.sum("n"), F.sum("k")).first()
    mean = F.lit((k or 0) / n if n else 0.0)
    bound = bayes.lower_bound(mean, bayes.strength(domains, mean), F.col("n"), F.col("k"), z)
    verdicts = saved(domains.select(F.col("domain").alias("_domain"), bound.alias("domain_bound")), "verdicts")
    joined = rows.join(verdicts, F.col("domain").eqNullSafe(F.col("_domain"))).drop("_domain")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("domain_bound") <= limit))
