"""Secret scans: fixed patterns, and automata inferred from the credentials that they find.

The patterns' matches are labelled credentials. For each kind, a prefix tree of a bounded sample (``SAMPLE`` strings, those
with the smallest hash) is folded by merging states whose counts are statistically compatible (Hoeffding bound, red and blue
states); the result is a probabilistic automaton over classes of characters. All other long runs of credential characters are
scored: a run is a secret if its mean log likelihood under an automaton, per character, is near that of the credentials it
was learnt from, and above that of letters as they come in the scanned texts' own words. Matches of the patterns always stay.

Edge cases: null counts as empty. Texts without a match have no spans. Without labelled credentials nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens

#: Fixed values of the contract: patterns and least lengths. A-Z and a-z count alike in ``assign`` alone.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_STEMS = ("passw", "secret", "token", "api")

#: Labelled strings of each kind that an automaton is inferred from, the test's level, and the least run that is scored.
SAMPLE, LEVEL, LEAST_RUN = 400, 0.05, 20
#: A run may be this much less likely (nats for each character) than the mean of the strings learnt from.
SLACK = 0.25

_RUNS = np.zeros(256, bool)
_RUNS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and then kind."""
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_of(text: str, span: tuple[int, int, str]) -> str:
    """The credential itself in a span."""
    start, end, kind = span
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def symbol(char: str) -> str:
    """Class of a character: d digits, x and X the letters of hex numbers, a and A the others, marks as they are."""
    if char.isdigit():
        return "d"
    if char.isalpha():
        return ("x" if char in "abcdef" else "a") if char.islower() else ("X" if char in "ABCDEF" else "A")
    return char


#: Characters in each class, over which a class's probability is shared.
_MEMBERS = {"d": 10, "x": 6, "X": 6, "a": 20, "A": 20}


class Automaton:
    """Probabilistic automaton inferred by merging states of a prefix tree."""

    def __init__(self, strings: list[str], level: float = LEVEL):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for s in strings:
            state = 0
            for c in map(symbol, s):
                self.total[state] += 1
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                state = self.next[state][c]
            self.total[state] += 1
            self.ends[state] += 1
        self._gap = np.sqrt(np.log(2 / level) / 2)
        self._infer()
        lengths = [len(s) for s in strings]
        self.shortest, self.longest = min(lengths), max(lengths)
        self.typical = float(np.mean([self.score(s) for s in strings]))

    def _near(self, k1: int, n1: int, k2: int, n2: int) -> bool:
        return abs(k1 / n1 - k2 / n2) <= self._gap * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if not self.total[p] or not self.total[q]:
                continue
            if not self._near(self.ends[p], self.total[p], self.ends[q], self.total[q]):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if not self._near(self.count[p].get(c, 0), self.total[p], self.count[q].get(c, 0), self.total[q]):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.ends[p] += self.ends[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _infer(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in known]
            if not blue:
                break
            parent, c, state = max(blue, key=lambda x: self.total[x[2]])  # the best supported first
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                known.add(state)

    def score(self, text: str) -> float:
        """Mean log likelihood per character."""
        state, out = 0, 0.0
        for c in text:
            s = symbol(c)
            n = self.count[state].get(s, 0)
            out += np.log((n + 1e-3) / (self.total[state] + 0.1) / _MEMBERS.get(s, 1))
            state = self.next[state].get(s, 0)
        return out / max(len(text), 1)

    def accepts(self, text: str) -> bool:
        return self.shortest <= len(text) <= 2 * self.longest and self.score(text) >= self.typical - SLACK


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, secret) of the patterns' matches in all texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s[2], secret_of(t, s)) for t in batch.column(0).to_pylist() if t for s in base_spans(t)]
            found = [(k, s) for k, s in found if len(s) >= LEAST_RUN]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["kind", "secret"])

    return docs.select("text").mapInArrow(find, "kind string, secret string")


def infer(examples: DataFrame, sample: int = SAMPLE, longest: int = 256) -> list[Automaton]:
    """Automata of the kinds of ``examples`` (kind, secret): at most ``sample`` strings each reach the driver."""
    rows = examples.where(F.length("secret") <= longest).groupBy("kind", "secret").agg(F.lit(1).alias("one"))
    rows = rows.select("kind", "secret", F.xxhash64("secret", F.lit(8)).alias("order"))
    out = []
    for kind in KINDS:
        strings = [r[0] for r in rows.where(F.col("kind") == kind).orderBy("order", "secret").limit(sample).select("secret").collect()]
        if len(strings) >= 5:
            out.append(Automaton(strings))
    return out


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the long runs of credential characters that hold a digit."""
    inside = _RUNS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    starts, ends = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    wanted = (ends - starts >= LEAST_RUN) & (digits[ends] > digits[starts])
    starts, ends = starts[wanted], ends[wanted]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def found(docs: DataFrame, automata: list[Automaton]) -> DataFrame:
    """(doc_id, spans array of (start, end, kind)): one row per row of ``docs``; kind ``grammar`` is added by the automata."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [base_spans(t) if t else [] for t in texts]
            for first, data, at in tokens.pieces(batch.column(1)) if automata else ():
                for s, e, r in zip(*_runs(data, at)):
                    run = data[s:e].tobytes().decode()
                    if any(a.accepts(run) for a in automata):
                        start = int(np.count_nonzero((data[at[r] : s] & 0xC0) != 0x80))
                        i = first + int(r)
                        if not any(start < y and x < start + len(run) for x, y, _ in spans[i]):
                            spans[i] = [*spans[i], (start, start + len(run), "grammar")]
            flat = [s for own in spans for s in sorted(own, key=lambda s: (s[0], (*KINDS, "grammar").index(s[2])))]
            fields = [pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            at = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in spans]))), pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, ["start", "end", "kind"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, spans array<struct<start: int, end: int, kind: string>>")


def digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans string) of ``found``."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
