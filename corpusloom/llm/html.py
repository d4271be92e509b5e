"""HTML extraction: the page's own structure, then a host suffix array over what the structure leaves open.

A page is cut into blocks. Blocks inside of ``<article>`` or ``<main>`` are content, blocks inside of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments (by element, role, class or id) are boilerplate, all others are open.
Content is kept whole and boilerplate goes.

Open blocks, on pages with and without content, are told apart by what the host repeats. The token streams of the host's pages (all
blocks that aren't content) are concatenated and their suffixes sorted by prefix doubling up to ``RUN`` tokens; neighbours
that agree in all of them on distinct pages are a repeated substring. A substring of at least ``RUN`` tokens is repeated if and
only if each of its ``RUN``-token parts is, so the parts decide coverage exactly. Big hosts are sorted in shards of
``SHARD_PAGES`` pages, and the shards' distinct parts are merged by host. Open blocks that are mostly covered go; unique runs stay, in page order.

Edge cases: null html is empty and gives an empty text. A null url has the empty host. Rows are pages of their own, so a page
that comes twice repeats itself. Unclosed boilerplate ends at the next article. Broken markup is read as text where it is none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens, urls
from corpusloom.llm.common import saved

RUN, SHARD_PAGES, COVERED = 8, 128, 0.8

#: Elements by role. Lists of HTML's own names and of common class names, fixed values.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "math", "canvas", "audio", "video")
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
CHROME_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disclaimer", "footer", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "search", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", *CHROME,
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTENT = {"article", "main"}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*>(?:.*?(</\1\s*>)|.*\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""",
    re.S | re.I,
)
_TAIL = re.compile(r"<!--[\s\S]*|<[!?][\s\S]*")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _is_chrome(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_content):
        return True
    if not attributes or tag in ("html", "body") or tag in CONTENT:
        return False
    for m in _NAMED.finditer(attributes):
        if not CHROME_WORDS.isdisjoint(_WORD.findall((m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


def marks(page: str) -> Iterator[re.Match]:
    """Comments, raw elements and tags of a page, in time linear in its length.

    No tag ends after the last ``>``, so tags are only looked for before it; after it only a comment or declaration can begin,
    which takes all that is left, like one or a raw element that is open there.
    """
    last, m = page.rfind(">") + 1, None
    for m in _MARK.finditer(page, 0, last):
        if m.end() < last:
            yield m
    if m is not None and m.end() == last:
        if len(m[0]) > 6 and m[0].endswith("-->") if m[0].startswith("<!--") else not m[1] or m[2]:
            yield m
        else:
            yield re.compile(r"[\s\S]*").match(page, m.start())
            return
    m = _TAIL.search(page, last)
    if m:
        yield m


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of a page in order; kind is content, open or chrome."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    content = 0
    chrome, depth = "", 0  # the outermost boilerplate element and how often its name is open inside

    def close() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = _SPACE.sub(" ", text).strip(" ")
            if text:
                out.append(("chrome" if chrome else "content" if content else "open", text))
            parts.clear()

    at = 0
    ends: dict[str, int] = {}
    for m in marks(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[7]) if m.re is _MARK else None
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[3] or m[6]), m[5] or m[8] or ""
        if tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        if chrome:
            if chrome not in ends:
                ends[chrome] = page.rfind(f"</{chrome}")
            if tag in CONTENT and not closing and ends[chrome] < at:
                close()
                chrome, depth = "", 0
            else:
                if tag in BLOCKS:
                    close()
                if tag == chrome and not attributes.endswith("/"):
                    depth += -1 if closing else 1
                    if not depth:
                        close()
                        chrome = ""
                continue
        if not closing and tag not in VOID and not attributes.endswith("/") and _is_chrome(tag, attributes, content > 0):
            close()
            chrome, depth = tag, 1
            continue
        if tag in BLOCKS:
            close()
            if tag in CONTENT:
                content = max(0, content + (-1 if closing else 1))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and block of each word of the blocks."""
    hashes, rows = [], []
    for first, data, at in tokens.pieces(pa.array(texts, pa.string())):
        h, r = tokens.words(data, at, lower=False)
        hashes.append(h)
        rows.append(r + first)
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def parsed(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, content, rest): the content's text, or null; ``rest`` has the other blocks (open, text) and
    how many blocks of content come before each."""
    kinds = pa.struct([("open", pa.bool_()), ("text", pa.string()), ("before", pa.int32())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, rest = [], []
            for page in batch.column(4).to_pylist():
                found = blocks(page or "")
                own = [t for k, t in found if k == "content"]
                content.append("\n".join(own) if own else None)
                before = accumulate(k == "content" for k, _ in found)
                rest.append([{"open": k == "open", "text": t, "before": int(n)} for (k, t), n in zip(found, before) if k != "content"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(content, pa.string()), pa.array(rest, pa.list_(kinds))], ["row", "page_id", "url", "host", "content", "rest"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "url", urls.host(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(parse, "row long, page_id long, url string, host string, content string, rest array<struct<open: boolean, text: string, before: int>>")


def suffix_ranks(stream: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens (a power of two), by prefix doubling; equal ranks agree in all."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def _shard_runs(shard: pd.DataFrame) -> pd.DataFrame:
    """Distinct runs of RUN tokens of a shard with the first and last page that has them."""
    stream, run, page = [], [], []
    for i, (row, rest) in enumerate(zip(shard["row"], shard["rest"])):
        h, _ = _stream([b["text"] for b in rest])
        if len(h) < RUN:
            continue
        g, first = tokens.grams(h, np.zeros(len(h), np.int64), RUN)
        stream.append(np.append(h, np.uint64(i)))  # a mark of its own ends each page
        run.append(np.append(g[np.argsort(first)], np.zeros(RUN, np.uint64)))
        page.append(np.full(len(h) + 1, row))
    if not stream:
        return pd.DataFrame({"host": np.array([], object), "run": np.array([], np.int64), "first": np.array([], np.int64), "last": np.array([], np.int64)})
    stream, run, page = np.concatenate(stream), np.concatenate(run), np.concatenate(page)
    rank = suffix_ranks(stream, RUN)
    whole = np.flatnonzero(run)  # suffixes that don't reach over a page's end
    order = whole[np.lexsort((page[whole], rank[whole]))]  # the suffix array, pages in order among equals
    new = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
    ends = np.append(new[1:], len(order)) - 1
    hosts = np.full(len(new), shard["host"].iloc[0], object)  # plain objects, whatever text type pandas prefers
    return pd.DataFrame({"host": hosts, "run": run[order[new]].view(np.int64), "first": page[order[new]], "last": page[order[ends]]})


def repeated_runs(rows: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(host, run): hashes of the runs of RUN tokens that at least two pages (row, host, rest) of a host have."""
    counts = saved(rows.groupBy("host").agg(F.count("*").alias("pages")), "host_counts")
    shards = F.ceil(F.col("pages") / shard_pages)
    dealt = rows.select("row", "host", "rest").join(counts, "host").withColumn("shard", F.pmod(F.xxhash64("row"), shards))
    runs = dealt.select("row", "host", "rest", "shard").groupBy("host", "shard").applyInPandas(_shard_runs, "host string, run long, first long, last long")
    merged = runs.groupBy("host", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.where("first < last").select("host", "run")


def _open_text(content: str | None, rest: list, covered: set[int]) -> str:
    """The content's blocks and the open blocks that aren't mostly covered, in page order."""
    texts = [b["text"] for b in rest]
    h, block = _stream(texts)
    inside = np.zeros(len(h), bool)
    if len(h) >= RUN and covered:
        g, first = tokens.grams(h, np.zeros(len(h), np.int64), RUN)
        hit = first[np.isin(g, np.array(sorted(covered), np.int64).view(np.uint64))]
        for k in range(RUN):
            inside[hit + k] = True
    lost = np.bincount(block[inside], minlength=len(texts))
    size = np.bincount(block, minlength=len(texts))
    out, own, at = [], content.split("\n") if content is not None else [], 0  # a block has no \n
    for b, t, n, m in zip(rest, texts, lost, size):
        if b["open"] and n < COVERED * max(m, 1):
            out += [*own[at : b["before"]], t]
            at = b["before"]
    return "\n".join(out + own[at:])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``."""
    rows = saved(parsed(pages), "parsed")
    repeated = saved(repeated_runs(rows), "repeated_runs")
    has_open = F.exists("rest", lambda b: b["open"])
    bare = rows.where(has_open)

    @F.udf("array<bigint>", useArrow=True)
    def runs_of(texts: list) -> list:
        h, _ = _stream(list(texts))
        return tokens.grams(h, np.zeros(len(h), np.int64), RUN)[0].view(np.int64).tolist() if len(h) >= RUN else []

    own = bare.select("row", "host", F.explode(runs_of(F.transform("rest", lambda b: b["text"]))).alias("run"))
    covered = own.join(repeated, ["host", "run"]).groupBy("row").agg(F.collect_set("run").alias("covered"))  # a page's own runs

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_open_text(t, r or [], set(c or ())) for t, r, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    opened = bare.join(covered, "row", "left").select("page_id", "url", "content", "rest", "covered").mapInArrow(finish, "page_id long, url string, text string")
    plain = rows.where(~has_open).select("page_id", "url", F.coalesce("content", F.lit("")).alias("text"))
    return plain.unionByName(opened).withColumn("n_chars", F.length("text").cast("long"))
